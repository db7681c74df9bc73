"""Column builders: every function takes and returns ``Column`` and stays inside the JVM."""
