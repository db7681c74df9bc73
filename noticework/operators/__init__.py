"""DataFrame operators: generic over column names, no action on the driver unless a docstring says so."""
