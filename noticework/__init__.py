"""Spark jobs for public-demand analytics: notices in, clean history and indicators out."""

__version__ = "0.1.0"
