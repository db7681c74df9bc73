"""Incremental forms of the batch jobs: new files in, corrected cells win."""
