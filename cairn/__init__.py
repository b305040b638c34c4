"""Backup-metadata and block-level analytics on Spark DataFrames."""
