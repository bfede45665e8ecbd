"""Payload shapes to the common schema, and the Parquet snapshot layout."""
