"""Document analytics on Spark: scanned documents in, tables and Markdown out."""
