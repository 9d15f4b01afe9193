"""XML analytics on Spark: documents are rows, parsing yields relations."""
