"""Vehicle-network trace analytics on Spark: raw frames as tables, signal definitions compiled to column expressions."""
