"""Document analytics as DataFrame and Spark SQL plans."""
