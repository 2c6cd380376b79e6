"""Front end: SQL of nine warehouse dialects to Spark SQL."""
