"""Column builders: they take and return Spark columns and never start a job."""
