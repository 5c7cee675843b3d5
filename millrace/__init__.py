"""millrace: declarative ETL jobs and customer analytics as plain Spark DataFrame plans."""

__version__ = "0.1.0"
