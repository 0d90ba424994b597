"""Column builders: everything here returns a ``pyspark.sql.Column``."""
