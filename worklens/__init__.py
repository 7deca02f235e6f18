"""worklens: SQL-workload analytics as Spark DataFrame transformations."""
