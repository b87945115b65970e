"""A read-only subset of Cypher, compiled to Spark SQL."""
