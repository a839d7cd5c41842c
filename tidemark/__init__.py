"""Document curation on PySpark."""
