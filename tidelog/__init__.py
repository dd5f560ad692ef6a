"""A document mutation-log analytics engine on PySpark."""
