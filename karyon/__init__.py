"""Single-cell copy-number analytics as Spark DataFrame operators."""
