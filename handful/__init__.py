"""Few-shot text analytics as Spark DataFrame operators."""
