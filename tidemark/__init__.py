"""Tidemark: interaction-event analytics expressed as Spark DataFrame, SQL and streaming operators."""
