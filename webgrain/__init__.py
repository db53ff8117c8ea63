"""webgrain: web-audit analytics expressed as Spark DataFrame plans."""
