"""Literature-evidence analytics expressed as Spark DataFrame operators."""
