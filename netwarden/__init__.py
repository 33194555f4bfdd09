"""Network-security analytics expressed as Spark DataFrame jobs."""
