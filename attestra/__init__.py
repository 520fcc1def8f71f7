"""Evidence-linkage and corpus analytics expressed as Spark DataFrame jobs."""
