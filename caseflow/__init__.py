"""Case intake and triage analytics expressed as Spark DataFrame jobs."""
