"""Code and configuration auditing for many repositories, as Spark DataFrame jobs."""
