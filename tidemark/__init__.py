"""Research on time-ordered bar series as Spark DataFrame jobs."""
