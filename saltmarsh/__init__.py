"""Point-in-time market-attention and relationship analytics, written as Spark DataFrame jobs."""
