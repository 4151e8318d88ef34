"""Driver queries: Spark side, and the same results in SQL for checking."""
