"""Search and analysis of job postings with Spark DataFrames."""
