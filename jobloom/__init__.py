"""Job-market analytics on Spark: search, matching, cleaning and corpus preparation."""
