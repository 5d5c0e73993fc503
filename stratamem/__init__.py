"""Long-term memory analytics on PySpark: bitemporal facts, hybrid retrieval, histories."""
