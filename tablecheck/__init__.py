"""Compare two copies of a dataset and check the data against declared rules, on Spark."""
