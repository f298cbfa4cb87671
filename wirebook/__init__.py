"""HTTP trace analytics on Spark."""
