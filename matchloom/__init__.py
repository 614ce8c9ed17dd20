"""Match-statistics analytics on Spark."""
