"""Profile-event analytics on Spark."""
