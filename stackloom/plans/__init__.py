"""Event tables derived from the driver's relational data."""
