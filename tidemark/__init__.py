"""A retail-banking warehouse on Spark: typed tables, views, screens, loads, snapshots and checks."""
