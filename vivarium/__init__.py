"""Behaviour analytics on Spark: DataFrame-to-DataFrame operators for trajectories, events and groups."""
