"""Logical plans: algebra, JSON codec and the query suite."""
