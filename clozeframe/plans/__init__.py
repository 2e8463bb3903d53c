"""Whole experiments put together from operators: scoring runs, reports, and the query catalog."""
