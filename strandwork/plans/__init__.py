"""Composed plans: dashboards, section analysis, arrangement planners, gains, and the query catalogue."""
