"""Whole queries: projections of tables onto the domain, reports, and their SQL."""
