"""Whole queries: the portfolio update, the fixture views and the query registry."""
