"""Compositions: full analysis of one table and re-analysis for a date range."""
