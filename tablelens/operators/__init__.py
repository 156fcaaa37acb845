"""Operators: ordering, cleaning, profiling, KPIs, charts, insights, catalog, questions."""
