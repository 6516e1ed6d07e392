"""Composed reports (auto report, chart registry, dashboard) and the query registry."""
