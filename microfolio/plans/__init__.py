"""Finished tables: warehouse, scoring, service marts, serving reads."""
