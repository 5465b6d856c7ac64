"""Mart refresh driven by newly landed files."""
