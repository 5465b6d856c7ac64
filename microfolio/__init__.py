"""Loan-portfolio analytics as plain Spark DataFrame jobs."""
