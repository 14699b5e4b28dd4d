"""Loan-month panel analytics as Spark DataFrame operations."""
