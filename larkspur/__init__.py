"""Larkspur: a strictly typed SQL engine and data-preparation operators on Spark."""
