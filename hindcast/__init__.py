"""Demand-forecast vintage analytics as Spark DataFrame jobs."""
