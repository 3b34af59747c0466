"""Competitor-graph analytics over tagged companies, written as Spark DataFrame jobs."""
