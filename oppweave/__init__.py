"""Opportunity matching and discovery as Spark table and stream jobs."""
