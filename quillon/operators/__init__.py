"""Stored tables, mutation, maintenance and analytics."""
