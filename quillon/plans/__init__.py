"""Requests and what they compile to."""
