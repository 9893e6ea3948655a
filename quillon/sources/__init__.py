"""Readers and writers of outside formats."""
