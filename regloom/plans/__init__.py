"""Registered queries and their SQL for other engines."""
