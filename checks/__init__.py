"""Registered queries, the data they run on and their SQL counterparts."""
