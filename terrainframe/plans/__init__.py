"""Registered queries with their SQL counterparts, and the composed plans."""
