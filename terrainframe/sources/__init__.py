"""Readers and views that give the relations."""
