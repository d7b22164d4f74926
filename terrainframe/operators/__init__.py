"""Operators over cell, basin and score relations."""
