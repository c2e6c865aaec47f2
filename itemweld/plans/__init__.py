"""Operators put together: the match build, serving models and reports."""
