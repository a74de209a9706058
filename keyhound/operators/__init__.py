"""Operators: routing, extraction, matching, context and reports."""
