"""Inputs: file corpora, tables, rules and scan settings."""
