"""Whole analyses, reports and queries."""
