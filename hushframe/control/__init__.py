"""Grants, budgets, listings and the research service."""
