"""Shared shapes of plans, tables and the registry of analyses."""
