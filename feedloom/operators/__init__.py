"""Operators on tables of items and on the ledger of what was sent."""
