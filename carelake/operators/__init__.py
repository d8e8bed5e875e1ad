"""Reusable DataFrame operators (no UDFs unless stated)."""
