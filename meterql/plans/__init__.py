"""Relational plans: seven node kinds, a binder that makes them, and their text."""
