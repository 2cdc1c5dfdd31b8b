"""Operators that prepare training data: one module per operator, their queries in ``queries``."""
