"""Compositions of operators into named queries."""
