"""Composed jobs over the operators, and the registered queries."""
