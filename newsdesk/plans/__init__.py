"""Whole plans composed from the operators, and the registered queries."""
