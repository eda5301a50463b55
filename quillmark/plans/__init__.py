"""Whole plans: the daily run, and the registered queries."""
