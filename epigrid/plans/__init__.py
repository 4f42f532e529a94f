"""Whole plans: composed stages and the registered queries."""
