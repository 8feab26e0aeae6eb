"""Whole plans: fetch outcomes, settings, and the catalogue of registered queries."""
