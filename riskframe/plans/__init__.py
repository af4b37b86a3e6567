"""Analytical views and dashboard queries."""
