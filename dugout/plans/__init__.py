"""Whole dataflows, composed from operators."""
