"""Terminology standardisation and review analytics on Spark."""
