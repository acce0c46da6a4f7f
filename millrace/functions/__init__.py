"""Millrace functions."""
