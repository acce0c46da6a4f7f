"""Millrace plans."""
