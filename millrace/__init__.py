"""Millrace: a PySpark-native engine for building, auditing and scoring record and text datasets."""
