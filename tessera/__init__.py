"""Tessera: a PySpark-native relational analytics engine."""
