"""Ridgeline: a PySpark-native engine for period panels, rolling ridge forecasts and corpus preparation."""
