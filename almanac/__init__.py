"""Almanac: a PySpark-native analytics engine for season-partitioned archives."""
