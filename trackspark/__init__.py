"""A PySpark-native engine for noisy, ordered observations (position tracks, intervals, job tables)."""
