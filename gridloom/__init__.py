"""A PySpark-native engine for sensor, trajectory and map data."""
