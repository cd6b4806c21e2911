"""quiverlake: a PySpark-native analytics engine for agent context data."""
