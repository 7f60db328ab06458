"""A PySpark-native query engine for versioned map data, with an optional corpus-preparation subpackage."""
