"""Cladewise: Spark-native analytics over forests, sparse presence matrices and their observations."""

__version__ = "0.1.0"
