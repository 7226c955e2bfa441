"""quire: Spark-native analytics and transformation of structured documents."""

__version__ = "0.1.0"
