"""Spark-native analytics for collections of posts and documents."""

__version__ = "0.1.0"
