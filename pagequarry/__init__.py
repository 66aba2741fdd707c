"""A PySpark-native engine that turns tables of web pages into structured rows."""

__version__ = "0.1.0"
