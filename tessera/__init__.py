"""tessera: a PySpark-native engine for comparing tables, texts and documents."""

__version__ = "0.1.0"
