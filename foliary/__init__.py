"""foliary: a PySpark-native engine for cleaning, profiling and analysing text corpora."""

__version__ = "0.1.0"
