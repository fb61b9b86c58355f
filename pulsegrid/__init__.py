"""PySpark-native analytics over sampled signals, intervals and cohorts."""

__version__ = "0.1.0"
