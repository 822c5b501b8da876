"""tidegrid: a Spark-native engine for time-series exploration and production."""

__version__ = "0.1.0"
