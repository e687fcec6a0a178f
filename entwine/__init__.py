"""A PySpark-native engine for coreference corpora and the data pipelines around them."""

__version__ = "0.1.0"
