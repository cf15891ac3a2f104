"""sourceloom: source-code and text corpora as Spark tables."""

__version__ = "0.1.0"
