"""pairforge: paired-text dataset preparation and evaluation on Spark."""
__version__ = "0.1.0"
