"""A PySpark-native analytics engine for monitored postings and public filings."""

__version__ = "0.1.0"
