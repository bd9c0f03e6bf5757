"""alertweave: Spark-native correlation of alert streams (DataFrame / Catalyst first)."""

__version__ = "0.1.0"
