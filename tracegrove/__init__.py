"""Spark-native analysis of source trees, typed property graphs and the text attached to them."""
