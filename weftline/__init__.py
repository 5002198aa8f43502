"""Weftline: a Spark-native engine for matching people and teams with opportunities."""
