"""Spark-native matching, ranking, de-duplication and review analytics."""
