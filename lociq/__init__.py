"""Spark-native genome-wide association and polygenic-score analytics."""
