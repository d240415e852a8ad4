"""Spark-native checking and analytics of Russian, Kazakh and mixed-language texts."""
