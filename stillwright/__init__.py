"""Spark-native analytics over media annotations: keyframes, observations, roles and text."""
