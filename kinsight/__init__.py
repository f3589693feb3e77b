"""Spark-native viewer inference, identity and attribution engine."""
