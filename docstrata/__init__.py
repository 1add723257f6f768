"""Spark-native document-context and register-knowledge engine."""

VERSION = "0.2"
