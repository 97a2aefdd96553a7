"""Concordia: a Spark-native engine for comparing versions of long structured documents."""
