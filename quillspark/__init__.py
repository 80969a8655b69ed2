"""Spark-native search, graph analytics and ETL over hierarchical documents."""
