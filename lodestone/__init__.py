"""Spark-first posting matching, evidence and history engine."""
