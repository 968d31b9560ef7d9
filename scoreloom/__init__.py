"""Spark-first audit engine for frozen, weighted feature programs."""
