"""Diachronic phrase-network analytics as Spark DataFrame plans."""
