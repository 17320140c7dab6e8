"""Catalogue and text analytics as lazy Spark DataFrame operators."""
