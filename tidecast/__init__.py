"""Demand and revenue planning analytics as Spark DataFrame operators."""
