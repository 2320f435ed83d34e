"""Interval, passage and text analytics expressed as Spark DataFrame operators."""
