"""Pitch-event analytics as lazy, column-parametric Spark DataFrame operators."""
