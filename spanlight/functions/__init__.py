"""Scalar functions as SQL text, for Spark and for the engine that checks it."""
