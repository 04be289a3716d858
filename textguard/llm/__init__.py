"""Operators of a training-data pipeline: text and vector tables in, tables out."""
