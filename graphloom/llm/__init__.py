"""Operators for training-data pipelines. Nothing else in graphloom imports them."""
