"""Operators of a training-data pipeline; each module is one operator and nothing outside imports them."""
