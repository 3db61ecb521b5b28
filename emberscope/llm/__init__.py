"""Operators of a training-data pipeline over tables of texts; nothing else imports this package."""
