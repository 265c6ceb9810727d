"""Operators of a training-data pipeline over document tables; each module has one method."""
