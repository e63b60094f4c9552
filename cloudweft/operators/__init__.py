"""Operators on tables of points, predictions and texts."""
