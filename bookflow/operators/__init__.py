"""Joins, windows and folds over tables of blocks, lines and pages."""
