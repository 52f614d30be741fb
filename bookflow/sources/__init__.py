"""Readers that turn books, pages and word lists into tables."""
