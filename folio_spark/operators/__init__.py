"""Operators over listings, shelves, chapters, pages and knowledge tables."""
