"""Operators for preparing training text: quality, dialogue, leaks, toxicity, language, HTML, joins, packing, archives and lines."""
