"""Operators for preparing training text, and their queries; nothing else in the library imports them."""
