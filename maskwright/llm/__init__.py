"""Operators for preparing scrubbed texts and chats as training data.

Nothing else in the library imports this package.
"""
