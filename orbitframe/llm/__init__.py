"""Operators of a training-data pipeline over documents, pages, vectors and chats.

Nothing else in the library imports this package.
"""
