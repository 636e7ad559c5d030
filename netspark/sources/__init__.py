"""Readers of edge tables."""
