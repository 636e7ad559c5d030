"""Operators over edge lists, frames and posts."""
