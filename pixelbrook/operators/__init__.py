"""Operators on tables of pixels, frames and files."""
