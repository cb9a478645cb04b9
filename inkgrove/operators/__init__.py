"""Relational operators over notes, folders, images and libraries."""
