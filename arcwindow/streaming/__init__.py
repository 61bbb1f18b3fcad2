"""Counts over corpora that arrive file by file."""
