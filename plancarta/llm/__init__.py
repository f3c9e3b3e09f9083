"""Operators that prepare text corpora; nothing outside this folder imports it."""
