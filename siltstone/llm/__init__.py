"""Operators for training data from documents; nothing outside this subpackage imports it."""
