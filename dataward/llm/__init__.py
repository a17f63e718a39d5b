"""Operators that prepare text for training language models; nothing outside this folder imports it."""
