"""Operators for preparing training data for language models; nothing else in the package imports this one."""
