"""Operators that prepare large text corpora for model training.

Nothing outside this folder imports it; ``queries`` holds what the driver runs.
"""
