"""Motifloom: token-sequence pattern analytics, expressed as Spark plans."""

__version__ = "0.1.0"
