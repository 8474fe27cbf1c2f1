"""Sequence-corpus analytics and training-data operators as Spark plans."""
