"""Streams of commits. An extension: batches give the same figures."""
