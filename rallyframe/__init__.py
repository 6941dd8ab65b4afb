"""Spark jobs over per-frame detector rows of racket-sport video, keyed by video and frame."""
