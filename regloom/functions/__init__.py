"""Scalar expressions over programs and token sequences."""
