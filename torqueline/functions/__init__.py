"""Scalar kernels: text, scores, similarity."""
