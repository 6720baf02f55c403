"""Scalar pieces: random dummies and solver kernels."""
