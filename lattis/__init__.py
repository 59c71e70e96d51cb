"""Sparse-matrix analytics on Spark: matrices and vectors are DataFrames, kernels are queries."""

from .model import Matrix, Shape

__all__ = ["Matrix", "Shape"]
