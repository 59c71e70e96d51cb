"""Column formulas: bandwidth, throughput, footprints, means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOAT, INT = 4, 4  # bytes that the formulas count for a value and an index


def _rate(amount: Column, seconds: Column) -> Column:
    """Units of 1e9 per second; infinite for no time."""
    t = seconds.cast("double")
    return F.when(t == 0, F.lit(float("inf"))).otherwise(amount.cast("double") / 1e9 / F.when(t != 0, t))


def bandwidth_coo(n_row: Column, n_col: Column, nnz: Column, seconds: Column) -> Column:
    return _rate(nnz * (2 * INT + FLOAT) + n_col * FLOAT + n_row * FLOAT, seconds)


def bandwidth_csr(n_row: Column, nnz: Column, seconds: Column) -> Column:
    """x is charged once per entry, so its length does not count."""
    return _rate(nnz * (FLOAT + INT + FLOAT) + (n_row + 1) * INT + n_row * FLOAT, seconds)


def gflops(nnz: Column, seconds: Column) -> Column:
    return _rate(nnz * 2, seconds)


def footprint_1d_root(n_row: Column, n_col: Column, nnz: Column, parts: Column, part_rows: Column, part_nnz: Column) -> tuple[Column, Column]:
    """Host and device bytes of the rank that reads and deals; part sums are over all parts."""
    dealt = (part_rows + parts) * 8 + (part_nnz + parts) * 8
    host = parts * 24 + parts * 8 + parts * 8 + dealt + n_row * 12 + parts * 8
    return host, n_col * 4 + (n_row + 1) * 4 + nnz * 8 + n_row * 8


def footprint_1d(n_row: Column, n_col: Column, parts: Column, rows: Column, nnz: Column) -> tuple[Column, Column]:
    """Host and device bytes of another rank with its own rows and entries."""
    index = (rows + 1) * 4 + nnz * 8
    return index + rows * 4 + n_row * 4 + parts * 4 + n_col * 4, index + n_col * 4 + rows * 4


def footprint_2d(n_row: Column, grid_rows: Column, grid_cols: Column, rows: Column, cols: Column, nnz: Column) -> tuple[Column, Column]:
    index = (rows + 1) * 4 + nnz * 4 + nnz * 8
    host = index + n_row * 32 + rows * 4 + (grid_rows + grid_cols) * 8 + rows * 4 + grid_rows * grid_cols * 8 + n_row * 4
    return host, (rows + 1) * 4 + nnz * 8 + cols * 4 + rows * 4


def arithmetic_mean(v: Column) -> Column:
    return F.sum(v) / F.count(v)


def geometric_mean(v: Column) -> Column:
    """Values that are not positive count in the number of values, as a factor of 1."""
    return F.exp(F.sum(F.when(v > 0, F.ln(v)).otherwise(0.0)) / F.count(v))


def spread(v: Column, mean: Column) -> Column:
    """Mean squared distance from a given mean (no root)."""
    return F.sum(F.pow(v - mean, F.lit(2.0))) / F.count(v)
