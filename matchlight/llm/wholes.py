"""Vectors scaled to whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = float(2**53)


def scaled(values, scale: float, offset: int) -> bytes | None:
    if values is None:
        return None
    x = np.asarray(values, dtype=np.float64)
    if not len(x) or not np.isfinite(x).all():
        return None
    return (np.clip(np.floor(x * scale), -LARGEST, LARGEST).astype("<i8") + offset).tobytes()


def whole_numbers(vector: Column, scale: float, offset: int = 0) -> Column:
    """floor(scale * c) + offset for every component c, as 8-byte little-endian numbers.

    NULL for a vector that is NULL or empty or has NULL or non-finite components. Products beyond
    2^53 either way stay there.
    """

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in series:
            yield pd.Series([scaled(v, scale, offset) for v in values], dtype=object)

    return F.pandas_udf(run, "binary")(vector)


def matrix(data) -> np.ndarray:
    """Rows of equal length as one table."""
    return np.frombuffer(b"".join(data), dtype="<i8").reshape(len(data), -1)
