"""Functions of native libraries, called on Arrow batches through their C interface (survey Y05)."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def foreign(library: str, symbol: str, arguments: int = 1) -> Callable[..., Column]:
    """A function of doubles in a shared library (a name like "m", or a path that executors have) as a column function.

    Each batch opens the library once and hands value by value over; nulls stay null.
    """

    def loaded() -> Callable:
        found = ctypes.CDLL(ctypes.util.find_library(library) or library)
        f = getattr(found, symbol)
        f.argtypes, f.restype = [ctypes.c_double] * arguments, ctypes.c_double
        return np.vectorize(f, otypes=[np.float64])

    @pandas_udf("double")
    def call(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        f = loaded()
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)  # of one argument there is no tuple
            values = [c.to_numpy(np.float64, na_value=np.nan) for c in columns]
            known = ~np.any([c.isna().to_numpy() for c in columns], axis=0)
            out = np.full(len(known), np.nan)
            if known.any():
                out[known] = f(*[v[known] for v in values])
            yield pd.Series(out).where(known, None)

    return call
