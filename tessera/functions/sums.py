"""Sums of numpy blocks over all rows: each task adds up its own, Spark adds the tasks'."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .local import CELLS, TooLarge

#: Numbers of a row between tasks.
SLICE = 4096


def block_sums(rows: DataFrame, kernel: Callable[[pd.DataFrame], np.ndarray], size: int, what: str) -> np.ndarray:
    """The sum of kernel(rows) over the batches of all rows, `size` numbers that must not depend on their count.

    A task sends its sum in slices; a slice of all tasks meets in one place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                total += kernel(pdf)
        yield pd.DataFrame({"part": range(0, size, SLICE), "v": [total[i : i + SLICE].tolist() for i in range(0, size, SLICE)]})

    def add(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "v": [np.sum(np.stack(own["v"].to_numpy()), axis=0).tolist()]})

    if size > CELLS:
        raise TooLarge(f"{what}: {size} numbers are more than the driver takes ({CELLS})")
    parts = rows.mapInPandas(run, "part long, v array<double>").groupBy("part").applyInPandas(add, "part long, v array<double>")
    found = parts.toPandas().sort_values("part")  # size / SLICE rows
    return np.concatenate([np.asarray(v, float) for v in found["v"]]) if len(found) else np.zeros(size)
