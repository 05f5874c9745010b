"""Time and throughput of a query, as the result sink reports them."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Bytes of a value, and how many columns of it a tuple has: key and payload.
VALUE_BYTES, COLUMNS = 4, 2


@dataclass(frozen=True)
class Throughput:
    seconds: float
    tuples: int

    @property
    def tuples_per_s(self) -> float:
        return self.tuples / self.seconds

    @property
    def mb_per_s(self) -> float:
        return COLUMNS * VALUE_BYTES * self.tuples_per_s / 1e6


def run(df: DataFrame, tuples: int) -> Throughput:
    """Runs the whole of df, keeping nothing; tuples: the rows of both sides."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return Throughput(time.perf_counter() - began, tuples)
