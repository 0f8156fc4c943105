"""A model that may say which known name a text means; whatever else it says is refused."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricspark.operators import numbers

Ask = Callable[[list[str]], list[str | None]]


def answered(texts: DataFrame, ask: Ask, text_col: str = "text", batch: int = 32, in_flight: int = 4, seconds: float = 8.0) -> DataFrame:
    """(text, said): what ``ask`` says of each distinct text; null if it says nothing, fails, or takes longer than ``seconds`` for its call.

    A call has at most ``batch`` texts, and a task at most ``in_flight`` calls at once. A text
    is asked about once however many rows have it; null and empty ones aren't. A task that
    is run again asks again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = ThreadPoolExecutor(in_flight)
        waiting: list[tuple[list[str], Future, float]] = []

        def first() -> pa.RecordBatch:
            own, future, began = waiting.pop(0)
            try:
                said = list(future.result(max(0.0, began + seconds - time.monotonic())))
            except Exception:  # whatever a model's caller raises, or that it takes too long: no answer
                said = []
            said = said if len(said) == len(own) else [None] * len(own)
            return pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([s if isinstance(s, str) else None for s in said], pa.string())], names=["text", "said"])

        for b in batches:
            rows = b.column(0).to_pylist()
            for i in range(0, len(rows), batch):
                if len(waiting) == in_flight:
                    yield first()
                own = rows[i : i + batch]
                waiting.append((own, pool.submit(ask, own), time.monotonic()))
        while waiting:
            yield first()
        pool.shutdown(wait=False, cancel_futures=True)

    distinct = texts.filter(F.length(text_col) > 0).select(F.col(text_col).alias("text")).distinct()
    return distinct.mapInArrow(run, "text string, said string")


def guesses(texts: DataFrame, names: DataFrame, ask: Ask, text_col: str = "text", **limits) -> DataFrame:
    """(text, guess): the known name that ``ask`` takes a text to mean, once blanks are evened out; texts of which it says no known name are left out."""
    known = names.select(F.col("alias").alias("guess")).distinct()
    return answered(texts, ask, text_col, **limits).select("text", numbers.normalised(F.col("said")).alias("guess")).join(F.broadcast(known), "guess", "left_semi")  # as many as definitions have names
