"""What the text operators share: inputs, batches, the shared folder, a bounded memo."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import released, shared_dir, written  # noqa: F401  (for the operators)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone, null texts as empty ones; other columns cannot clash later."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


#: Of a batch that Spark sends to a Python task. By rows alone, a task's whole split of texts is one batch, held several times over in the JVM and in Python.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Limit the bytes of the batches of this session's Python tasks, which else have up to 10,000 rows; a lower limit stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(key, None)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _bytes(size: str | None) -> int:
    """A size as Spark's settings write it; none, zero and less mean no limit."""
    found = re.fullmatch(r"(\d+)([kmgtp]?)(?:i?b)?", (size or "").strip().lower())
    return (int(found[1]) << 10 * " kmgtp".index(found[2] or " ") if found else 0) or 1 << 62


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The rows of a task's batches, few at a time, so that neither what is made of thousands of texts nor what is given back of them is held at once. Before and
    after them, freed memory goes back to the system: a Python worker is used again by later tasks and stages, also of other operators."""
    pools = (pa.default_memory_pool(), pa.system_memory_pool())
    for pool in pools:
        pool.release_unused()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    for pool in pools:
        pool.release_unused()


class Memo(dict):
    """Results of a pure function by word, at most `limit` of them: when half of that is full, words not asked for since the last time are forgotten."""

    def __init__(self, function: Callable, limit: int):
        super().__init__()
        self.function, self.half, self.older = function, max(1, limit // 2), {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


_KEPT: dict = {}


def once(key, make: Callable):
    """make() once in each Python worker; workers are used again by later tasks. Keeps the newest few."""
    if key not in _KEPT:
        while len(_KEPT) >= 4:
            _KEPT.pop(next(iter(_KEPT)))
        _KEPT[key] = make()
    return _KEPT[key]
