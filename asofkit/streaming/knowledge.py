"""Point-in-time knowledge kept up to date by a stream of observations."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """stream with its watermark; times without a zone are taken in the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def observations(stream: DataFrame, id_col: str, time: str, delay: str) -> DataFrame:
    """Each observation once, whatever is delivered again within the delay."""
    return _timed(stream, time, delay).dropDuplicatesWithinWatermark([id_col])


def latest(stream: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str], value: str) -> DataFrame:
    """Running state by key: the value of latest availability and how many were seen (for update or complete output)."""
    best = F.max(F.struct(time, *ties, value)).alias("best")
    return stream.groupBy(*keys).agg(best, F.count("*").alias("eligible_count")).select(*keys, *[F.col("best")[c].alias(c) for c in (time, *ties, value)], "eligible_count")


def windowed(stream: DataFrame, keys: Sequence[str], time: str, value: str, width: str, delay: str) -> DataFrame:
    """Sums of tumbling windows, closed once the watermark passes them."""
    return _timed(stream, time, delay).groupBy(F.window(time, width), *keys).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


CORRECTIONS = "valid_from timestamp, value double, previous double, kind string, eligible_count bigint"


def _keeper(keys: Sequence[str], time: str, ties: Sequence[str], value: str) -> Callable[[tuple, Iterable[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    names = [*keys, "valid_from", "value", "previous", "kind", "eligible_count"]

    def keep(bucket: tuple, rows: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """A bucket's keys with the value that stands and how many rows it is from; the instants that the watermark has not passed with winner and number of rows."""
        known, stands, seen, waiting, instants, values, counts, *held = state.get if state.exists else [[] for _ in range(7 + len(ties))]
        last = dict(zip(map(tuple, known), zip(stands, seen, strict=True), strict=True))
        pending = {(tuple(k), at): [(tuple(tie), v), n] for k, at, v, n, *tie in zip(waiting, instants, values, counts, *held, strict=True)}
        for batch in rows:
            at = (batch[time].astype("datetime64[us]").astype("int64")).tolist()
            for k, v, *tie in zip(zip(zip(*[batch[c].tolist() for c in keys], strict=True), at, strict=True), batch[value].tolist(), *[batch[t].tolist() for t in ties], strict=True):
                mine, old = (tuple(tie), v), pending.get(k)
                pending[k] = [mine, 1] if old is None else [max(old[0], mine, key=_order), old[1] + 1]
        passed, out = state.getCurrentWatermarkMs(), []
        for k, at in sorted((p for p in pending if _due(p[1]) <= passed), key=lambda p: p[1]):
            (_, v), n = pending.pop((k, at))
            before, total = last.get(k, (None, 0))
            kind = "first" if k not in last else "confirmation" if v == before or _none(v) and _none(before) else "correction"
            last[k] = v, total + n
            out.append((*k, pd.Timestamp(at, unit="us"), v, before, kind, total + n))
        won = [w for w, _ in pending.values()]
        standing = [*last], [v for v, _ in last.values()], [n for _, n in last.values()]
        state.update((*standing, [k for k, _ in pending], [at for _, at in pending], [v for _, v in won], [n for _, n in pending.values()], *[[tie[i] for tie, _ in won] for i in range(len(ties))]))
        if pending:  # a timeout comes once the watermark is greater
            state.setTimeoutTimestamp(max(_due(min(at for _, at in pending)) - 1, passed, 1))
        if out:
            yield pd.DataFrame(out, columns=names)

    return keep


def _texts(keys: Sequence[str], kinds: dict[str, str]) -> tuple[list[Column], list[Column]]:
    """Keys as texts, which null whole numbers pass through pandas as, and back again."""
    there = {"timestamp": lambda c: F.unix_micros(c).cast("string"), "binary": F.hex}
    back = {"timestamp": lambda c: F.timestamp_micros(c.cast("bigint")), "binary": F.unhex}
    return [there.get(kinds[k], lambda c: c.cast("string"))(F.col(k)).alias(k) for k in keys], [back.get(kinds[k], lambda c, k=k: c.cast(kinds[k]))(F.col(k)).alias(k) for k in keys]


def _none(v: float | None) -> bool:
    return v is None or v != v


def _order(won: tuple) -> tuple:
    """Winners in order of their ties, nulls first; of equal ties the greater value (a missing one last)."""
    tie, v = won
    none = _none(v)
    return (tuple((False,) if t is None or t != t else (True, t) for t in tie), not none, 0.0 if none else v)


def _due(at: int) -> int:
    """The first whole millisecond of the watermark at which no more rows of an instant (in microseconds) can come."""
    return at // 1000 + 1


def corrections(stream: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str], value: str, delay: str, buckets: int = 1024) -> DataFrame:
    """What was known of each key, version by version: a row once the watermark has passed an instant at which its value became known.

    keys, valid_from, value, previous (the value that stood until then), kind (first, correction, or confirmation of the same value) and eligible_count (rows
    known so far). Rows of one instant are reduced to the winner of the greatest ties. Within the delay rows may come in any order: the result is that of the
    batch (`pit.validity`). State holds the instants within the delay, one winner each, and one value for each key; nothing of closed instants stays.
    Keys are kept together in buckets by their hash, a row of state each, so that neither a row nor a key costs a call of its own: a trigger reads and writes the
    state of the buckets that it meets. Choose `buckets` for some thousand keys each; it stays as it is for the life of a checkpoint. Keys are of plain types.
    Rows without a time, or later than the watermark, are left out, as in every stateful operation of a stream. For append
    output; `STATE_STORE` keeps the state outside the heap."""
    kept = _timed(stream.select(*keys, time, *ties, F.col(value).cast("double").alias(value)).where(F.col(time).isNotNull()), time, delay)
    kinds = dict(kept.dtypes)
    there, back = _texts(keys, kinds)
    bucket = F.pmod(F.xxhash64(*there), F.lit(buckets)).alias("_bucket")
    ended = ", ".join(["known array<array<string>>, stands array<double>, seen array<bigint>, waiting array<array<string>>, at array<bigint>, value array<double>, n array<bigint>", *[f"tie{i} array<{kinds[t]}>" for i, t in enumerate(ties)]])
    out = ", ".join([*[f"`{k}` string" for k in keys], CORRECTIONS])
    grouped = kept.select(bucket, *there, time, *ties, value).groupBy("_bucket")
    made = grouped.applyInPandasWithState(_keeper(keys, time, ties, value), out, ended, "append", GroupStateTimeout.EventTimeTimeout)
    return made.select(*back, *[c for c in made.columns if c not in keys])


#: Settings for `corrections` over many keys.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
