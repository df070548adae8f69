import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from asofkit.operators import pit
from asofkit.streaming import knowledge

BASE = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def stateful(spark):
    for k, v in knowledge.STATE_STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k in knowledge.STATE_STORE:
        spark.conf.unset(k)


def streamed(spark, tmp_path, batches, schema, delay="30 minutes"):
    """Each batch is a file; one file a trigger, in order."""
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        for f in source.glob("part-*.parquet"):
            import os

            os.utime(f, (1e9 + i, 1e9 + i)) if f.stat().st_mtime > 1.1e9 else None
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = knowledge.corrections(stream, ["k"], "at", ["id"], "v", delay)
    q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out"))


def test_shuffled_arrival_gives_the_batch(stateful, tmp_path):
    rng = random.Random(11)
    rows = [(rng.choice(["hot", "hot", "a", None]), i, BASE + timedelta(minutes=i // 4 * 3, microseconds=rng.choice([0, 0, 7])), rng.choice([1.0, 2.0, None])) for i in range(160)]
    arrived = sorted(rows, key=lambda r: r[2] + timedelta(minutes=rng.uniform(0, 28)))  # later by less than the delay
    end = [("end", 10_000, BASE + timedelta(days=9), 0.0)]
    schema = "k string, id int, at timestamp, v double"
    got = streamed(stateful, tmp_path, [arrived[:60], arrived[60:110], arrived[110:], end, end], schema)
    batch = pit.validity(stateful.createDataFrame(rows, schema), ["k"], "at", ["id"]).select("k", "valid_from", F.col("v").alias("value"), "eligible_count")
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert order(got.where("k is null or k <> 'end'").select("k", "valid_from", "value", "eligible_count")) == order(batch)
    for k in ("hot", "a", None):
        mine = got.where(F.col("k").eqNullSafe(F.lit(k))).orderBy("valid_from").collect()
        assert [r["previous"] for r in mine] == [None, *[r["value"] for r in mine[:-1]]]
        assert [r["kind"] for r in mine] == ["first", *["confirmation" if a["value"] == b["value"] else "correction" for a, b in zip(mine, mine[1:])]]


def test_keys_share_state_and_stay_exact(stateful, tmp_path):
    big = 2**60
    schema = "k long, id int, at timestamp, v double"
    rows = [(k, i, BASE + timedelta(minutes=i, microseconds=i), float(i // 2)) for k in (big, big + 1, None, -1, *range(40)) for i in range(4)]
    out = streamed(stateful, tmp_path, [rows[::2], rows[1::2], [(-5, 9, BASE + timedelta(days=9), 0.0)]], schema)
    got = sorted(map(tuple, out.select("k", "valid_from", "value", "previous", "kind", "eligible_count").collect()), key=str)
    kinds = ["first", "confirmation", "correction", "confirmation"]
    assert got == sorted(((k, at, v, None if i == 0 else float((i - 1) // 2), kinds[i], i + 1) for k, i, at, v in rows), key=str)
    # one row of state for some keys together, not a row and a call for each key or instant
    held = knowledge.corrections(stateful.readStream.schema(schema).parquet(str(tmp_path / "in")), ["k"], "at", ["id"], "v", "1 minute")
    assert "_bucket" in held._jdf.queryExecution().analyzed().toString()
