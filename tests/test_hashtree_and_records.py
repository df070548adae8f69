import hashlib
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from asofkit.sources import hashtree, store
from asofkit.streaming import records


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def full(ids, depth):
    level = {}
    for h in sorted({sha(i) for i in ids if i is not None}):
        level.setdefault(h[:depth], []).append(h)
    level = {p: sha("".join(hs)) for p, hs in level.items()}
    for d in range(depth - 1, -1, -1):
        up = {}
        for p in sorted(level):
            up.setdefault(p[:d], []).append(p + level[p])
        level = {p: sha("".join(parts)) for p, parts in up.items()}
    return "sha256:" + level[""]


def test_growth_gives_the_root_of_the_full_tree(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b", None]), str(i)) for i in range(600)] + [("a", None)]
    make = lambda part: spark.createDataFrame(part, "g string, id string")
    new = rows[500:] + rows[:40] + [("new", "1")]
    old = hashtree.tree(make(rows[:500]), ["g"], "id", 3)
    made = hashtree.grown(old, make(rows[:500]), make(new), ["g"], "id", 3).persist()
    want = {g: full([i for k, i in [*rows, ("new", "1")] if k == g], 3) for g in ("a", "b", "new", None)}
    assert {r["g"]: r["root"] for r in hashtree.roots(made, ["g"]).collect()} == want
    again = hashtree.tree(make([*rows, ("new", "1")]).repartition(5), ["g"], "id", 3)
    key = lambda df: sorted(map(tuple, df.drop("changed").collect()), key=str)
    assert key(made) == key(again)
    fresh = {(g, sha(i)[:d]) for g, i in [*rows[500:], ("new", "1")] if i for d in range(4)}
    assert {(r["g"], r["prefix"]) for r in made.where("changed").collect()} == fresh
    same = hashtree.grown(made, make(rows), make(rows[:9]), ["g"], "id", 3)  # ids that are there
    assert same.where("changed").count() == 0 and key(same) == key(made)
    assert hashtree.tree(make([("a", None)]), ["g"], "id", 3).count() == 0


def test_proofs(spark):
    corpus = spark.createDataFrame([("a", str(i)) for i in range(300)] + [(None, "7")], "g string, id string")
    nodes = hashtree.tree(corpus, ["g"], "id", 2)
    asked = spark.createDataFrame([("a", "5"), ("a", "299"), ("a", "300"), (None, "7"), (None, "8"), ("other", "1")], "g string, id string")
    root = hashtree.roots(nodes, ["g"])
    made = hashtree.proofs(nodes, corpus, asked, ["g"], "id", 2).persist()
    got = {(r["g"], r["id"]): r["proven"] for r in hashtree.proven(made, root, ["g"], 2).collect()}
    assert got == {("a", "5"): True, ("a", "299"): True, ("a", "300"): False, (None, "7"): True, (None, "8"): False, ("other", "1"): False}
    forged = made.withColumn("parts", F.when(F.col("level") == 2, F.array_append("parts", F.struct(F.sha2("id", 256).alias("at"), F.lit("").alias("hash")))).otherwise(F.col("parts")))
    assert not any(r["proven"] for r in hashtree.proven(forged, root, ["g"], 2).collect())


def test_pins_stop_a_run(spark):
    corpora = spark.createDataFrame([("m", "a", "sha256:1", 3), ("m", "b", "sha256:2", 4), ("f", "a", "sha256:3", 5)], "kind string, c string, root string, n bigint")
    whole = {r["kind"]: (r["root"], r["n"], r["corpora"]) for r in hashtree.pin(corpora.repartition(3), ["c"], ["kind"]).collect()}
    assert whole["m"] == ("sha256:" + sha('{"c":"a"}=sha256:1\n{"c":"b"}=sha256:2'), 7, 2) and whole["f"][1:] == (5, 1)
    assert hashtree.verified(corpora, corpora, ["kind", "c"]).count() == 3
    with pytest.raises(PySparkException, match="pin does not match"):
        hashtree.verified(corpora.where("c <> 'b'"), corpora, ["kind", "c"]).collect()


SCHEMA = "record_id string, payload string, extra int"


def test_epochs_write_once(spark, tmp_path):
    path = str(tmp_path / "store")
    make = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    read = lambda: sorted(map(tuple, records.records(spark, path, make().schema).collect()))
    assert read() == []
    first = records.commit(make(("a", "1", 1), ("b", "2", 2), ("a", "1", 1)), 0, path)
    assert (first["records"], first["written"], first["replayed"]) == (2, 2, False)
    again = records.commit(make(("b", "2", 2), ("a", "1", 1)), 0, path)
    assert again["replayed"] and read() == [("a", "1", 1, 0), ("b", "2", 2, 0)]
    with pytest.raises(ValueError, match="other records"):
        records.commit(make(("c", "2", 2)), 0, path)
    for clash in ((("b", "3", 2),), (("x", "1", 1), ("x", "2", 1))):  # with the table; within the batch
        with pytest.raises(PySparkException, match="another payload"):
            records.commit(make(("new", "1", 1), *clash), 1, path)
        assert read() == [("a", "1", 1, 0), ("b", "2", 2, 0)]
    with pytest.raises(PySparkException, match="without id"):
        records.commit(make((None, "1", 1)), 1, path)
    make(("half", "1", 1)).write.mode("overwrite").parquet(f"{path}/data/epoch=1")  # a writer was lost before its commit
    assert read() == [("a", "1", 1, 0), ("b", "2", 2, 0)]
    assert records.commit(make(("b", "2", 2), ("c", "3", 3)), 1, path)["written"] == 1
    assert read() == [("a", "1", 1, 0), ("b", "2", 2, 0), ("c", "3", 3, 1)]
    assert records.commit(make(), 2, path)["written"] == 0


def test_stream_that_starts_again_writes_nothing_twice(spark, tmp_path):
    rows = store.with_id(spark.range(50).withColumn("v", F.col("id") % 7), "rec", ["v"])
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    path = str(tmp_path / "store")
    for checkpoint in ("one", "one", "two"):  # the same stream twice, then one that has lost its checkpoint
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).drop("id")
        q = records.sink(stream, path, str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    got = records.records(spark, path, rows.drop("id").schema).collect()
    assert sorted(r["v"] for r in got) == list(range(7)) and {r["epoch"] for r in got} == {0}


def test_digests_are_shuffled_once(spark):
    ids = spark.range(500).select((F.col("id") % 2).alias("g"), F.col("id").cast("string").alias("id"))
    nodes = hashtree.tree(ids.unionByName(ids), ["g"], "id", 3)
    blocks = nodes.where("level = 3")
    assert blocks._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = {}
    for i in range(500):
        h = hashlib.sha256(str(i).encode()).hexdigest()
        want.setdefault((i % 2, h[:3]), []).append(h)
    assert {(r["g"], r["prefix"]): (r["hash"], r["n"]) for r in blocks.collect()} == {k: (hashlib.sha256("".join(sorted(v)).encode()).hexdigest(), len(v)) for k, v in want.items()}
