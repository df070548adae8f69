import random

from pyspark.sql import functions as F

from asofkit.operators import ordered


def rows(spark, n=3000):
    rng = random.Random(7)
    made = [(i, rng.choice(["a"] * 6 + ["b", "c", None]), rng.randrange(40) or None, rng.randrange(9)) for i in range(n)]
    return spark.createDataFrame(made, "id int, g string, v int, place int"), made


def first(v):
    return (v is not None, v or 0)


def test_places_over_all_rows_and_in_groups(spark):
    df, made = rows(spark)
    got = {r["id"]: r["place"] for r in ordered.numbered(df.repartition(5), [F.col("v").asc(), F.col("id").desc()]).collect()}
    want = sorted(made, key=lambda r: (first(r[2]), -r[0]))
    assert got == {r[0]: i for i, r in enumerate(want)}
    got = {r["id"]: r["place"] for r in ordered.numbered(df.repartition(5), [F.col("v").asc(), F.col("id").desc()], within=["g"]).collect()}
    for g in ("a", "b", "c", None):
        assert [got[r[0]] for r in want if r[1] == g] == list(range(sum(r[1] == g for r in made)))


def test_running_sums(spark):
    df, made = rows(spark)
    got = {r["id"]: (r["total"], r["place"]) for r in ordered.running(df, [F.col("v").asc(), F.col("id").asc()], {"total": F.col("v"), "place": F.lit(1)}).collect()}
    total = 0
    for i, r in enumerate(sorted(made, key=lambda r: (first(r[2]), r[0]))):
        assert got[r[0]] == (total, i)
        total += r[2] or 0


def test_no_rows(spark):
    df = rows(spark)[0].limit(0)
    assert ordered.numbered(df, [F.col("v")]).count() == ordered.numbered(df, [F.col("v")], within=["g"]).count() == ordered.running(df, [F.col("v")], {"s": F.col("v")}).count() == 0
