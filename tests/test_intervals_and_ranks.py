import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from asofkit.operators import ordered, panels, pit, ranks

BASE = datetime(2024, 1, 1)


def versions(spark, n=3000):
    rng = random.Random(8)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), i, rng.choice([None, *[BASE + timedelta(hours=rng.randrange(400))] * 6]), float(i)) for i in range(n)]
    return spark.createDataFrame(rows, "key string, id int, available timestamp, value double"), rows


def winners(rows, at):
    out = {}
    for k, i, t, v in rows:
        if t is not None and t <= at:
            n, best = out.get(k, (0, None))
            out[k] = (n + 1, max(best, (t, i, v)) if best else (t, i, v))
    return {(k, at): (b[1], b[2], n) for k, (n, b) in out.items()}


def test_vintages_validity_and_instants(spark):
    df, rows = versions(spark)
    instants = [BASE + timedelta(hours=h) for h in (-5, 0, 3, 17, 18, 200, 399, 1000)]
    want = {k: v for at in instants for k, v in winners(rows, at).items()}
    got = pit.vintages(df, ["key"], "available", ["id"], instants)
    assert {(r["key"], r["as_of"]): (r["id"], r["value"], r["eligible_count"]) for r in got.collect()} == want and got.count() == len(want)
    assert pit.vintages(df, ["key"], "available", ["id"], []).count() == 0
    valid = pit.validity(df.repartition(6), ["key"], "available", ["id"])
    changes = sorted({(k, t) for k, _, t, _ in rows if t is not None}, key=lambda r: (r[0] or "", r[1]))
    made = sorted(((r["key"], r["valid_from"], r["valid_to"]) for r in valid.collect()), key=lambda r: (r[0] or "", r[1]))
    after = [b[1] if a[0] == b[0] else None for a, b in zip(changes, [*changes[1:], (0, 0)])]
    assert made == [(k, t, to) for (k, t), to in zip(changes, after)]
    asked = spark.createDataFrame([(a,) for a in [*instants, instants[2], None]], "as_of timestamp")
    known = pit.known_at(valid, asked, "as_of").collect()
    assert {(r["key"], r["as_of"]): (r["id"], r["value"], r["eligible_count"]) for r in known} == want and len(known) == len(want)
    one = pit.known_at(valid, asked.limit(5).where(F.col("as_of") == instants[3]), "as_of").collect()
    assert {(r["key"], r["as_of"]): (r["id"], r["value"], r["eligible_count"]) for r in one} == winners(rows, instants[3])
    assert pit.known_at(valid, asked.limit(0), "as_of").count() == 0


def test_vintages_rows_shrink_before_they_are_written_out(spark):
    df, _ = versions(spark)
    plan = pit.vintages(df, ["key"], "available", ["id"], [BASE, BASE + timedelta(hours=9)])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Window") < plan.index("Aggregate")  # from the top down


def test_next_rows(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "b", None]), i) for i in range(1000)]
    got = ordered.followed(spark.createDataFrame(rows, "g string, v int"), ["g"], [F.col("v").asc()], "v", "next").collect()
    for g in ("a", "b", None):
        vs = sorted(v for k, v in rows if k == g)
        assert sorted((r["v"], r["next"]) for r in got if r["g"] == g) == list(zip(vs, [*vs[1:], None]))


def section(spark, n=4000):
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 4 + ["small", "one-off" if i == 9 else "hot", None]), i, rng.choice([None, 0.5, 0.5, rng.random(), float(rng.randrange(30))])) for i in range(n)]
    return spark.createDataFrame(rows, "date string, member int, v double")


def same(a, b, columns):
    key = lambda r: tuple((x is None, x if x is not None else 0) if not isinstance(x, str) else (False, x) for x in r)
    x, y = (sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=repr) for df in (a, b))
    assert x == y and key


def test_ranks_buckets_and_percentiles_equal_windows(spark):
    df = section(spark)
    same(ranks.ordinal_rank(df, ["date"], "v", ["member"]), panels.ordinal_rank(df, ["date"], "v", "member"), ["date", "member", "rank"])
    known = df.where("v is not null")
    by_window = known.withColumn("average_rank", panels.average_rank("v", ["date"]))
    same(ranks.average_rank(df, ["date"], "v").where("v is not null"), by_window, ["date", "member", "average_rank"])
    same(ranks.quantile_buckets(df, ["date"], "v", ["member"], 7, 2).where("v is not null"), panels.quantile_buckets(known, ["date"], "v", "member", 7, 2), ["date", "member", "bucket"])
    exact = known.groupBy("date").agg(F.percentile("v", F.array(F.lit(0.05), F.lit(0.5), F.lit(1.0))).alias("p")).select("date", *[F.col("p")[i].alias(f"p{i}") for i in range(3)])
    same(ranks.percentiles(df, ["date"], "v", [0.05, 0.5, 1.0]), exact, ["date", "p0", "p1", "p2"])
    same(ranks.winsorize(df.where("date is not null"), ["date"], "v", 0.1, 0.9), panels.winsorize(df.where("date is not null"), ["date"], "v", 0.1, 0.9), ["date", "member", "winsorized"])
    none = df.limit(0)
    assert ranks.ordinal_rank(none, ["date"], "v", ["member"]).count() == ranks.average_rank(none, ["date"], "v").count() == ranks.percentiles(none, ["date"], "v", [0.5]).count() == 0
