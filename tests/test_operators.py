from datetime import datetime as T

import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F
from pytest import approx

from asofkit.functions import scalars as s
from asofkit.operators import backtest, panels, pit, research, series, sets


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# point in time


FACTS = "key string, fact int, value double, known timestamp, status string"


@pytest.fixture
def facts(spark):
    return spark.createDataFrame([("a", 1, 1.0, T(2024, 1, 1), "verified"), ("a", 2, 2.0, T(2024, 1, 10), "derived"), ("a", 3, 3.0, T(2024, 1, 10), "derived"), ("a", 4, 4.0, None, "derived"), ("a", 5, 5.0, T(2024, 1, 11), "verified"), ("b", 6, 6.0, T(2024, 1, 2), "unknown")], FACTS)


def test_latest_as_of_is_inclusive_and_fails_closed(facts):
    found = pit.latest_as_of(facts, ["key"], "known", ["fact"], T(2024, 1, 10), "status")
    assert rows(found.select("key", "fact", "eligible_count")) == [("a", 3, 3)]


def test_revised_is_as_of_the_frontier(facts):
    assert rows(pit.revised(facts, ["key"], "known", ["fact"], "status").select("key", "fact")) == [("a", 5)]


def test_vintages_equal_one_query_for_each_instant(facts):
    instants = [T(2024, 1, 1), T(2024, 1, 5), T(2024, 1, 10), T(2024, 2, 1)]
    several = rows(pit.vintages(facts, ["key"], "known", ["fact"], instants).select("as_of", "key", "fact"), "as_of", "key")
    single = [(t, *r) for t in instants for r in rows(pit.latest_as_of(facts, ["key"], "known", ["fact"], t).select("key", "fact"), "key")]
    assert several == single


def test_nothing_is_known_of_an_empty_table(spark):
    empty = spark.createDataFrame([], FACTS)
    assert pit.latest_as_of(empty, ["key"], "known", ["fact"], T(2024, 1, 1)).count() == 0
    assert pit.revised(empty, ["key"], "known", ["fact"]).count() == 0


def test_asof_join(spark):
    left = spark.createDataFrame([("a", 5), ("a", 2), ("a", 1), ("b", 5), ("a", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20.0), ("a", 4, 40.0), ("a", 5, 50.0), ("a", None, 9.0)], "k string, d int, v double")
    assert rows(pit.asof_join(left, right, ["k"], "t", "d", ["v"]), "k", "t") == [("a", 1, None, None), ("a", 2, 2, 20.0), ("a", 5, 5, 50.0), ("a", 5, 5, 50.0), ("b", 5, None, None)]
    assert rows(pit.asof_join(left, right, ["k"], "t", "d", ["v"], strict=True).select("t", "v").where("k = 'a'"), "t") == [(1, None), (2, None), (5, 40.0), (5, 40.0)]


def test_policies_cover_half_open_eras(spark):
    df = spark.createDataFrame([(1, "10-K"), (5, "10-K"), (5, "8-K"), (9, "10-K")], "t int, form string")
    policies = [("old", 0, 5, ("*",)), ("new", 5, None, ("10-K",)), ("twice", 9, None, ("*",))]
    assert rows(pit.policy_join(df, policies, "t", "form"), "t", "form") == [(1, "10-K", "derived", "old"), (5, "10-K", "derived", "new"), (5, "8-K", "unknown", None), (9, "10-K", "ambiguous", None)]


# sets


def test_filter_chain_tells_the_first_reason(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 1.0)], "id int, v double")
    assert rows(sets.filter_chain(df, ("value", F.col("v") > 2), ("id", F.col("id") > 1)).select("id", "excluded_by"), "id") == [(1, "id"), (2, "value"), (3, "value")]


def test_later_evidence_keeps_unknown(spark):
    a, b = (spark.createDataFrame(x, "k string, t int") for x in ([("x", 1), ("y", 2)], [("x", 3), ("y", None)]))
    assert rows(sets.later_evidence(a, b, "k", "t"), "k") == [("x", 3), ("y", None)]


def test_names_that_are_ambiguous_or_unknown(spark):
    names = spark.createDataFrame([("acme",), ("beta",), ("none",), (None,)], "n string")
    directory = spark.createDataFrame([("acme", 1), ("acme", 1), ("beta", 2), ("beta", 3)], "n string, id int")
    assert rows(sets.resolve_names(names, directory, "n", "id").select("n", "status", "id"), F.asc_nulls_last("n")) == [("acme", "resolved", 1), ("beta", "ambiguous", None), ("none", "not_found", None), (None, "not_found", None)]


# panels


@pytest.fixture
def balances(spark):
    return spark.createDataFrame([("a", i, v) for i, v in enumerate([100.0, 150.0, 0.0, 25.0, None, 30.0])], "k string, t int, v double")


def test_growth_tells_why_it_is_undefined(balances):
    found = rows(panels.growth(balances, ["k"], "t", "v").select("t", "growth.value", "growth.reason"), "t")
    assert found == [(0, None, "missing_input"), (1, 0.5, None), (2, -1.0, None), (3, None, "divide_by_zero"), (4, None, "missing_input"), (5, None, "missing_input")]


def test_windows_over_time(balances):
    df = panels.level_vs_history(panels.trailing_sum(panels.average_balance(balances, ["k"], "t", "v"), ["k"], "t", "v"), ["k"], "t", "v", n=2)
    assert rows(df.select("average", "ttm", "level"), "t") == [(None, None, None), (125.0, None, None), (75.0, None, -125.0), (12.5, 275.0, -50.0), (None, None, None), (None, None, 5.0)]


def test_forward_returns_need_a_base_above_zero(balances):
    assert rows(panels.forward_return(balances, ["k"], "t", "v").select("fwd"), "t") == [(0.5,), (-1.0,), (None,), (None,), (None,), (None,)]


def test_portfolios_need_two_rows_a_bucket(spark):
    df = spark.createDataFrame([(t, i, float(i), i / 10) for t, n in ((1, 7), (2, 8)) for i in range(n)], "t int, m int, s double, r double")
    found = rows(panels.long_short(df, ["t"], "s", "m", "r", 4), "t")
    assert found[0] == (1, None, None, None, "INSUFFICIENT_MEMBERS") and found[1][:4] == (2, approx(0.65), approx(0.05), approx(0.6))
    empty = panels.bucket_means(spark.createDataFrame([(1, 0, 2.0)], "t int, b long, r double"), ["t"], "b", "r", 2)
    assert rows(empty, "b") == [(1, 0, 1, 2.0, None), (1, 1, 0, None, "EMPTY_BUCKET")]


def test_complete_cases_count_what_they_drop(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 1.0), (None, None), (1.0, None)], "a double, b double")
    kept, counts = panels.complete_cases(df, ["a", "b"])
    assert kept.count() == 1 and tuple(counts.first()) == (4, 1, 2, 1)


def test_transforms_across_members(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 3.0), ("c", 1.0), ("d", None)], "m string, v double").withColumn("t", F.lit(1))
    df = panels.minmax(panels.ordinal_rank(df, ["t"], "v", "m"), ["t"], "v")
    assert rows(df.select("m", "rank", "minmax"), "m") == [("a", 2, 0.5), ("b", 3, 1.0), ("c", 1, 0.0), ("d", None, None)]
    flat = spark.createDataFrame([(1, 5.0), (1, 5.0)], "t int, v double")
    assert rows(panels.zscore(panels.minmax(flat, ["t"], "v"), ["t"], "v").select("minmax", "zscore")) == [(None, None)] * 2


def test_quantile_buckets_are_floors_not_ntiles(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(10)], "t int, m int, v double")
    found = panels.quantile_buckets(df, ["t"], "v", "m", 4)
    assert [n for _, n in rows(found.groupBy("bucket").count(), "bucket")] == [3, 2, 3, 2]


# research


def test_covariance_is_of_complete_dates(spark):
    df = spark.createDataFrame([(s, t, float(v)) for s, vs in (("a", (1, 2, 3, 4, 5)), ("b", (2, None, 1, 0, 7)), ("c", (1, 1, 2, 2, None))) for t, v in enumerate(vs) if v is not None], "s string, t int, r double")
    found = rows(research.upper_triangle(df, "s", "t", "r").select("i", "j", "n", "cov"), "i", "j")
    import numpy as np

    m = np.cov(np.array([[1, 3, 4], [2, 1, 0], [1, 2, 2.0]]), bias=True)
    assert {n for *_, n, _ in found} == {3} and [c for *_, c in found] == approx([m[0, 0], m[0, 1], m[0, 2], m[1, 1], m[1, 2], m[2, 2]])
    with pytest.raises(Exception, match="more than 16 series"):
        research.upper_triangle(spark.createDataFrame([(f"s{i:02}", 1, 1.0) for i in range(17)], "s string, t int, r double"), "s", "t", "r").collect()


def test_minimum_variance_of_five_series_equals_the_inverse(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = r.normal(0, 1, (40, 5)) @ r.normal(0, 1, (5, 5))
    df = spark.createDataFrame([(f"s{j}", i, float(x[i, j])) for i in range(40) for j in range(5)], "s string, t int, r double")
    got = rows(research.minimum_variance(research.upper_triangle(df, "s", "t", "r")).select("weight", "variance"), "series")
    m = np.cov(x.T, bias=True)
    w = np.linalg.solve(m, np.ones(5))
    w /= w.sum()
    assert [g[0] for g in got] == approx(w.tolist()) and got[0][1] == approx(w @ m @ w)
    walk = research.walk_forward(df, "s", "t", "r", 20, 8)
    for k in range(3):
        part = np.cov(x[k * 8 : k * 8 + 20].T, bias=True)
        v = np.linalg.solve(part, np.ones(5))
        v /= v.sum()
        own = rows(walk.where(F.col("window") == k).select("oos_return", "predicted_variance"), "t")
        assert [o[0] for o in own] == approx((x[20 + k * 8 : 28 + k * 8] @ v).tolist()) and own[0][1] == approx(v @ part @ v)


def test_dense_matrices_are_checked(spark):
    good = cells(spark, ("a", "a", 1.0), ("a", "b", 0.5), ("b", "b", 2.0))
    assert rows(research.dense_matrix(good).select("i", "j", "cov"), "i", "j") == [("a", "a", 1.0), ("a", "b", 0.5), ("b", "a", 0.5), ("b", "b", 2.0)]
    for bad, why in ((good.where("i = j"), "missing"), (good.unionByName(good.limit(1)), "twice")):
        with pytest.raises(Exception, match=why):
            research.dense_matrix(bad).collect()


def test_windows_are_excluded_for_the_first_reason(spark):
    df = spark.createDataFrame([(False, None, None), (True, None, 1.0), (True, 0.0, None), (True, 1.0, None), (True, 1.0, 1.0)], "w boolean, p double, r double")
    got = df.select(research.calibration_exclusion(F.col("w"), F.col("p"), F.col("r"))).collect()
    assert [r[0] for r in got] == ["WINDOW_UNDEFINED", "PREDICTED_VARIANCE_UNDEFINED", "ZERO_PREDICTED_VARIANCE", "SINGLE_VALID_PERIOD", None]


def test_track_records_and_campaigns_tell_reasons(spark):
    df = spark.createDataFrame([(1, 0.5, 30, 0.0, 3.0), (2, -0.1, 30, 0.0, 3.0), (3, 1.0, 3, 2.0, 3.0), (4, None, 1, None, None)], "t int, s double, n long, sk double, k double")
    got = rows(research.track_records(df, "t", "s", "n", "sk", "k").select("min_length", "sufficient", "reason"), "t")
    assert [g[2] for g in got] == [None, "SHARPE_NOT_ABOVE_BENCHMARK", "DEGENERATE_SHARPE_ESTIMATOR", "TRIAL_UNDEFINED"] and got[0][0] == approx(1 + 1.125 * (1.6448536269514722 / 0.5) ** 2) and got[0][1] is True
    profile = research.track_record_profile(research.track_records(df, "t", "s", "n", "sk", "k")).first()
    assert (profile["n_determined"], profile["status"], profile["reason"]) == (1, "UNDEFINED", "INSUFFICIENT_DETERMINED_TRIALS")
    one = rows(research.campaign(df.where("t in (1, 4)"), "t", "s", "n", "sk", "k").select("selected", "psr", "reason"), "t")
    assert one == [(False, None, "INSUFFICIENT_VALID_TRIALS")] * 2
    tied = research.campaign(spark.createDataFrame([(1, 0.5, 30, 0.0, 3.0), (2, 0.5, 30, 0.0, 3.0)], df.schema), "t", "s", "n", "sk", "k")
    assert rows(tied.select("t").where("selected")) == [(1,)]


def test_admissibility_needs_all_three(spark):
    df = spark.createDataFrame([(True, 0.5, 0.01, True), (False, 0.5, 0.01, True), (True, 0.01, 0.01, True), (True, 0.5, 0.01, False), (None, 0.01, None, None)], "s boolean, c double, n double, p boolean")
    got = df.select(research.admissibility(F.col("s"), F.col("c"), F.col("n"), F.col("p"))["verdict"]).collect()
    assert [r[0] for r in got] == ["ADMISSIBLE", "UNDEFINED", "INADMISSIBLE", "INADMISSIBLE", "UNDEFINED"]


def test_regressions_tell_reasons(spark):
    flat = spark.createDataFrame([("g", float(i), 1.0, float(i % 3)) for i in range(6)] + [("h", 1.0, 2.0, 3.0)], "g string, y double, x double, z double")
    got = {r["g"]: r["reason"] for r in research.ols_many(flat, ["g"], "y", ["x", "z"]).collect()}
    assert got == {"g": "SINGULAR_DESIGN", "h": "INSUFFICIENT_OBSERVATIONS"}
    through = {r["term"]: r["coef"] for r in research.ols_many(flat.where("g = 'g'"), ["g"], "y", ["x"], intercept=False).collect()}
    assert through == {"x": approx(2.5)}
    with pytest.raises(ValueError, match="at most 8"):
        research.ols_many(flat, ["g"], "y", [f"x{i}" for i in range(9)])


def test_series_that_differ_are_told(spark):
    df = spark.createDataFrame([("a", "m", 3), ("a", "m", 4), ("b", "m", 3)], "g string, schedule string, n int")
    assert rows(research.commensurable(df, ["g"], ["schedule", "n"]), "g") == [("a", False, "n"), ("b", True, None)]


def cells(spark, *c):
    return spark.createDataFrame(list(c), "i string, j string, cov double")


def test_minimum_variance(spark):
    three = research.minimum_variance(cells(spark, ("a", "a", 1.0), ("b", "b", 1.0), ("c", "c", 2.0)))
    assert [r[0] for r in rows(three.select("weight"), "series")] == approx([0.4, 0.4, 0.2])
    assert three.first()["variance"] == approx(0.4)
    two = research.minimum_variance(cells(spark, ("a", "a", 1.0), ("a", "b", 1.5), ("b", "b", 4.0)))
    assert [r[0] for r in rows(two.select("weight"), "series")] == approx([1.25, -0.25]) and two.first()["variance"] == approx(0.875)
    assert rows(research.minimum_variance(cells(spark, ("a", "a", 1.0), ("a", "b", 1.0), ("b", "b", 1.0))).select("weight")) == [(None,)] * 2


def test_adjusted_p(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.03), ("d", 0.04), ("e", None)], "t string, p double").withColumn("f", F.lit(1))
    found = rows(research.adjusted_p(df, ["f"], "t", "p").select("bonferroni", "holm", "bh", "by"), "t")
    assert [list(r) for r in found[:4]] == [approx([0.04, 0.04, 0.04, 0.25 / 3]), approx([0.08, 0.06, 0.04, 0.25 / 3]), approx([0.12, 0.06, 0.04, 0.25 / 3]), approx([0.16, 0.06, 0.04, 0.25 / 3])]
    assert found[4] == (None,) * 4


def test_calibration(spark):
    df = spark.createDataFrame([("s", 4.0, 1.0), ("s", 1.0, 4.0), ("s", 0.0, 1.0)], "s string, p double, r double")
    got = research.calibration(df, ["s"], "p", "r").first()
    assert (got["n"], got["mean_ratio"], got["pooled_bias"], got["dispersion"], got["under_forecast"]) == (2, 2.125, 1.0, 1.875, 0.5)


def test_turnover_resets_at_a_gap(spark):
    df = spark.createDataFrame([("s", 0, "a", 1.0), ("s", 1, "a", 0.5), ("s", 1, "b", 0.5), ("s", 2, "c", 1.0), ("s", 4, "c", 1.0)], "s string, w int, m string, x double")
    assert rows(research.turnover(df, ["s"], "w", "m", "x").select("w", "turnover"), "w") == [(0, None), (1, 0.5), (2, 1.0), (4, None)]


def test_cost_is_charged_on_the_first_date_of_a_window(spark):
    df = spark.createDataFrame([("s", 0, 1, 0.02, None), ("s", 1, 2, 0.04, 0.6), ("s", 1, 3, 0.04, 0.6)], "s string, w int, d int, r double, t double")
    found = rows(research.net_of_cost(df, ["s"], "w", "d", "r", "t", 0.1).select("cost", "net"), "d")
    assert [x for r in found for x in r] == approx([0.0, 0.02, 0.06, -0.02, 0.0, 0.04])
    assert research.break_even(df.where("d < 3"), ["s"], "r", "t").first()["break_even"] == approx(0.1)


def test_least_squares(spark):
    data = [("g", 3.0 + 2 * x + 5 * z, float(x), float(z)) for x, z in ((1, 0), (2, 1), (3, 5), (4, 2), (6, 3))]
    df = spark.createDataFrame(data, "g string, y double, x double, z double")
    found = {r["term"]: r["coef"] for r in research.ols_many(df, ["g"], "y", ["x", "z"]).collect()}
    assert found == approx({"intercept": 3.0, "x": 2.0, "z": 5.0})


def test_normal_distribution(spark):
    got = spark.range(1).select(s.normal_cdf(F.lit(1.959963985)), s.normal_cdf(F.lit(-9.0)), s.normal_ppf(F.lit(0.975)), s.normal_ppf(F.lit(0.0)), s.harmonic(F.lit(4))).first()
    assert list(got)[:3] == approx([0.975, 0.0, 1.959963985], abs=1e-7) and got[3] is None and got[4] == approx(25 / 12)
    from statistics import NormalDist

    n, xs, ps = NormalDist(), [-9.0, -5.5, -3.1, -2.9, -0.1, 0.0, 1.0, 3.5, 6.5], [1e-12, 1e-6, 0.01, 0.3, 0.5, 0.9, 0.999999]
    cdf = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(s.normal_cdf(F.col("x"))).collect()]
    import math

    assert cdf == [approx(0.5 * math.erfc(-x / 2**0.5), rel=1e-9) for x in xs]
    assert [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(s.normal_ppf(F.col("p"))).collect()] == [approx(n.inv_cdf(p), rel=1e-7, abs=1e-12) for p in ps]


# series and backtests


def test_worst_episode(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([10.0, 12.0, 6.0, 9.0, 12.0, 11.0])], "s string, t int, v double")
    assert rows(series.worst_episode(df, ["s"], "t", "v")) == [("s", 0.5, 1, 2)]


def test_value_at_risk_is_by_nearest_rank(spark):
    df = spark.createDataFrame([("s", x / 100) for x in range(20)] + [("t", x / 100) for x in range(-5, 16)] + [("u", 0.5)], "s string, r double")
    got = {r["s"]: (r["var"], r["cvar"]) for r in series.value_at_risk(df, ["s"], "r").collect()}
    assert got == {"s": (0.0, 0.0), "t": (approx(-0.04), approx(-0.045)), "u": (None, None)}


def test_adjustment_with_dividends(spark):
    closes = spark.createDataFrame([("s", d, 10.0) for d in (1, 2, 3)] + [("x", 1, 1.0)], "s string, d int, c double")
    actions = spark.createDataFrame([("s", 3, None, 2.0, 8.0), ("s", 2, 2.0, None, None), ("x", 5, 0.0, None, None)], "s string, ex int, ratio double, amount double, ref double")
    found = series.adjustment_factors(closes, actions, "s", "d", "ex", "ratio", "amount", "ref")
    assert [r[0] for r in rows(found.select("factor"), "s", "d")] == [approx(0.375), approx(0.75), approx(1.0), None]


def test_a_fall_from_the_start_counts(spark):
    df = spark.createDataFrame([("s", 1, -0.5), ("s", 2, 0.5)], "s string, t int, r double")
    assert rows(series.worst_episode(series.wealth(df, ["s"], "t", "r"), ["s"], "t", "level")) == [("s", 0.5, 1, None)]


def test_split_adjustment(spark):
    closes = spark.createDataFrame([("s", d) for d in (1, 2, 3, 4)], "s string, d int")
    actions = spark.createDataFrame([("s", 2, 2.0), ("s", 4, 5.0), ("x", 1, 3.0)], "s string, ex int, ratio double")
    found = series.adjustment_factors(closes, actions, "s", "d", "ex", "ratio")
    assert [r[-1] for r in rows(found.select("d", found.columns[-1]), "d")] == approx([0.1, 0.2, 0.2, 1.0])


def test_backtest_sells_before_it_buys_and_leaves_unpriced_targets(spark):
    targets = spark.createDataFrame([("s", 1, "a", 0.5), ("s", 1, "z", 0.5), ("s", 2, "b", 1.0)], "s string, d int, m string, w double")
    prices = spark.createDataFrame([(1, "a", 10.0), (2, "a", 20.0), (2, "b", 5.0)], "d int, m string, c double")
    found = backtest.run(targets, prices, ["s"], "d", "m", "w", "c", cash=1000.0, bps=0.0)
    assert rows(found.select("d", "equity", "n_held", "unfilled"), "d") == [(1, 1000.0, 1, 1), (2, 1500.0, 1, 0)]
    alone = backtest.run(targets.drop("s"), prices, [], "d", "m", "w", "c", cash=1000.0, bps=0.0)
    assert rows(alone.select("d", "equity", "n_held", "unfilled"), "d") == [(1, 1000.0, 1, 1), (2, 1500.0, 1, 0)]


def test_backtest_folds_only_what_it_may_hold(spark, monkeypatch):
    targets = spark.createDataFrame([("s", 1, "a", 1.0), ("s", 4, "y", float("nan")), *[("s", 1, f"m{i}", None) for i in range(300)]], "s string, d int, m string, w double")
    prices = spark.createDataFrame([(1, "a", 10.0), (2, "a", 20.0), *[(d, f"m{i}", 1.0) for d in (1, 2, 3) for i in range(300)], (9, "other", 1.0)], "d int, m string, c double")
    seen, real = [], GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, f, schema: seen.append(self.count()) or real(self, f, schema))
    found = backtest.run(targets, prices, ["s"], "d", "m", "w", "c", cash=1000.0, bps=0.0)
    assert rows(found.select("d", "equity", "n_held", "unfilled"), "d") == [(1, 1000.0, 1, 0), (2, 2000.0, 1, 0), (3, 2000.0, 1, 0), (4, 2000.0, 1, 0)]
    assert seen[0].first()["count"] == 2 + 4  # two rows of a, four dates


def test_leaderboard_leaves_out_what_is_not_finite(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None), ("d", 2.0)], "n string, x double")
    assert rows(backtest.leaderboard(df, "x", "n").select("n", "place", "excluded"), "n") == [("a", 3, None), ("b", 1, None), ("c", None, "not_finite"), ("d", 2, None)]


def test_equity_statistics(spark):
    df = spark.createDataFrame([("s", 1, 100.0, 0.5), ("s", 2, 50.0, 0.1), ("s", 3, 75.0, 0.0), ("t", 1, 10.0, None)], "s string, t int, e double, u double")
    a, b = series.equity_statistics(df, ["s"], "t", "e", "u").orderBy("s").collect()
    assert (a["n_periods"], a["initial"], a["final"], a["peak"], a["cumulative"], a["mean"], a["vol"], a["sharpe"], a["max_drawdown"], a["mean_turnover"]) == (2, 100.0, 75.0, 100.0, -0.25, 0.0, 0.5, 0.0, -0.5, approx(0.2))
    assert (b["n_periods"], b["cumulative"], b["mean"], b["sharpe"], b["max_drawdown"]) == (0, 0.0, 0.0, 0.0, 0.0)
    with pytest.raises(Exception, match="not above 0"):
        series.equity_statistics(spark.createDataFrame([("s", 1, 0.0), ("s", 2, 1.0)], "s string, t int, e double"), ["s"], "t", "e").collect()


def test_best_results_and_pins(spark):
    df = spark.createDataFrame([("b", 1.0, "p"), ("a", 1.0, "p"), ("c", None, "q"), ("d", float("nan"), "p")], "n string, sharpe double, pin string")
    assert rows(backtest.best_of(df, "sharpe", "n").select("n")) == [("a",)]
    assert [r[0] for r in rows(backtest.leaderboard(df, "sharpe", "n").select("excluded"), "n")] == [None, None, "not_finite", "not_finite"]
    assert tuple(backtest.pins_differ(df, "pin").first()) == (["p", "q"], True) and backtest.pins_differ(df.limit(0), "pin").first()["mismatch"] is None
    assert [r[0] for r in rows(backtest.top_n(df.where("n < 'c'").withColumn("t", F.lit(1)), ["t"], "sharpe", "n", 1, ascending=True).select("n"))] == ["a"]


def test_windows_must_be_the_same(spark):
    a, b = (spark.createDataFrame([(i, 1.0) for i in w], f"window int, {c} double") for w, c in (((0, 1), "x"), ((0, 2), "y")))
    assert research.aligned(a, a.withColumnRenamed("x", "y"), "window").count() == 2
    with pytest.raises(Exception, match="windows differ"):
        research.aligned(a, b, "window").collect()
    places = spark.createDataFrame([(0, "test", 7), (0, "test", 5), (0, "train", 1)], "window int, role string, d int")
    made = research.dated(spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.2)], "window int, i int, r double"), places, "window", "i", "d")
    assert rows(made.select("d", "r"), "d") == [(5, 0.1), (7, 0.2)]


def test_prices_without_a_session_are_not_reported(spark):
    from datetime import date, datetime

    from asofkit.operators import prices

    seen = spark.createDataFrame([("s", date(2024, 1, d), "close", f"o{d}", float(d)) for d in (2, 3)], "security_id string, trading_date date, field string, observation_id string, value double")
    sessions = spark.createDataFrame([("s", date(2024, 1, 2), datetime(2024, 1, 2, 22), "derived")], "security_id string, trading_date date, available timestamp, status string")
    cells = prices.price_series(prices.with_sessions(seen, sessions), seen.select("security_id", "trading_date"), "close", datetime(2024, 2, 1)).orderBy("trading_date").collect()
    assert [(r["value"], r["reason"]) for r in cells] == [(2.0, None), (None, "not_reported")]


def test_dividends_at_their_reference_give_no_factor(spark):
    from asofkit.operators import series

    closes = spark.createDataFrame([("s", 1, 10.0), ("s", 5, 10.0)], "s string, d int, close double")
    for amount, factor in ((9.0, 0.1), (10.0, None), (11.0, None)):
        actions = spark.createDataFrame([("s", 3, None, amount, 10.0)], "s string, ex int, ratio double, amount double, ref double")
        found = series.adjustment_factors(closes, actions, "s", "d", "ex", "ratio", "amount", "ref").orderBy("d").collect()
        assert found[1]["factor"] == 1.0 and (found[0]["factor"] is None if factor is None else abs(found[0]["factor"] - factor) < 1e-12)
