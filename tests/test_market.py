import json
from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException

from asofkit.sources import market

D = date(2024, 1, 2)


def test_merges_keep_what_is_stored(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "action_id string, kind string, payload map<string,string>")
    got = market.merged(make(("a", "split", {"ratio": "2"}), ("b", "split", None)), make(("a", "other", None), ("c", "z", None), ("c", "dividend", None), ("c", "z", None)), "action_id")
    assert sorted((r["action_id"], r["kind"], r["payload"]) for r in got.collect()) == [("a", "split", {"ratio": "2"}), ("b", "split", None), ("c", "dividend", None)]


def test_sessions_move_later_only(spark):
    t = lambda h: datetime(2024, 1, 3, h)
    make = lambda *rows: spark.createDataFrame([(s, D, a, st, p) for s, a, st, p in rows], "security_id string, trading_date date, available timestamp, status string, policy_id string")
    stored = make(("later", t(1), "derived", "old"), ("earlier", t(5), "derived", "old"), ("same", t(1), "derived", "a"), ("worse", t(1), "verified", "old"), ("bad", None, "unknown", "old"), ("odd", t(1), None, "old"))
    new = make(("later", t(2), "derived", "new"), ("earlier", t(4), "derived", "new"), ("same", t(1), "derived", "z"), ("worse", None, "derived", "new"), ("bad", t(1), "verified", "new"), ("odd", t(9), "derived", "new"), ("fresh", t(7), "derived", "new"))
    got = {r["security_id"]: (r["available"], r["policy_id"]) for r in market.merged_sessions(stored, new).collect()}
    assert got == {"later": (t(2), "new"), "earlier": (t(5), "old"), "same": (t(1), "a"), "worse": (None, "new"), "bad": (None, "old"), "odd": (t(1), "old"), "fresh": (t(7), "new")}


def test_policies_of_sessions(spark):
    policies = [("early", "2007-01-01", "2020-01-01", "16:00:00", 240), ("late", "2019-12-31", None, "16:00:00", 0)]
    rows = [("a", date(2019, 7, 1), None), ("b", date(2024, 1, 2), datetime(2024, 1, 2, 20)), ("c", date(2019, 12, 31), None), ("d", date(2006, 12, 29), None), ("e", date(2020, 1, 2), None)]
    got = {r["security_id"]: (r["available"], r["status"], r["policy_id"]) for r in market.session_availability(spark.createDataFrame(rows, "security_id string, trading_date date, retrieved timestamp"), policies).collect()}
    assert got["a"] == (datetime(2019, 7, 2, 0), "derived", "early")  # 16:00 of New York's summer and four hours
    assert got["e"] == (datetime(2020, 1, 2, 21), "derived", "late") and got["b"] == (None, "unknown", "late")
    assert got["c"] == (None, "ambiguous", None) and got["d"] == (None, "unknown", None)


def test_tickers(spark):
    row = lambda t, f, to=None: {"ticker": t, "exchange": "X", "effective_from": f, "effective_to": to}
    documents = [{"security_id": "s1", "ticker_history": [row("fb", "2012-05-18", "2022-06-09"), row("META", "2022-06-09")]}, {"security_id": "s2", "ticker_history": [row("META", "2021-06-30", "2022-01-01"), row("FB", "2022-06-01")]}, {"security_id": "s3"}]
    history = market.ticker_history(spark.createDataFrame([(json.dumps(x),) for x in documents], "content string")).persist()
    assert history.count() == 4
    asked = [("FB", date(2013, 1, 1)), ("fb", date(2022, 6, 8)), ("FB", date(2022, 6, 9)), ("META", date(2022, 3, 1)), ("META", date(2021, 12, 31)), ("META", date(2022, 6, 9)), (None, D), ("ZZ", D), ("FB", None)]
    got = [(r["ticker"], r["security_id"], r["ticker_status"]) for r in market.securities_of(spark.createDataFrame(asked, "ticker string, day date").coalesce(1), history).collect()]
    want = [("FB", "s1", "resolved"), ("fb", None, "ambiguous"), ("FB", "s2", "resolved"), ("META", None, "unknown"), ("META", "s2", "resolved"), ("META", "s1", "resolved"), (None, None, "unknown"), ("ZZ", None, "unknown"), ("FB", None, "unknown")]
    assert sorted(got, key=str) == sorted(want, key=str)
    with pytest.raises(PySparkException, match="without effective_from"):
        market.ticker_history(spark.createDataFrame([(json.dumps({"security_id": "s", "ticker_history": [{"ticker": "A"}]}),)], "content string")).collect()


def test_axes(spark):
    days = [r["trading_date"] for r in market.business_daily_axis(spark, date(2023, 12, 29), date(2024, 1, 3)).orderBy("trading_date").collect()]
    assert days == [date(2023, 12, 29), date(2024, 1, 2), date(2024, 1, 3)]
    assert [(r["trading_date"].day, r["ordinal"]) for r in market.explicit_axis(spark, [date(2024, 1, 5), D]).orderBy("ordinal").collect()] == [(2, 0), (5, 1)]
    for bad in (lambda: market.explicit_axis(spark, []), lambda: market.explicit_axis(spark, [D, D]), lambda: market.business_daily_axis(spark, D, date(2024, 1, 1)), lambda: market.business_daily_axis(spark, date(2023, 12, 30), date(2024, 1, 1))):
        with pytest.raises(ValueError):
            bad()
    assert market.axis_id(market.EXPLICIT, [D]) != market.axis_id(market.BUSINESS_DAILY, [D]) == market.axis_id("business-daily", [D])


def test_sectors_and_versions(spark):
    pairs = [("gics", "a", "tech"), ("gics", "a", "tech"), ("sic", "a", "7372"), ("gics", "b", "energy"), ("gics", None, "x")]
    assigned = spark.createDataFrame(pairs, "scheme string, company_id string, sector string")
    members = spark.createDataFrame([("a",), ("c",), (None,)], "company_id string")
    assert sorted(map(str, (tuple(r) for r in market.with_sector(members, assigned, "gics").collect()))) == ["('a', 'tech')", "('c', None)", "(None, None)"]
    assert {r["scheme"]: r["n"] for r in market.classification(assigned).collect()} == {"gics": 3, "sic": 1}
    with pytest.raises(PySparkException, match="several sectors"):
        market.with_sector(members, assigned.unionByName(spark.createDataFrame([("gics", "a", "other")], assigned.schema)), "gics").collect()
    obs = spark.createDataFrame([("s", "d", str(i)) for i in range(9)] + [("t", None, "1")], "security_id string, document_id string, observation_id string")
    act = spark.createDataFrame([("s", "x"), ("u", "y")], "security_id string, action_id string")
    ses = spark.createDataFrame([("s", "p"), ("s", None), ("none", "p")], "security_id string, policy_id string")
    versions = lambda o, tv="1": {r["security_id"]: (r["root"], r["n"]) for r in market.market_version(o, act, ses, tv).collect()}
    one = versions(obs)
    assert {k: n for k, (_, n) in one.items()} == {"s": 13, "t": 2, "u": 2, "none": 1} and versions(obs.unionByName(obs).repartition(4)) == one
    assert versions(obs.where("observation_id <> '3'"))["s"] != one["s"] and not set(versions(obs, "2").values()) & {v for k, v in one.items() if k != "none"}
