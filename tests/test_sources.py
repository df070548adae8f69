import json
import tempfile

import pytest
from pyspark.sql import functions as F

from asofkit.functions import scalars as s
from asofkit.plans import formula
from asofkit.sources import filings, store
from asofkit.streaming import knowledge


def docs(spark, *contents):
    return spark.createDataFrame([(json.dumps(c),) for c in contents], "content string")


def test_submissions(spark):
    recent = {"accessionNumber": ["0000320193-23-000001", "000032019323000002"], "form": ["10-K", "10-K/A"], "filingDate": ["2023-11-03", ""], "reportDate": ["2023-09-30", ""], "acceptanceDateTime": ["2023-11-03T21:30:00Z", ""], "primaryDocument": ["a.htm", ""]}
    got = filings.submissions(docs(spark, {"cik": "320193", "filings": {"recent": recent}})).orderBy("filing_id").collect()
    assert [(r["filing_id"], r["company_id"], r["is_amendment"], r["primary_document"]) for r in got] == [("accession:0000320193-23-000001", "cik:0000320193", False, "a.htm"), ("accession:0000320193-23-000002", "cik:0000320193", True, None)]


def test_bars_and_actions(spark):
    bars = filings.observations(docs(spark, {"security_id": "s", "currency": "USD", "bars": [{"trading_date": "2024-01-02", "close": "10.5", "volume": "3"}]}))
    assert sorted(map(tuple, bars.select("field", "value").collect())) == [("close", 10.5), ("volume", 3.0)]
    got = filings.corporate_actions(docs(spark, {"security_id": "s", "actions": [{"kind": "split", "ex_date": "2024-01-03", "ratio": "2"}]})).first()
    assert got["kind"] == "split" and got["payload"] == {"ratio": "2"}


def test_tickers(spark):
    assert tuple(filings.tickers(docs(spark, {"0": {"cik_str": "12", "ticker": "zz", "title": "Z & Z, Inc."}})).first()) == ("0000000012", "ZZ", "Z & Z, Inc.", "Z & Z, INC.")


INSTANCE = """<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:d="http://xbrl.org/2006/xbrldi" xmlns:g="urn:g" xmlns:iso4217="http://www.xbrl.org/2003/iso4217">
<context id="c"><entity><identifier scheme="x">0000320193</identifier><segment><d:explicitMember dimension="g:A">g:M</d:explicitMember></segment></entity><period><instant>2023-09-30</instant></period></context>
<unit id="u"><measure>iso4217:USD</measure></unit><g:Assets contextRef="c" unitRef="u" decimals="-3">1,000</g:Assets>%s</xbrl>"""


def test_xbrl_instances(spark):
    good, dangling = INSTANCE % "", INSTANCE % '<g:X contextRef="none">1</g:X>'
    df = spark.createDataFrame([("a", good.encode()), ("b", b"<!DOCTYPE x><x/>"), ("c", b"<"), ("d", dangling.encode())], "path string, content binary")
    got = {r["source"]: r for r in filings.xbrl_facts(df).collect()}
    assert (got["a"]["concept"], got["a"]["period_type"], got["a"]["unit"], got["a"]["value"]) == ("{urn:g}Assets", "instant", "{http://www.xbrl.org/2003/iso4217}USD", "1,000")
    assert [got[k]["error"] for k in "bcd"] == ["doctype", "not_xml", "dangling_reference"]


def test_store_is_write_once(spark):
    df = store.with_id(spark.createDataFrame([(1, "x"), (2, None)], "b int, a string"), "factor", ["b", "a"])
    assert sorted(r["payload"] for r in df.collect()) == ['{"a":"x","b":1}', '{"a":null,"b":2}']
    assert store.appended(df, df).count() == 0 and store.appended(df.limit(0), df).count() == 2
    with pytest.raises(Exception, match="another payload"):
        store.appended(df, df.withColumn("payload", F.lit("{}"))).collect()
    with pytest.raises(Exception, match="another payload"):  # within one batch
        store.appended(df.limit(0), df.unionByName(df.limit(1).withColumn("payload", F.lit("{}")))).collect()
    again = store.appended(df.limit(1), df.unionByName(df))
    assert again.columns == df.columns and again.count() == 1


def test_corpus_root_does_not_depend_on_order(spark):
    df = spark.range(1000).withColumn("g", F.lit(1))
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    df = df.withColumn("id", F.sha2(F.col("id").cast("string"), 256))
    a, b, c = (store.corpus_root(x, ["g"], "id", height=h).first() for x, h in ((df, 10), (df.orderBy(F.rand(1)).unionByName(df), 3), (df, 1)))
    level = [sha(x) for x in sorted(sha(str(i)) for i in range(1000))]
    while len(level) > 1:
        level = [sha("\0".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    assert a == b == c and a["n"] == 1000 and a["root"] == f"sha256:{level[0]}"
    versions = store.dataset_version(df, ["g"], "t", ["p"], "id", "id")
    pinned = versions.select("g", "root").unionByName(spark.createDataFrame([(1, "sha256:x"), (2, "sha256:y")], "g int, root string"))
    assert sorted(r["status"] for r in store.pins_match(versions, pinned, ["g"]).collect()) == ["match", "mismatch", "missing"]


def test_identifiers_and_calendar(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(s.cik10(F.lit("CIK320193"))) == "0000320193" and one(s.cik10(F.lit("x"))) is None
    assert one(s.accession(F.lit("12"))) is None
    d = lambda x: F.lit(x).cast("date")
    assert str(one(s.next_business_day(d("2023-12-22")))) == "2023-12-26"
    assert str(one(s.add_months_sticky(d("2024-02-29"), 1))) == "2024-03-31"
    at = lambda x: F.lit(x).cast("timestamp")
    assert str(one(s.filing_available(at("2023-11-03 23:30:00"), at("2025-01-01")))) == "2023-11-06 22:30:00"
    assert one(s.filing_available(at(None), at("2025-01-01"))) is None and one(s.filing_available(at("2025-01-02"), at("2025-01-01"))) is None
    assert str(one(s.filing_available(at("2023-11-03 15:00:00"), at("2023-11-03 16:00:00")))) == "2023-11-03 16:00:00"
    assert str(one(s.market_available(d("2024-07-03"), at("2024-08-01")))) == "2024-07-04 00:00:00"
    assert one(s.market_available(d("2024-07-03"), at("2024-07-03 19:59:59"))) is None and str(one(s.market_available(d("2024-07-03"), at("2024-07-03 21:00:00")))) == "2024-07-03 21:00:00"
    assert one(s.is_business_day(d("2021-12-31"))) is True and one(s.is_business_day(d("2021-12-24"))) is False and one(s.is_business_day(d("2022-06-20"))) is False
    assert one(s.is_amendment(F.lit(" 10-k/a "))) is True and one(s.base_form(F.lit(" 10-k/a "))) == "10-K" and one(s.plain_name(F.lit(" a.b  c"))) == "A.B C"


def test_exact_numbers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    made = [one(s.plain_decimal(s.folded(F.lit(v), F.lit(k), F.lit(g)))) for v, k, g in (("1,234.50", None, None), ("0.10", 2, "-"), ("12", -3, None), ("-0", 0, None), ("x", None, None), ("1e2", None, None), ("NaN", None, None))]
    assert made == ["1234.5", "-10", "0.012", "0", None, "100", None]
    with pytest.raises(Exception, match="bad scale or sign"):
        one(s.folded(F.lit("1"), F.lit("x"), F.lit(None)))


def test_units_and_periods(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    usd, pure = F.lit("USD"), F.lit("pure")
    assert [one(f(a, b)) for f, a, b in ((s.sum_unit, usd, usd), (s.sum_unit, usd, F.lit("EUR")), (s.quotient_unit, usd, usd), (s.quotient_unit, usd, pure), (s.factor_unit, usd, pure), (s.factor_unit, usd, usd))] == ["USD", None, "pure", None, "USD", None]
    assert tuple(one(s.canonical_period(F.lit("forever"), F.lit("x"), F.lit("y")))) == ("forever", None, None)
    with pytest.raises(Exception, match="lacks its dates"):
        one(s.canonical_period(F.lit("duration"), F.lit(None), F.lit("2024-01-01")))


def test_registry_merges_equal_records_alone(spark):
    from asofkit.sources import registry

    rows = [("f", "c", "10-K", "d", "t"), ("f", "c", "10-K", "d", "t"), ("g", "c", "10-K", "d", None)]
    df = spark.createDataFrame(rows, "filing_id string, company_id string, form string, filing_date string, accepted string").withColumn("report_date", F.lit("r"))
    assert registry.merged_filings(df).count() == 2 and registry.built(df).count() == 2
    with pytest.raises(Exception, match="records of one filing differ"):
        registry.merged_filings(df.unionByName(df.limit(1).withColumn("form", F.lit("8-K")))).collect()
    assert [r["filing_known"] for r in registry.with_filings(spark.createDataFrame([("f", "c"), ("f", "x")], "filing_id string, company_id string"), df).orderBy("company_id").collect()] == [True, False]


def test_canonical_facts(spark):
    from asofkit.sources import registry, xbrl

    usd = ["{http://www.xbrl.org/2003/iso4217}USD"]
    common = {"source": "s", "entity": "e", "period_end": "2023-12-31", "is_nil": False}
    rows = [
        {**common, "ordinal": 0, "concept": "{http://fasb.org/us-gaap/2023}Assets", "period_type": "instant", "value": "1000", "decimals": "-3", "numerator": usd, "denominator": [], "scale": "3", "sign": "-"},
        {**common, "ordinal": 1, "concept": "{urn:x}Note", "period_type": "duration", "period_start": "2023-01-01", "dimensions": [("a", "m")], "value": "1,000"},
    ]
    raw = spark.createDataFrame([tuple(r.get(n) for n in xbrl.NAMES) for r in rows], xbrl.SCHEMA)
    a, b = registry.canonical_facts(raw).orderBy("concept").collect()
    assert (a["taxonomy"], a["concept"], a["unit"], float(a["value"]), a["consolidated"]) == ("us-gaap", "Assets", "USD", -1_000_000.0, True)
    assert (b["taxonomy"], b["unit"], b["value"], b["text"], b["dimensions_key"], b["consolidated"]) == ("custom", "unknown", None, "1,000", "a=m", False)  # commas are no part of a number


def test_formula_tells_the_first_missing_input(spark):
    df = spark.createDataFrame([(4.0, 1.0, 2.0), (None, None, 2.0), (1.0, 1.0, 0.0)], "current_assets double, inventory double, current_liabilities double")
    got = df.select(formula.compiled(formula.BUILTIN["quick_ratio"]).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in got] == [("KNOWN", 1.5, None), ("UNDEFINED", None, "missing_input"), ("UNDEFINED", None, "divide_by_zero")]


def test_stream_gives_the_same_as_the_batch(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source = tempfile.mkdtemp(prefix="spark-") + "/in"
    events.unionByName(events.limit(50)).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    once = knowledge.observations(stream, "event_id", "ts", "365 days")
    running = knowledge.latest(once, ["user_id", "event_type"], "ts", ["event_id"], "value")
    q = running.writeStream.outputMode("complete").format("memory").queryName("known").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = knowledge.latest(events, ["user_id", "event_type"], "ts", ["event_id"], "value")
    got = spark.table("known")
    assert got.count() == batch.count() > 0 and got.exceptAll(batch).count() == 0


def test_lookups_addresses_and_versions(spark):
    from asofkit.plans.formula import BUILTIN, identity
    from asofkit.sources import registry

    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(registry.filing_url(F.lit("320193"), F.lit("0000320193-23-000106"), F.lit("a.htm"))).endswith("/320193/000032019323000106/a.htm") and one(registry.basename(F.lit("x/y/a.htm"))) == "a.htm"
    assert one(registry.submissions_url(F.lit(320193))).endswith("/CIK0000320193.json")
    df = spark.createDataFrame([("f", "c", "10-K", "v1"), ("g", "c", "8-K", "v1"), ("h", "d", "10-K", "v2")], "filing_id string, company_id string, form string, version string")
    assert [registry.filings_of(df, *a).count() for a in (("c",), ("c", "8-K"), (None, None, "h"))] == [2, 1, 1] and registry.facts_of(df, "d").count() == 1
    assert sorted(r["versions"] for r in registry.single_version(df, ["company_id"], "version").collect()) == [["v1"], ["v2"]]
    with pytest.raises(Exception, match="several versions"):
        registry.single_version(df, [], "version").collect()
    ids = {identity(f) for f in BUILTIN.values()}
    assert len(ids) == 8 and all(i.startswith("formula:") for i in ids)
    assert str(one(s.parse_utc(F.lit("2024-01-02T03:04:05Z")))) == "2024-01-02 03:04:05" and one(s.parse_utc(F.lit("2024-01-02T03:04:05"))) is None and one(s.format_utc(F.lit("2024-01-02 03:04:05").cast("timestamp"))) == "2024-01-02T03:04:05Z"


def test_version_leaves_are_shuffled_once_and_stored_as_bytes(spark, monkeypatch):
    df = spark.createDataFrame([(1, "d", str(i)) for i in range(20)], "g int, d string, f string")
    stored, real = [], store.written
    monkeypatch.setattr(store, "written", lambda placed: stored.append(placed) or real(placed))
    made = store.dataset_version(df, ["g"], "t", ["p"], "d", "f").first()
    assert made["n"] == 23 and dict(stored[0].dtypes)["_h"] == "binary"
    assert "_leaf" not in stored[0].columns and stored[0].count() == 23
