"""Filing sources: submissions, tickers and market documents, as DataFrames. XBRL instances are in `xbrl`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import accession, cik10, company_id, is_amendment, plain_name
from .xbrl import xbrl_facts  # noqa: F401

_FIELDS = "accessionNumber form filingDate reportDate acceptanceDateTime primaryDocument".split()
SUBMISSIONS = f"cik string, filings struct<recent:struct<{','.join(f'{f}:array<string>' for f in _FIELDS)}>>"
BARS = "security_id string, currency string, bars array<struct<trading_date:string,open:string,high:string,low:string,close:string,volume:string>>"
ACTIONS = "security_id string, actions array<struct<kind:string,ex_date:string,ratio:string,amount:string,currency:string,terms:string,successor_security_id:string>>"


def submissions(documents: DataFrame, json_col: str = "content") -> DataFrame:
    """Filings of columnar submission documents: a row for each place of the parallel arrays; empty strings become null."""
    d = documents.select(F.from_json(F.col(json_col).cast("string"), SUBMISSIONS).alias("d"))
    rows = d.select("d.cik", F.explode(F.arrays_zip(*[F.col(f"d.filings.recent.{f}").alias(f) for f in _FIELDS])).alias("r"))
    some = lambda f: F.nullif(F.col(f"r.{f}"), F.lit(""))
    number = accession(some("accessionNumber"))
    return rows.select(
        F.concat(F.lit("accession:"), number).alias("filing_id"), company_id(F.col("cik")).alias("company_id"), some("form").alias("form"), some("filingDate").cast("date").alias("filing_date"),
        some("reportDate").cast("date").alias("report_date"), some("acceptanceDateTime").cast("timestamp").alias("accepted"), is_amendment(some("form")).alias("is_amendment"), some("primaryDocument").alias("primary_document"),
    )


def tickers(documents: DataFrame, json_col: str = "content") -> DataFrame:
    """cik, ticker, title, plain_title of a directory document {"0": {"cik_str", "ticker", "title"}, ...}."""
    entries = F.map_values(F.from_json(F.col(json_col).cast("string"), "map<string,struct<cik_str:string,ticker:string,title:string>>"))
    e = documents.select(F.explode(entries).alias("e"))
    return e.select(cik10(F.col("e.cik_str")).alias("cik"), F.upper("e.ticker").alias("ticker"), F.col("e.title").alias("title"), plain_name(F.col("e.title")).alias("plain_title"))


def observations(documents: DataFrame, json_col: str = "content") -> DataFrame:
    """security_id, trading_date, field, value: a row for each field that a bar has."""
    bars = documents.select(F.from_json(F.col(json_col).cast("string"), BARS).alias("d")).select("d.security_id", F.explode("d.bars").alias("b")).select("security_id", "b.*")
    long = bars.unpivot(["security_id", "trading_date"], ["open", "high", "low", "close", "volume"], "field", "value")
    return long.where(F.col("value").isNotNull()).select("security_id", F.col("trading_date").cast("date").alias("trading_date"), "field", F.col("value").cast("double").alias("value"))


def corporate_actions(documents: DataFrame, json_col: str = "content") -> DataFrame:
    """security_id, kind, ex_date, payload: the fields an action has."""
    a = documents.select(F.from_json(F.col(json_col).cast("string"), ACTIONS).alias("d")).select("d.security_id", F.explode("d.actions").alias("a"))
    fields = ("ratio", "amount", "currency", "terms", "successor_security_id")
    payload = F.map_filter(F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f"a.{f}") for f in fields])), lambda _, v: v.isNotNull())
    return a.select("security_id", "a.kind", F.col("a.ex_date").cast("date").alias("ex_date"), payload.alias("payload"))
