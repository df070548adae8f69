"""Filing registries and canonical facts, from parsed documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.scalars import accession, canonical_period, canonical_unit, cik10, clark, dimensions_key, taxonomy
from ..operators.sets import amendment_links

#: What all records of one filing must agree on.
AGREE = ("company_id", "form", "filing_date", "accepted")


def merged_filings(filings: DataFrame, agree: Sequence[str] = AGREE) -> DataFrame:
    """One row for each filing_id; records that differ in one of the agreed columns are an error."""
    others = [c for c in filings.columns if c != "filing_id" and c not in agree]
    differ = F.greatest(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\\0"))) for c in agree], F.lit(1)) > 1
    rows = filings.groupBy("filing_id").agg(differ.alias("_differ"), *[F.max(c).alias(c) for c in [*agree, *others]])
    checked = F.when(F.col("_differ"), F.raise_error(F.concat(F.lit("records of one filing differ: "), "filing_id"))).otherwise(F.col("filing_id"))
    return rows.withColumn("filing_id", checked).drop("_differ")


def built(filings: DataFrame) -> DataFrame:
    """The registry: merged filings with amends and confidence of the amendments among them."""
    merged = merged_filings(filings)
    links = amendment_links(merged).select("filing_id", "amends", "confidence")
    return merged.join(links, "filing_id", "left")


def with_filings(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """documents (filing_id, company_id) with filing_known: whether the registry has that filing for that company."""
    known = registry.select("filing_id", "company_id").distinct().withColumn("filing_known", F.lit(True))
    return documents.join(known, ["filing_id", "company_id"], "left").fillna(False, ["filing_known"])


def canonical_facts(raw: DataFrame) -> DataFrame:
    """Raw facts (of xbrl.xbrl_facts; rows with an error go) as canonical ones, a row for each fact: taxonomy and concept from the {namespace}name, a checked period, unit and currency,
    `number` (exact: see functions.numbers; scale and sign folded in), its plain text `value`, `text` of what is no number, dimensions_key and consolidated (no dimension at all,
    explicit or typed). A number with a scale or sign that cannot be read is an error. Nil is no value, never 0."""
    name, period, unit = clark(F.col("concept")), canonical_period(F.col("period_type"), F.col("period_start"), F.col("period_end")), canonical_unit(F.col("numerator"), F.col("denominator"))
    number = F.when(~F.col("is_nil"), numbers.folded(F.col("value"), F.col("scale"), F.col("sign")))
    rows = raw.where(F.col("error").isNull()).withColumn("_name", name).withColumn("_period", period).withColumn("_unit", unit).withColumn("_number", number)
    rows = rows.withColumn("_key", dimensions_key(F.coalesce("dimensions", F.array().cast("array<struct<axis:string,member:string>>"))))
    unit_ref = F.concat_ws(chr(30), F.array_join(F.array_sort(F.coalesce("numerator", F.array().cast("array<string>"))), chr(31)), F.array_join(F.array_sort(F.coalesce("denominator", F.array().cast("array<string>"))), chr(31)))
    return rows.select(
        "source", "ordinal", "entity", F.col("concept").alias("qname"), taxonomy(F.col("_name.namespace")).alias("taxonomy"), F.col("_name.local").alias("concept"), "_period.*", F.col("_unit.unit").alias("unit"), F.col("_unit.currency").alias("currency"), unit_ref.alias("unit_ref"),
        F.col("_number").alias("number"), numbers.plain(F.col("_number")).alias("value"), F.when(~F.col("is_nil") & F.col("_number").isNull(), F.col("value")).alias("text"), F.col("value").alias("lexical"), "decimals", "is_nil", F.col("_key").alias("dimensions_key"), (F.col("_key") == "").alias("consolidated"),
    )


#: What tells one observation of a document from another.
OBSERVATION = ("source", "entity", "qname", "period_type", "period_start", "period_end", "unit_ref", "dimensions_key")


def one_of_each(facts: DataFrame) -> DataFrame:
    """Canonical facts, one for each observation of a document, with n_facts. Facts that say the same are one, the first in order; facts that differ must all be numbers which
    are the most precise one, rounded half up to their own decimals: that one stands. Anything else is a contradiction, and an error.

    One shuffle by observation; a group holds the repetitions of a fact within one document."""
    places = F.trim("decimals")
    known = F.when(places.rlike(r"^[+-]?\d{1,9}$"), places.try_cast("int"))
    others = [c for c in facts.columns if c not in OBSERVATION]
    held = facts.withColumn("_places", known).groupBy(*OBSERVATION).agg(F.array_sort(F.collect_list(F.struct("ordinal", "_places", *[c for c in others if c != "ordinal"]))).alias("_all"))
    said = lambda f: F.struct(f["is_nil"].alias("n"), f["value"].alias("v"), f["text"].alias("t"))
    same = F.size(F.array_distinct(F.transform("_all", said))) == 1
    readable = F.forall("_all", lambda f: ~f["is_nil"] & f["number"].isNotNull() & f["_places"].isNotNull())
    finest = F.array_max(F.transform("_all", lambda f: f["_places"]))
    best = F.get(F.filter("_all", lambda f: f["_places"] == finest), F.lit(0))
    marked = held.withColumn("_best", F.when(same, F.get("_all", F.lit(0))).when(readable, best))
    agree = same | F.coalesce(F.forall("_all", lambda f: numbers.rounded(F.col("_best.number"), f["_places"]) == f["number"]), F.lit(False))
    where = F.concat_ws(" ", F.lit("facts of one observation contradict each other:"), "source", "qname", "period_end")
    checked = marked.withColumn("_best", F.when(agree, F.col("_best")).otherwise(F.raise_error(where).cast(marked.schema["_best"].dataType)))
    return checked.select(*OBSERVATION, *[F.col("_best")[c].alias(c) for c in others], F.size("_all").cast("long").alias("n_facts"))


def filings_of(registry: DataFrame, company_id: str | None = None, form: str | None = None, filing_id: str | None = None) -> DataFrame:
    """Filings of a company, a form (amendments have their own) or one filing; the filters reach the scan."""
    for column, value in (("company_id", company_id), ("form", form), ("filing_id", filing_id)):
        registry = registry if value is None else registry.where(F.col(column) == value)
    return registry


def facts_of(facts: DataFrame, company_id: str) -> DataFrame:
    return facts.where(F.col("company_id") == company_id)


def single_version(rows: DataFrame, by: Sequence[str], version: str) -> DataFrame:
    """by, versions (distinct, in order); an error where rows of a group were made by several."""
    held = F.array_sort(F.collect_set(version))
    return rows.groupBy(*by).agg(F.when(F.size(held) <= 1, held).otherwise(F.raise_error(F.lit("rows of several versions")).cast("array<string>")).alias("versions"))


#: Public addresses (fixed values).
DATA, ARCHIVES = "https://data.sec.gov", "https://www.sec.gov/Archives/edgar/data"


def submissions_url(cik: Column) -> Column:
    return F.concat(F.lit(f"{DATA}/submissions/CIK"), cik10(cik), F.lit(".json"))


def filing_url(cik: Column, number: Column, name: Column) -> Column:
    """A document of a filing."""
    return F.concat_ws("/", F.lit(ARCHIVES), cik10(cik).cast("bigint").cast("string"), F.replace(accession(number), F.lit("-"), F.lit("")), name)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
