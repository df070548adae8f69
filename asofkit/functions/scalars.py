"""Scalar functions as Columns: quantised doubles, identifiers, dates, normal distribution, units."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import numbers


def q6(x: Column) -> Column:
    """x to six places, half up in binary: the same in any engine."""
    return F.floor(x * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)


def div(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def exact_sum(x: Column, scale: int = 2) -> Column:
    """A sum that does not depend on the order of rows."""
    return F.sum(x.cast(f"decimal(18,{scale})")).cast("double")


def cell(value: Column, *reasons: tuple[Column, str]) -> Column:
    """struct<status,value,reason>: UNDEFINED with the first reason whose condition holds, else KNOWN."""
    reason = reduce(lambda out, r: F.when(r[0], F.lit(r[1])).otherwise(out), reversed(reasons), F.lit(None).cast("string"))
    return F.struct(F.when(reason.isNull(), "KNOWN").otherwise("UNDEFINED").alias("status"), F.when(reason.isNull(), value.cast("double")).alias("value"), reason.alias("reason"))


# identifiers


def cik10(x: Column) -> Column:
    """Ten digits of a company number given with or without zeros or the prefix CIK; null if it is none."""
    digits = F.regexp_extract(F.upper(F.trim(x.cast("string"))), r"^(?:CIK)?0*(\d{1,10})$", 1)
    return F.when(digits != "", F.lpad(digits, 10, "0"))


def company_id(x: Column) -> Column:
    return F.concat(F.lit("cik:"), cik10(x))


def accession(x: Column) -> Column:
    """Filing number as 10-2-6 digits, given with or without dashes."""
    digits = F.replace(F.trim(x), F.lit("-"), F.lit(""))
    return F.when(digits.rlike(r"^\d{18}$"), F.concat_ws("-", F.substr(digits, F.lit(1), F.lit(10)), F.substr(digits, F.lit(11), F.lit(2)), F.substr(digits, F.lit(13), F.lit(6))))


def is_amendment(form: Column) -> Column:
    """Whether a form's name, whatever its case and blanks around it, ends in /A."""
    return F.upper(F.trim(form)).endswith("/A")


def base_form(form: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(form)), "/A$", "")


def plain_name(x: Column) -> Column:
    """Names and tickers compared without case and repeated blanks; punctuation counts."""
    return F.trim(F.regexp_replace(F.upper(x), r"\s+", " "))


def looks_like_cik(x: Column) -> Column:
    """Up to ten digits, with or without the prefix CIK."""
    return F.upper(F.trim(x)).rlike(r"^(CIK)?\d{1,10}$")


def security_class(x: Column) -> Column:
    """A share class in lower case, its words joined by hyphens; null if it is blank or holds # or :."""
    plain = F.regexp_replace(F.trim(F.lower(x)), r"\s+", "-")
    return F.when((plain != "") & ~plain.rlike("[#:]"), plain)


def security_id(cik: Column, share_class: Column, figi: Column | None = None) -> Column:
    """figi:<id> where one is known, else cik:<number>#class:<class>; null if neither can be made."""
    own = F.concat(company_id(cik), F.lit("#class:"), security_class(share_class))
    return own if figi is None else F.when(F.trim(figi) != "", F.concat(F.lit("figi:"), F.trim(figi))).otherwise(own)


def company_of_security(x: Column) -> Column:
    """The company of a cik:... security; null for other ids."""
    return F.when(x.startswith("cik:"), F.regexp_extract(x, r"^([^#]*)", 1))


def slug(x: Column) -> Column:
    """A name that is safe in a path: runs of other characters become one hyphen."""
    return F.regexp_replace(x, r"[^A-Za-z0-9._-]+", "-")


def typed_text(x: Column) -> Column:
    """Text of a typed dimension: blanks at the ends go, runs of blanks become one."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


#: Beginnings of the namespaces of public taxonomies (fixed values).
TAXONOMIES = {
    "http://fasb.org/us-gaap/": "us-gaap", "http://xbrl.us/us-gaap/": "us-gaap", "http://xbrl.sec.gov/dei/": "dei", "http://xbrl.us/dei/": "dei", "http://fasb.org/srt/": "srt", "http://xbrl.sec.gov/srt/": "srt",
    "http://xbrl.ifrs.org/taxonomy/": "ifrs-full", "https://xbrl.ifrs.org/taxonomy/": "ifrs-full",
}


def taxonomy(namespace: Column) -> Column:
    """The public taxonomy of a namespace, custom for another one, unknown for none."""
    out = F.when(F.coalesce(namespace, F.lit("")) == "", "unknown")
    for stem, name in TAXONOMIES.items():
        out = out.when(namespace.startswith(stem), name)
    return out.otherwise("custom")


def content_id(*parts: Column) -> Column:
    """SHA-256 over the parts joined by NUL."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


# dates


def month(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "MM")


def add_months_sticky(d: Column, n: int) -> Column:
    """n months later; the last day of a month stays a last day."""
    return F.when(d == F.last_day(d), F.last_day(F.add_months(d, n))).otherwise(F.add_months(d, n))


def is_holiday(d: Column) -> Column:
    """US federal holidays of d's own year, on Friday or Monday where they fall on a weekend; Juneteenth from 2021.

    Each year has its own set, so 31 December is no holiday when New Year's Day of the next year falls on a Saturday."""
    fixed = lambda m, day: _observed(d, m, day)
    nth = lambda m, weekday, n: (F.month(d) == m) & (F.weekday(d) == weekday) & (F.ceil(F.day(d) / 7) == n)
    last_monday_may = (F.month(d) == 5) & (F.weekday(d) == 0) & (F.day(d) > 24)
    return fixed(1, 1) | nth(1, 0, 3) | nth(2, 0, 3) | last_monday_may | (fixed(6, 19) & (F.year(d) >= 2021)) | fixed(7, 4) | nth(9, 0, 1) | nth(10, 0, 2) | fixed(11, 11) | nth(11, 3, 4) | fixed(12, 25)


def _observed(d: Column, m: int, day: int) -> Column:
    is_day = lambda x: (F.month(x) == m) & (F.day(x) == day) & (F.year(x) == F.year(d))
    return is_day(d) & (F.weekday(d) < 5) | is_day(F.date_add(d, 1)) & (F.weekday(d) == 4) | is_day(F.date_sub(d, 1)) & (F.weekday(d) == 0)


def is_business_day(d: Column) -> Column:
    return (F.weekday(d) < 5) & ~is_holiday(d)


def next_business_day(d: Column) -> Column:
    """The first business day after d; at most four days follow one another without any."""
    return F.element_at(F.filter(F.sequence(F.date_add(d, 1), F.date_add(d, 6)), is_business_day), 1)


def month_end_business_days(spark, first: str, last: str) -> DataFrame:
    """day: the last business day of each month within [first, last]."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return days.where(is_business_day(F.col("day"))).groupBy(F.trunc("day", "MM")).agg(F.max("day").alias("day")).select("day")


def month_ends_within(bounds: DataFrame, by: Sequence[str], first: str, last: str) -> DataFrame:
    """by and day: the last business day of each month within the two dates of each row of bounds."""
    days = bounds.select(*by, F.explode(F.sequence(first, last)).alias("day")).where(is_business_day(F.col("day")))
    return days.groupBy(*by, F.trunc("day", "MM").alias("_month")).agg(F.max("day").alias("day")).drop("_month")


def _eastern(d: Column, clock: str) -> Column:
    return F.to_utc_timestamp(F.concat_ws(" ", d.cast("string"), F.lit(clock)).cast("timestamp"), "America/New_York")


def filing_available(accepted: Column, retrieved: Column, cutoff: str = "17:30:00") -> Column:
    """When a filing accepted at a UTC instant is public: the Eastern cutoff of that business day, else of the next; never before
    acceptance nor after retrieval. Unknown (null) without an acceptance and where it lies after the retrieval."""
    day = F.from_utc_timestamp(accepted, "America/New_York").cast("date")
    out = F.when(is_business_day(day) & (accepted <= _eastern(day, cutoff)), _eastern(day, cutoff)).otherwise(_eastern(next_business_day(day), cutoff))
    capped = F.least(F.greatest(out, accepted), retrieved)  # least leaves a missing retrieval out
    return F.when(accepted.isNotNull() & ~F.coalesce(accepted > retrieved, F.lit(False)), capped)


def market_available(session: Column, retrieved: Column, close: str = "16:00:00", lag_minutes: int = 240) -> Column:
    """When a session's prices are public: its Eastern close and a lag, never after retrieval; unknown (null) without a session or if retrieved before the close."""
    closed = _eastern(session, close)
    out = F.least(closed + F.expr(f"interval {lag_minutes} minutes"), retrieved)
    return F.when(session.isNotNull() & ~F.coalesce(retrieved < closed, F.lit(False)), out)


#: The policies to start with: (id, from, to, forms) of filings public at 17:30 Eastern, and of sessions public at 16:00 Eastern and 240 minutes.
FILING_POLICY = ("filing-1730-eastern", "2009-01-01", None, ("*",))
MARKET_POLICY = ("session-1600-eastern-240", "2007-01-01", None, ("*",))


def parse_utc(x: Column) -> Column:
    """An instant given with Z or an offset; null without one."""
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(x))


def format_utc(x: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(x, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


# numbers


def exact(text: Column) -> Column:
    """The exact number (see `numbers`) of a lexical value; null for what is no finite number."""
    return numbers.parse(text)


def plain_decimal(x: Column) -> Column:
    """The shortest plain text of an exact number: no trailing zeros, no exponent, no minus before 0."""
    return numbers.plain(x)


def folded(value: Column, scale: Column, sign: Column) -> Column:
    """An exact lexical value (thousands may have commas) with its power of ten and its sign ('-' or none). Null for what is no number; a bad scale or sign is an error."""
    return numbers.folded(value, scale, sign, commas=True)


def to_decimals(value: Column, decimals: Column) -> Column:
    """value rounded half up to 10^-decimals."""
    unit = F.pow(F.lit(10.0), decimals.cast("double"))
    return F.signum(value) * F.floor(F.abs(value) * unit + F.lit(0.5)) / unit


def normal_cdf(x: Column, terms: int = 60) -> Column:
    """Phi by the series of erf up to 3 in size, by the continued fraction of its tail beyond; within [0, 1]."""
    z = x / F.lit(2**0.5)
    step = lambda s, k: F.struct((-s["t"] * z * z / k).alias("t"), (s["sum"] - s["t"] * z * z / k / (k * 2 + 1)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(z.alias("t"), z.alias("sum")), step, lambda s: s["sum"])
    inside = F.lit(0.5) * (F.lit(1.0) + F.lit(2 / 3.141592653589793**0.5) * series)
    size = F.abs(x)
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1)), size, lambda f, k: size + k / f)
    tail = F.exp(-x * x / 2) / (F.lit((2 * 3.141592653589793) ** 0.5) * fraction)
    return F.when(x > 3, F.lit(1.0) - tail).when(x < -3, tail).otherwise(inside)


#: Coefficients of Acklam's public rational approximation to the inverse normal distribution (fixed values).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _poly(coefficients: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda out, c: out * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_ppf(p: Column) -> Column:
    """Inverse of normal_cdf: a rational approximation (within 1e-9), then two Newton steps; null outside (0, 1)."""
    q = F.least(p, F.lit(1.0) - p)
    t = F.sqrt(F.lit(-2.0) * F.ln(q))
    low = _poly(_C, t) / _poly(_D, t)
    r = p - F.lit(0.5)
    middle = r * _poly(_A, r * r) / _poly(_B, r * r)
    first = F.when(q >= 0.02425, middle).when(p < 0.5, low).otherwise(-low)
    newton = lambda x: x - (normal_cdf(x) - p) * F.lit((2 * 3.141592653589793) ** 0.5) * F.exp(x * x / 2)
    refined = F.aggregate(F.sequence(F.lit(1), F.lit(2)), first, lambda x, _: newton(x))
    return F.when((p > 0) & (p < 1), refined)


def harmonic(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda a, k: a + F.lit(1.0) / k)


# units


def canonical_unit(numerator: Column, denominator: Column) -> Column:
    """struct<unit,currency> of arrays of measures ({namespace}name) above and below the line: a currency, shares, pure, a currency a
    share; all else, and no unit, is unknown."""
    one = lambda m: F.when(F.size(m) == 1, m[0])
    top, bottom = one(numerator), one(denominator)
    code = F.when(top.startswith("{http://www.xbrl.org/2003/iso4217}"), F.regexp_replace(top, r"^\{[^}]*\}", ""))
    own = lambda m, name: m == f"{{http://www.xbrl.org/2003/instance}}{name}"
    simple = F.coalesce(F.size(denominator), F.lit(0)) <= 0
    unit = F.when(simple & code.isNotNull(), code).when(simple & own(top, "shares"), "shares").when(simple & own(top, "pure"), "pure").when(~simple & code.isNotNull() & own(bottom, "shares"), F.concat(code, F.lit("/shares"))).otherwise("unknown")
    return F.struct(unit.alias("unit"), F.when(unit != "unknown", code).alias("currency"))


def unit_family(unit: Column, currency: Column) -> Column:
    """monetary, shares or pure; null for what takes part in no formula."""
    return F.when(currency.isNotNull() & (unit == currency), "monetary").when(unit.isin("shares", "pure"), unit)


def sum_unit(a: Column, b: Column) -> Column:
    """Unit of a sum or difference: that of both; null where they differ (nothing is converted)."""
    return F.when(a == b, a)


def quotient_unit(a: Column, b: Column) -> Column:
    """Unit of a quotient of equal units: pure; null for others."""
    return F.when(a == b, F.lit("pure"))


def factor_unit(a: Column, b: Column) -> Column:
    """Unit of a product, of which one factor must be pure; null for others."""
    return F.when(a == "pure", b).when(b == "pure", a)


def canonical_period(kind: Column, start: Column, end: Column) -> Column:
    """struct<period_type,period_start,period_end>; a kind that lacks its dates is an error."""
    bad = (kind == "instant") & end.isNull() | (kind == "duration") & (start.isNull() | end.isNull())
    checked = F.when(bad, F.raise_error(F.lit("a period lacks its dates")).cast("string")).otherwise(kind)
    return F.struct(checked.alias("period_type"), F.when(kind == "duration", start).alias("period_start"), F.when(kind != "forever", end).alias("period_end"))


# measures of a product or quotient: arrays above and below the line


def unit_product(a: Column, b: Column) -> Column:
    """Sorted measures of a product or, with b's parts swapped, a quotient; what is both above and below cancels once."""
    num, den = F.concat(a["num"], b["num"]), F.concat(a["den"], b["den"])
    return F.struct(F.array_sort(F.array_except(num, den)).alias("num"), F.array_sort(F.array_except(den, num)).alias("den"))


def dimensions_key(dimensions: Column) -> Column:
    """Canonical key of array<struct<axis,member>>: pairs in order."""
    return F.array_join(F.array_sort(F.transform(dimensions, lambda d: F.concat_ws("=", d["axis"], d["member"]))), ";")


def clark(x: Column) -> Column:
    """struct<namespace,local> of {namespace}local."""
    return F.struct(F.regexp_extract(x, r"^\{([^}]*)\}", 1).alias("namespace"), F.regexp_replace(x, r"^\{[^}]*\}", "").alias("local"))
