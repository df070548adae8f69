"""Exact decimal numbers of any size and scale: a struct of sign (-1, 0, 1), digits (without zeros at either end) and exponent.

The value is sign x digits x 10^exponent, and each value has one such form, so equal numbers are equal structs: they can be grouped and joined as they are.
Nothing has a fixed scale or width. All functions are expressions; null gives null. Sums are made of limbs of six digits, added as integers limb by limb, so
they depend neither on the order of rows nor on their partitions, and an aggregation combines them before it shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = "struct<sign:int,digits:string,exponent:bigint>"
LIMB = 6
BASE = 10**LIMB
#: Numbers whose places or limbs would be more than this are an error where they are written out.
MOST = 1_000_000
_OFFSET = 10**16


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is made once, however often the body names it (a plain Column would be written out, and so grow, each time)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _div(a: Column, b: int) -> Column:
    """a / b as whole numbers, without a double between."""
    return F.call_function("div", a.cast("bigint"), F.lit(b).cast("bigint"))


def _made(sign: Column, digits: Column, exponent: Column) -> Column:
    """The one form of sign x digits x 10^exponent, for digits with zeros at their ends."""

    def form(lead: Column) -> Column:
        short = F.rtrim(lead, F.lit("0"))
        number = F.struct(sign.cast("int").alias("sign"), short.alias("digits"), (exponent + F.length(lead) - F.length(short)).cast("bigint").alias("exponent"))
        return F.when(lead != "", number).otherwise(F.struct(F.lit(0).alias("sign"), F.lit("").alias("digits"), F.lit(0).cast("bigint").alias("exponent")))

    return _let(F.ltrim(digits, F.lit("0")), form)


def parse(text: Column, commas: bool = False) -> Column:
    """The number of a lexical value (blanks at its ends go); null for what is no finite number. Commas between digits are no part of a number unless asked for."""

    def number(plain: Column) -> Column:
        part = lambda i: F.regexp_extract(plain, r"^([+-]?)(\d*)\.?(\d*)(?:[eE]([+-]?\d+))?$", i)
        power = F.when(part(4) == "", 0).otherwise(part(4).try_cast("bigint"))
        made = _made(F.when(part(1) == "-", -1).otherwise(1), F.concat(part(2), part(3)), power - F.length(part(3)))
        return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,15})?$"), made)

    plain = F.regexp_replace(text, r"^\s+|\s+$", "")
    return _let(F.replace(plain, F.lit(","), F.lit("")) if commas else plain, number)


def folded(value: Column, scale: Column, sign: Column, commas: bool = False) -> Column:
    """A lexical value with its power of ten and its sign ('-' or none) folded in. Null for what is no number; a number's bad scale or sign is an error."""
    power = F.coalesce(F.nullif(F.trim(scale.cast("string")), F.lit("")), F.lit("0"))
    bad = ~power.rlike(r"^[+-]?\d{1,9}$") | ~F.coalesce(sign.cast("string"), F.lit("")).isin("", "-")
    failed = F.raise_error(F.concat(F.lit("bad scale or sign: "), power)).cast(NUMBER)

    def made(number: Column) -> Column:
        shifted = F.when(number["sign"] == 0, 0).otherwise(number["exponent"] + power.try_cast("bigint"))
        out = F.struct(F.when(sign == "-", -number["sign"]).otherwise(number["sign"]).alias("sign"), number["digits"].alias("digits"), shifted.alias("exponent"))
        return F.when(number.isNotNull() & bad, failed).when(number.isNotNull(), out)

    return _let(parse(value, commas), made)


def negated(x: Column) -> Column:
    return _let(x, lambda v: F.when(v.isNotNull(), F.struct((-v["sign"]).alias("sign"), v["digits"].alias("digits"), v["exponent"].alias("exponent"))))


def plain(x: Column) -> Column:
    """The shortest plain text: no exponent, no zeros behind the last digit of a fraction, 0 without a sign."""

    def body(x: Column) -> Column:
        n, e = F.length(x["digits"]), x["exponent"]
        far = F.abs(e) > MOST
        zeros = F.repeat(F.lit("0"), F.greatest(F.abs(e), n.cast("bigint")).cast("int"))
        whole = F.concat(x["digits"], F.left(zeros, e.cast("int")))
        padded = F.concat(F.left(zeros, F.greatest(-e - n + 1, F.lit(0)).cast("int")), x["digits"])
        split = F.length(padded) + e
        point = F.concat(F.left(padded, split.cast("int")), F.lit("."), F.right(padded, (-e).cast("int")))
        text = F.concat(F.when(x["sign"] < 0, "-").otherwise(""), F.when(e >= 0, whole).otherwise(point))
        return F.when(far, F.raise_error(F.lit("a number of too many places to write out")).cast("string")).when(x["sign"] == 0, "0").otherwise(text)

    return _let(x, body)


def order_key(x: Column) -> Column:
    """Text that sorts as the numbers do: sign, place of the first digit, digits (turned round below 0)."""

    def body(x: Column) -> Column:
        place = F.length(x["digits"]) + x["exponent"]
        above = F.concat(F.lit("2"), F.lpad((place + _OFFSET).cast("string"), 17, "0"), x["digits"])
        below = F.concat(F.lit("0"), F.lpad((F.lit(_OFFSET) - place).cast("string"), 17, "0"), F.translate(x["digits"], "0123456789", "9876543210"), F.lit(":"))
        return F.when(x["sign"] > 0, above).when(x["sign"] < 0, below).when(x["sign"] == 0, "1")

    return _let(x, body)


def rounded(x: Column, decimals: Column) -> Column:
    """x rounded half up (away from 0) to 10^-decimals."""

    def body(x: Column) -> Column:
        drop = -decimals.cast("bigint") - x["exponent"]  # digits to go
        n = F.length(x["digits"])
        kept = F.when(drop > n, "").otherwise(F.left(x["digits"], (n - drop).cast("int")))
        first_gone = F.when(drop > n, "0").otherwise(F.substr(x["digits"], (n - drop + 1).cast("int"), F.lit(1)))
        stem = F.rtrim(kept, F.lit("9"))
        last = F.when(stem == "", "1").otherwise((F.right(stem, F.lit(1)).try_cast("int") + 1).cast("string"))
        raised = F.concat(F.left(stem, F.greatest(F.length(stem) - 1, F.lit(0))), last, F.repeat(F.lit("0"), F.length(kept) - F.length(stem)))
        made = _made(x["sign"], F.when(first_gone >= "5", raised).otherwise(kept), -decimals.cast("bigint"))
        return F.when(x.isNull() | decimals.isNull(), F.lit(None).cast(NUMBER)).when((drop <= 0) | (x["sign"] == 0), x).otherwise(made)

    return _let(x, body)


# sums


def limbs(x: Column) -> Column:
    """array<struct<at,v>>: x as a sum of v x 10^(6 at), each |v| below 10^6; none for 0."""

    def body(x: Column) -> Column:
        shift = F.pmod(x["exponent"], F.lit(LIMB)).cast("int")
        digits = F.concat(x["digits"], F.repeat(F.lit("0"), shift))
        n = F.ceil(F.length(digits) / LIMB).cast("int")
        whole = F.lpad(digits, n * LIMB, F.lit("0"))
        low = _div(x["exponent"] - shift, LIMB)
        made = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((low + i - 1).alias("at"), (F.substr(whole, (n - i) * LIMB + 1, F.lit(LIMB)).cast("bigint") * x["sign"]).alias("v")))
        return F.when(x["sign"] == 0, F.array().cast("array<struct<at:bigint,v:bigint>>")).otherwise(made)

    return _let(x, body)


def from_limbs(held: Column) -> Column:
    """The number of array<struct<at,v>>; several v may stand at one place. Carries go up from the lowest place."""

    def body(held: Column) -> Column:
        places = F.transform(held, lambda s: s["at"])
        low, high = F.array_min(places), F.array_max(places) + 5  # carries of sums of 64 bits end within four more places
        dense = F.when(high - low > MOST, F.raise_error(F.lit("numbers too far apart to add")).cast("array<bigint>")).otherwise(F.sequence(low, high))
        ordered = F.array_sort(held)

        def carried(sign: int) -> Column:
            start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.lit("").alias("digits"))

            def step(s: Column, at: Column) -> Column:
                here = F.aggregate(F.filter(ordered, lambda h: h["at"] == at), F.lit(0).cast("bigint"), lambda a, h: a + h["v"] * sign) + s["carry"]
                return _let(here, lambda v: F.struct(_div(v - F.pmod(v, F.lit(BASE)), BASE).alias("carry"), F.concat(F.lpad(F.pmod(v, F.lit(BASE)).cast("string"), LIMB, "0"), s["digits"]).alias("digits")))

            return F.aggregate(dense, start, step)

        up = carried(1)
        number = F.when(up["carry"] < 0, _made(F.lit(-1), carried(-1)["digits"], low * LIMB)).otherwise(_made(F.lit(1), up["digits"], low * LIMB))
        return F.when(F.size(held) > 0, number).when(F.size(held) == 0, _made(F.lit(0), F.lit(""), F.lit(0)))

    return _let(held, body)


def added(a: Column, b: Column) -> Column:
    return from_limbs(F.concat(limbs(a), limbs(b)))


def compared(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    both = F.struct(order_key(a).alias("x"), order_key(b).alias("y"))
    return _let(both, lambda s: F.when(s["x"] < s["y"], -1).when(s["x"] > s["y"], 1).when(s["x"] == s["y"], 0))


def totals(df: DataFrame, by: Sequence[str], value: str, name: str = "total") -> DataFrame:
    """by, n (known values) and the exact sum of a column of numbers (null without any). Limbs are summed by place first, so no group holds its rows; a limb holds
    9e12 rows before its sum overflows, which is an error."""
    rows = df.select(*by, F.col(value).isNotNull().cast("bigint").alias("_n"), F.explode_outer(F.concat(limbs(F.col(value)), F.array(F.struct(F.lit(None).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("v"))))).alias("_l"))
    count = F.when(F.col("_l.at").isNull(), F.col("_n")).otherwise(0)
    places = rows.groupBy(*by, F.col("_l.at").alias("_at")).agg(F.sum(count).alias("_n"), F.sum("_l.v").alias("_v"))
    limb = F.when(F.col("_at").isNotNull(), F.struct(F.col("_at").alias("at"), F.col("_v").alias("v")))
    held = places.groupBy(*by).agg(F.sum("_n").alias("n"), F.collect_list(limb).alias("_held"))
    return held.select(*by, "n", F.when(F.col("n") > 0, from_limbs(F.col("_held"))).alias(name))
