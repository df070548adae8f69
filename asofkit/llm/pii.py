"""Operator 9: personal data replaced by surrogates, by DataFrame functions alone.

One expression finds e-mail addresses, phone and card numbers, IP addresses, account numbers, secrets and names after a
title, in one pass. In texts with names, another pass also finds all mentions of the persons named there: full, first or last name, with
a title or without. Each entity is replaced by a keyed surrogate of its type: digits by digits, letters by letters of
their case and script, punctuation kept; card numbers keep their issuer digit and whether their check digit is right; names keep
title, gender and script. A name's surrogate is made of those of its parts (a first name with its gender, a last name), so that all mentions of
a person agree within a text and between texts (coreference). Surrogates depend on the key, the type and the entity in
normal form (without case and punctuation where these vary) alone and are then put into the spelling, so one entity has one surrogate in all spellings.

Distinct entities must stay distinct, which normal forms show, for they are what a spelling is made of: over all entities of all texts, those whose surrogate another entity also
has, or that is itself an entity of the texts, get another attempt until none is left; later attempts draw from more surrogates. Only entities
with more than one attempt (few) are brought back to the texts: by a broadcast if they are at most `broadcast_rows`, else by a join.

Texts cut at their entities are written once to the shared folder, with the other columns, and all that follows reads them there.

Null texts count as empty; texts without entities come back as they are. Repeated rows and ids are kept. Columns other than
the text stay as they are; where one has the name of an added column, the added one gets an underscore behind its name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import written

#: One name: also O'Neil, Jean-Luc, McDonald.
NAME = r"(?:\p{Lu}['’])?(?:\p{Lu}\p{Ll}+)+(?:['’\-](?:\p{Lu}\p{Ll}+)+)*"
#: What the patterns find, tried in this order at each position.
PATTERNS = (
    ("email", r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?\.[A-Za-z]{2,}+"),
    ("ip", r"(?<![\p{L}\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"),
    ("card", r"(?<![\p{L}\d])\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{1,7}(?!\d)"),
    ("ssn", r"(?<![\p{L}\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("phone", r"(?<![\p{L}\d+])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|(?<![\p{L}\d+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d)|(?<![\p{L}\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])"),
    ("iban", r"(?<![\p{L}\d])(?![0-9A-F]{32})[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])"),
    ("secret", r"(?<![\p{L}\d])(?:[0-9a-fA-F]{32,}+|(?i:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Z0-9]{20,}+|github_pat_[A-Z0-9_]{20,}+|sk-[A-Z0-9]{20,}+)|eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+)(?![\p{L}\d])"),
    ("name", rf"(?<!\p{{L}})(?:Mr|Mrs|Ms|Miss|Herr|Frau|Mme|Mlle|Sr|Sra|Señor|Señora|Г-н|Г-жа)\.? {NAME}(?: {NAME}){{0,3}}"),
)
TITLE = r"^(?:Mr|Mrs|Ms|Miss|Herr|Frau|Mme|Mlle|Sr|Sra|Señor|Señora|Г-н|Г-жа)\.? "
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Mme|Mlle|Sra|Señora|Г-жа)\b"

def _any(kinds: dict[str, str]) -> str:
    """One expression for all patterns: inside a word it fails at once, at a word's start its first character picks the branch."""
    of = lambda *names: "|".join(f"(?:{kinds[n]})" for n in names if n in kinds) or "(?!)"
    numbers, capitals, other = of("email", "ip", "card", "ssn", "phone", "secret"), of("email", "iban", "secret", "name"), of("email", "secret")
    return rf"(?<![\p{{L}}\p{{N}}])(?:(?=[\d+(])(?:{numbers})|(?=\p{{Lu}})(?:{capitals})|(?=\P{{Lu}})(?![\d+(\s])(?:{other}))"


ANY = _any(dict(PATTERNS))
NO_EMAIL = _any({k: p for k, p in PATTERNS if k != "email"})
#: Syllables for names, by script (fixed values).
LATIN = "ba be bi bo da de di do fa fe ga go ka ke ki ko la le li lo ma me mi mo na ne".split()
CYRILLIC = "ба бе би бо да де ди до фа фе га го ка ке ки ко ла ле ли ло ма ме ми мо на не".split()
HEX = "0123456789abcdef"
#: Letters of a script by its name in regular expressions: small ones and, where it has them, capitals (ranges of Unicode).
SCRIPTS = (
    ("IsCyrillic", (0x430, 0x450), (0x410, 0x430)), ("IsGreek", (0x3B1, 0x3C2), (0x391, 0x3A2)), ("IsArmenian", (0x561, 0x587), (0x531, 0x557)), ("IsHebrew", (0x5D0, 0x5EB), None), ("IsArabic", (0x628, 0x63B), None), ("IsDevanagari", (0x915, 0x93A), None),
    ("IsThai", (0xE01, 0xE2F), None), ("IsHangul", (0xAC00, 0xAD00), None), ("IsHiragana", (0x3042, 0x3094), None), ("IsKatakana", (0x30A2, 0x30F4), None), ("IsHan", (0x4E00, 0x4F00), None), ("IsGeorgian", (0x10D0, 0x10F1), None),
)
#: Calling codes of one and two digits; all others have three (fixed values).
CALLING_1 = "1 7".split()
CALLING_2 = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
SECRET_PREFIX = r"^(?i:AKIA|gh[pousr]_|github_pat_|sk-|(?-i:eyJ))"
#: Goes round entities while a text is cut; texts that hold it are cut in another way.
MARK = "\uffff"


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(PATTERNS[:-1]):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def gender_of(entity: Column) -> Column:
    return F.when(entity.rlike(FEMALE), F.lit("f")).otherwise(F.lit("m"))


def normal_of(kind: Column, entity: Column) -> Column:
    """The form that spellings of one entity share."""
    return (
        F.when(kind.isin("card", "ssn"), F.regexp_replace(entity, r"\D", ""))
        .when(kind == "phone", F.concat(F.when(entity.startswith("+"), "+").otherwise(""), F.regexp_replace(entity, r"\D", "")))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when((kind == "email") | ((kind == "secret") & entity.rlike("^[0-9a-fA-F]+$")), F.lower(entity))
        .otherwise(entity)
    )


def _digest(key: str, kind: Column, normal: Column, attempt: Column) -> Column:
    seed = F.concat(F.lit(key), F.lit("\n"), kind, F.lit("\n"), normal, F.lit("\n"), attempt.cast("string"))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(F.lit("2\n"), seed), 256))


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substr(digest, (i % F.lit(64)) * F.lit(2) + F.lit(1), F.lit(2)), 16, 10).cast("int")


def _luhn(digits: Column) -> Column:
    """The check sum modulo 10 of a string of digits whose last one counts once."""
    n = F.length(digits)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v % 10 + F.when(v > 9, 1).otherwise(0)) % 10


def _digits(n: Column, digest: Column) -> Column:
    return F.concat_ws("", F.transform(F.sequence(F.lit(1), n), lambda i: (_byte(digest, i) % 10).cast("string")))


def _refilled(entity: Column, made: Column) -> Column:
    """entity with its digits and letters replaced by those of `made`, in order: a surrogate in the spelling of its entity."""
    chars, plain = F.split(entity, ""), F.regexp_replace(made, r"[^0-9A-Za-z]", "")
    step = lambda s, c: F.when(c.rlike("^[0-9A-Za-z]$"), F.struct((s["n"] + 1).alias("n"), F.concat(s["out"], F.substr(plain, s["n"] + 1, F.lit(1))).alias("out"))).otherwise(F.struct(s["n"].alias("n"), F.concat(s["out"], c).alias("out")))
    return F.aggregate(chars, F.struct(F.lit(0).alias("n"), F.lit("").alias("out")), step, lambda s: s["out"])


def _letter(b: Column, first: int, end: int) -> Column:
    return F.substr(F.lit("".join(map(chr, range(first, end)))), b % (end - first) + 1, F.lit(1))


def _alike(text: Column, digest: Column) -> Column:
    """Each digit or letter replaced by another of its class and script (Latin where the script is not among SCRIPTS); the rest stays."""
    n = F.length(text)

    def put(i: Column) -> Column:
        c, b = F.substr(text, i, F.lit(1)), _byte(digest, i)
        latin = F.when(c.rlike(r"\p{Lu}"), _letter(b, 65, 91)).otherwise(_letter(b, 97, 123))
        other = latin
        for script, small, capital in SCRIPTS:
            own = _letter(b, *small)
            other = F.when(c.rlike(rf"\p{{{script}}}"), F.when(c.rlike(r"\p{Lu}"), _letter(b, *capital)).otherwise(own) if capital else own).otherwise(other)
        return F.when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike("[A-Za-z]"), latin).when(c.rlike(r"\p{L}"), other).otherwise(c)

    return F.when(n > 0, F.concat_ws("", F.transform(F.sequence(F.lit(1), n), put))).otherwise("")


def _syllables(normal: Column, digest: Column, first: int, n: Column) -> Column:
    """n syllables of the name's script, with a capital."""
    latin, cyrillic = (F.array(*[F.lit(x) for x in xs]) for xs in (LATIN, CYRILLIC))
    list_ = F.when(normal.rlike(r"\p{IsCyrillic}"), cyrillic).otherwise(latin)
    return F.initcap(F.concat_ws("", F.transform(F.sequence(F.lit(first), n + (first - 1)), lambda i: F.get(list_, _byte(digest, i) % len(LATIN)))))


def _first_name(normal: Column, digest: Column, more: Column) -> Column:
    """Three syllables or more, ending by gender; normal: gender, blank, name."""
    is_cyrillic = normal.rlike(r"\p{IsCyrillic}")
    ending = F.when(normal.startswith("f "), F.when(is_cyrillic, F.lit("а")).otherwise(F.lit("a"))).otherwise(F.when(is_cyrillic, F.lit("н")).otherwise(F.lit("n")))
    return F.concat(_syllables(normal, digest, 1, more + 3), ending)


def _last_name(normal: Column, digest: Column, more: Column) -> Column:
    """Five syllables or more, ending in a vowel: never a first name."""
    return _syllables(normal, digest, 21, more + 5)


def parts_of(text: Column, pattern: Column) -> Column:
    """array<string>: what lies before the first entity, the first entity, what lies between it and the second, ..."""
    marked = F.split(F.regexp_replace(text, pattern, F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    gaps, entities = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.flatten(F.zip_with(gaps, F.concat(entities, F.array(F.lit(""))), lambda g, e: F.array(g, e)))
    return F.when(text.contains(MARK), F.slice(pairs, F.lit(1), F.size(pairs) - 1)).otherwise(marked)


def _people(parts: Column) -> Column:
    """array<struct<gender,names>> of the names after a title: one name (taken for the last), or given names and a last one."""
    titled = F.filter(parts, lambda x, i: (i % 2 == 1) & x.rlike(TITLE))
    return F.transform(titled, lambda x: F.struct(gender_of(x).alias("gender"), F.split(F.regexp_replace(x, TITLE, ""), " ").alias("names")))


def _mentions(people: Column) -> Column:
    """The pattern of all entities and, besides, all mentions of these people; names are letters, apostrophes and hyphens."""
    names = F.array_distinct(F.flatten(F.transform(people, lambda p: F.concat(p["names"], F.array(F.array_join(p["names"], " "))))))
    longest_first = F.array_sort(names, lambda a, b: F.length(b) - F.length(a))
    return F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?=\p{Lu})(?:"), F.array_join(longest_first, "|"), F.lit(r")(?![\p{L}\p{N}])"))


def _units_of_name(entity: Column, people: Column) -> Column:
    """array<struct<kind,normal>>: the parts of a name, given names with their gender. Without a title, the people of the text tell."""
    names, titled = F.split(F.regexp_replace(entity, TITLE, ""), " "), entity.rlike(TITLE)
    several, given, last = F.size(names) > 1, names[0], F.element_at(names, -1)
    full = F.filter(people, lambda p: F.size(p["names"]) > 1)
    given_of = lambda p: F.slice(p["names"], F.lit(1), F.size(p["names"]) - 1)
    same = F.filter(full, lambda p: F.array_contains(given_of(p), given) & (~several | (F.element_at(p["names"], -1) == last)))
    gender = F.when(titled & (several | (F.size(same) == 0)), gender_of(entity)).otherwise(F.coalesce(F.get(same, F.lit(0))["gender"], gender_of(entity)))
    unit = lambda kind, normal: F.struct(F.lit(kind).alias("kind"), normal.alias("normal"))
    firsts = F.transform(F.slice(names, F.lit(1), F.size(names) - 1), lambda n: unit("first", F.concat(gender, F.lit(" "), n)))
    only_first = (F.size(same) > 0) & ~F.exists(full, lambda p: F.element_at(p["names"], -1) == given)
    return F.when(several, F.concat(firsts, F.array(unit("last", last)))).when(only_first, F.array(unit("first", F.concat(gender, F.lit(" "), given)))).otherwise(F.array(unit("last", given)))


def _described(parts: Column, people: Column) -> Column:
    """array<struct<entity,kind,units>> of the entities among the parts."""
    with_kind = F.transform(F.filter(parts, lambda _, i: i % 2 == 1), lambda e: F.struct(e.alias("entity"), kind_of(e).alias("kind")))
    units = lambda s: F.when(s["kind"] == "name", _units_of_name(s["entity"], people)).otherwise(F.array(F.struct(s["kind"].alias("kind"), normal_of(s["kind"], s["entity"]).alias("normal"))))
    return F.transform(with_kind, lambda s: F.struct(s["entity"].alias("entity"), s["kind"].alias("kind"), units(s).alias("units")))


def cut(df: DataFrame, text_col: str = "text") -> DataFrame:
    """uid, other (struct of the other columns, if any), gaps, entities: a row for each row; gaps are one more than the entities."""
    other = [F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col]).alias("other")] if len(df.columns) > 1 else []
    rows = df.select(F.monotonically_increasing_id().alias("uid"), *other, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    first = F.when(F.col("text").contains("@"), parts_of(F.col("text"), F.lit(ANY))).otherwise(parts_of(F.col("text"), F.lit(NO_EMAIL)))
    rows = rows.withColumn("found", first).withColumn("people", _people(F.col("found")))
    rows = rows.withColumn("parts", F.when(F.size("people") > 0, parts_of(F.col("text"), _mentions(F.col("people")))).otherwise(F.col("found")))
    return rows.select("uid", *(["other"] if other else []), F.filter("parts", lambda _, i: i % 2 == 0).alias("gaps"), _described(F.col("parts"), F.col("people")).alias("entities"))


def units_of(held: DataFrame) -> DataFrame:
    """uid, kind, normal: a row for each unit of each entity."""
    return held.select("uid", F.explode("entities").alias("e")).select("uid", F.explode("e.units").alias("u")).select("uid", "u.kind", "u.normal")


def _country(normal: Column) -> Column:
    """How many digits of a phone number in normal form are its calling code; none without a +."""
    size = F.when(F.substr(normal, F.lit(2), F.lit(1)).isin(*CALLING_1), 1).when(F.substr(normal, F.lit(2), F.lit(2)).isin(*CALLING_2), 2).otherwise(3)
    return F.when(normal.startswith("+"), size).otherwise(0)


def _surrogate(kind: Column, normal: Column, d: Column, attempt: Column) -> Column:
    """The surrogate of an entity, in normal form as the entity is: it depends on no spelling."""
    n, more = F.length(normal), F.least(F.floor(attempt / 2), F.lit(12)).cast("int")
    body = F.concat(F.substr(normal, F.lit(1), F.lit(1)), _digits(n - 2, d))
    check = (_luhn(normal) - _luhn(F.concat(body, F.lit("0"))) + 10) % 10
    kept = F.when(normal.startswith("+"), _country(normal) + 1).otherwise(0)  # of a phone number: + and calling code
    net = F.when(attempt < 4, F.lit(10)).otherwise(F.lit(11) + _byte(d, F.lit(4)) % 116)
    octets = F.concat_ws(".", net.cast("string"), *[_byte(d, F.lit(i)).cast("string") for i in (1, 2, 3)])
    at = F.instr(normal, "@")
    domain = F.regexp_extract(normal, r"@(.*)\.[^.]*$", 1)
    email = F.concat(_alike(F.substr(normal, F.lit(1), at - 1), d), F.lit("@"), _alike(domain, F.substr(d, F.lit(65), F.lit(64))), F.regexp_extract(normal, r"(\.[^.]*)$", 1))
    hexes = F.concat_ws("", F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(F.lit(HEX), _byte(d, i) % 16 + 1, F.lit(1))))
    prefix = F.regexp_extract(normal, SECRET_PREFIX, 0)
    return (
        F.when(kind == "first", _first_name(normal, d, more))
        .when(kind == "last", _last_name(normal, d, more))
        .when(kind == "email", email)
        .when(kind == "ip", octets)
        .when(kind == "card", F.concat(body, check.cast("string")))
        .when(kind == "phone", F.concat(F.substr(normal, F.lit(1), kept), _digits(n - kept, d)))
        .when(kind == "ssn", _digits(n, d))
        .when(kind == "iban", F.concat(F.substr(normal, F.lit(1), F.lit(2)), _alike(F.substr(normal, F.lit(3)), d)))
        .when(normal.rlike("^[0-9a-f]+$"), hexes)
        .otherwise(F.concat(prefix, _alike(F.substr(normal, F.length(prefix) + 1), d)))
    )


def _spelled(kind: Column, entity: Column, made: Column) -> Column:
    """A surrogate in the spelling of the entity: separators and the case of hexadecimal digits."""
    shouted = (kind == "secret") & entity.rlike("^[0-9A-F]+$") & (F.lower(entity) != entity)
    return F.when(kind.isin("card", "phone", "ssn", "iban"), _refilled(entity, made)).when(shouted, F.upper(made)).otherwise(made)


def surrogates(entities: Column, attempt_of: Callable[[Column], Column], key: str) -> Column:
    """array<string>: the surrogate of each struct<entity,kind,units>."""
    with_attempt = lambda u: F.struct(u["kind"].alias("kind"), u["normal"].alias("normal"), attempt_of(u).alias("attempt"))
    with_digest = lambda u: F.struct(u["kind"].alias("kind"), u["normal"].alias("normal"), u["attempt"].alias("attempt"), _digest(key, u["kind"], u["normal"], u["attempt"]).alias("digest"))
    worked = F.transform(entities, lambda s: F.struct(s["entity"].alias("entity"), s["kind"].alias("kind"), F.transform(F.transform(s["units"], with_attempt), with_digest).alias("units")))

    def put(s: Column) -> Column:
        made = F.transform(s["units"], lambda u: _surrogate(u["kind"], u["normal"], u["digest"], u["attempt"]))
        return F.when(s["kind"] == "name", F.concat(F.regexp_extract(s["entity"], TITLE, 0), F.array_join(made, " "))).otherwise(_spelled(s["kind"], s["entity"], made[0]))

    return F.transform(worked, put)


def later_attempts(units: DataFrame, key: str, idle_rounds: int = 30) -> DataFrame | None:
    """kind, normal, attempt of the units whose first surrogate is not theirs alone; None if there are none.

    Rounds go on while they settle units; only after `idle_rounds` rounds in a row that settle none (there are no more surrogates of
    some form) is there an error."""
    spark = units.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = written(units.select("kind", "normal").distinct())
    kind, normal = F.col("kind"), F.col("normal")

    def given(df: DataFrame) -> DataFrame:
        made = _surrogate(kind, normal, _digest(key, kind, normal, F.col("attempt")), F.col("attempt"))
        named = F.when(kind == "first", F.concat(F.substr(normal, F.lit(1), F.lit(2)), F.col("_made"))).otherwise(F.col("_made"))
        return df.repartition(tasks, "kind", "normal").withColumn("_made", made).withColumn("surrogate", named).drop("_made")

    waiting, settled, done, idle, left = distinct.withColumn("attempt", F.lit(0)), None, [], 0, None
    while True:
        tried = written(given(waiting))
        # of the units with one surrogate the least keeps it, unless a unit of the texts or an earlier surrogate is the same
        winners = tried.groupBy("kind", "surrogate").agg(F.min("normal").alias("winner"))
        taken = distinct.select("kind", normal.alias("surrogate"))
        if settled is not None:
            taken = taken.unionByName(settled)
        winners = winners.join(taken, ["kind", "surrogate"], "left_anti")
        marked = tried.join(winners, ["kind", "surrogate"], "left").withColumn("kept", F.coalesce(F.col("winner") == normal, F.lit(False)))
        marked = written(marked.select("kind", "normal", "attempt", "surrogate", "kept"))
        kept = marked.where("kept")
        if done or settled is not None:
            done.append(kept.select("kind", "normal", "attempt"))
        settled = kept.select("kind", "surrogate") if settled is None else settled.unionByName(kept.select("kind", "surrogate"))
        waiting = marked.where("not kept").select("kind", "normal", (F.col("attempt") + 1).alias("attempt"))
        before, left = left, waiting.count()
        if not left:
            return reduce(DataFrame.unionByName, done) if done else None
        idle = idle + 1 if left == before else 0
        if idle >= idle_rounds:
            raise ValueError(f"{left} entities are left for which there is no surrogate of their own")


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def pseudonymised(df: DataFrame, key: str, text_col: str = "text", broadcast_rows: int = 50_000) -> DataFrame:
    """df with surrogates in its text, and n_entities and entity_kinds (sorted, distinct) added."""
    held = written(cut(df, text_col))
    later = later_attempts(units_of(held), key)
    if later is None:
        marked = held.withColumn("later", F.lit(None).cast("map<string,int>"))
    else:
        few = later.limit(broadcast_rows + 1).count() <= broadcast_rows
        own = units_of(held).join(F.broadcast(later) if few else later, ["kind", "normal"])
        pairs = own.select("uid", F.concat_ws("\n", "kind", "normal").alias("k"), "attempt").distinct()
        maps = pairs.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("k", "attempt"))).alias("later"))
        small = maps.limit(broadcast_rows + 1).count() <= broadcast_rows
        marked = held.join(F.broadcast(maps) if small else maps, "uid", "left")

    attempt = lambda u: F.coalesce(F.col("later")[F.concat_ws("\n", u["kind"], u["normal"])], F.lit(0))
    woven = F.concat(F.concat_ws("", F.zip_with(F.slice("gaps", F.lit(1), F.size("entities")), surrogates(F.col("entities"), attempt, key), lambda g, e: F.concat(g, e))), F.element_at("gaps", -1))
    text = F.when(F.size("entities") > 0, woven).otherwise(F.get("gaps", F.lit(0)))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda s: s["kind"]))), ",")
    n_col = _free("n_entities", df.columns)
    kinds_col = _free("entity_kinds", [*df.columns, n_col])
    columns = [text.alias(c) if c == text_col else F.col("other")[c].alias(c) for c in df.columns]
    return marked.select(*columns, F.size("entities").cast("long").alias(n_col), kinds.alias(kinds_col))
