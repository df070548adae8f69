import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from compare import spark_rows
from pyspark.sql import functions as F

from asofkit.llm import divergence, mixture, queries

# 12


def water_fill(sizes, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    """sizes in order; by rounds of resharing, exactly."""
    w = [Fraction(weights[i % 3]) for i in range(len(sizes))]
    left, open_, target = share * sum(sizes), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        level = left / sum(w[i] for i in open_)
        above = {i for i in open_ if level * w[i] >= most * sizes[i]}
        if not above:
            for i in open_:
                target[i] = level * w[i]
            break
        for i in above:
            target[i] = Fraction(most * sizes[i])
            left -= target[i]
        open_ -= above
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check_mix(rows, made, block=64):
    sizes = defaultdict(int)
    for _, source, text in rows:
        sizes[source] += words(text)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(order, water_fill([sizes[s] for s in order])))
    left = Counter((i, words(t), sizes[s], round(float(target[s]), 3)) for i, s, t in rows)
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 3)) for r in made) == left
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in made)
    of_size = defaultdict(list)
    for s in order:
        of_size[sizes[s], round(float(target[s]), 3)].append(s)
    for (size, goal), same in of_size.items():
        got = sum(r["taken"] for r in made if r["source_size"] == size and round(r["target"], 3) == goal)
        assert abs(got - goal * len(same)) <= len(same) * (block / 2 + 0.5)


def invented(rng, n):
    sources = ["hot"] * 12 + ["a", "b", None, "", "é", "Z", "tiny"]
    rows = []
    for i in range(n):
        source = rng.choice(sources)
        size = rng.choice([0, 1, 5, 80, 200]) if source != "tiny" else 1
        rows.append((rng.choice([i, i, i, None, 3]), source, rng.choice([None, ""]) if not size else "\x0b".join(["wörd x"] * size)))
    return rows + [(900, "a", "long " * 20_000), (900, "a", "long " * 20_000)]


def test_targets_and_words_taken(spark):
    rng = random.Random(4)
    for n in (0, 1, 400):
        rows = invented(rng, n) if n != 1 else [(1, None, "x y z")]
        df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash")).withColumn("at", F.lit(1))
        check_mix(rows, mixture.taken(df.repartition(6)).collect())
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixture.taken(none).count() == 0
    empty = spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")
    assert [tuple(r) for r in mixture.taken(empty).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_slots_are_spread_and_ranked(spark):
    counts = [37, 5, 0, 1, 64]
    rows, first = [], 0
    for at, slots in enumerate(counts):
        rows.append((at, max(1, slots // 2), slots, first))
        first += slots
    made = mixture.schedule(spark.createDataFrame(rows, "at long, blocks long, slots long, first_slot long")).orderBy("slot").collect()
    bits, n = first.bit_length(), 0
    ranks = Counter()
    want = []
    for i in range(1 << bits):
        point = int(f"{i:0{bits}b}"[::-1], 2)
        at = next((at for at, _, slots, low in rows if low <= point < low + slots), None)
        if at is not None:
            want.append((i, at, ranks[at], ranks[at] % rows[at][1], ranks[at] // rows[at][1]))
            ranks[at] += 1
            n += 1
    assert [tuple(r) for r in made] == want and [ranks[i] for i in range(5)] == counts


def test_mix_in_its_order_holds_what_is_taken(spark):
    rows = [(i, s, t) for i, (_, s, t) in enumerate(invented(random.Random(5), 150))]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mix = mixture.mixed(df).groupBy("doc_id").agg(F.sum("n_words").alias("taken"))
    want = {r["doc_id"]: r["taken"] for r in mixture.taken(df.repartition(3)).collect() if r["taken"]}
    assert {r["doc_id"]: r["taken"] for r in mix.collect()} == want
    full = mixture.mixed(df).groupBy("slot").agg(F.sum("n_words").alias("n"), F.max("at").alias("at")).collect()
    assert max(r["n"] for r in full) == 64


def test_op12_over_its_table(spark, sf):
    made = queries.queries()["op12_source_mixture"](spark, sf)
    rows = made.collect()
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    check_mix([tuple(r) for r in table.collect()], rows)
    assert spark_rows(queries.queries()["op12_source_mixture"](spark, sf))[1] == sorted((tuple(float(r[c]) for c in sorted(made.columns)) for r in rows), key=repr)
    assert not re.search("Python|Arrow|Pandas", made._jdf.queryExecution().executedPlan().toString())


# 13


def audit(rows, min_docs=3, top=200):
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang, source].update(found)
        seen[lang].update(set(found))
    out = []
    for lang in seen:
        kept = [t for t, d in seen[lang].items() if d >= min_docs]
        group = {s: {t: c[t] for t in kept} for (x, s), c in counts.items() if x == lang}

        def share(c, kept=kept):
            size = sum(c.values()) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // size for t in kept}

        p = {s: share(c) for s, c in group.items()}
        q = share({t: sum(c[t] for c in group.values()) for t in kept})
        for s in group:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in group if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if group[s][t] and p[s][t] > q[t]]
            for part, values in (("pair", pairs), ("term", terms)):
                ranked = sorted(values, key=lambda v: (-v[0], v[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1) if part == "pair" or rank <= top]
    return sorted(out)


TERMS = ["a", "B", "Abc", "é", "éÉ", "straße", "abcdefgh", "ABCDEFGHI", "abcdefghijklmnop", "abcdefghijklmnopq", "q" * 40, "漢字漢字漢字", "😀", "x y", "z" * 17, "KK"]


def test_audit_equals_counting(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 300)
    rng = random.Random(9)
    rows = []
    for _ in range(300):
        lang = rng.choice(["en", "en", "en", "de", None, "", "one"])
        text = "".join(rng.choice(TERMS) + rng.choice([" ", "-", "7", "\n", "\x00", "[", "`", "{", "\x7f"]) for _ in range(rng.randint(0, 30)))
        rows.append((lang, rng.choice(["s", "t", "t", "", None, "u", "é"]) if lang != "one" else "only", rng.choice([text, text, text[:-1], None, ""])))
    rows += [("rare", "s", "once"), ("rare", "t", None), ("alone", "s", "")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("n", F.lit("clash")).withColumn("kind", F.lit(9))
    got = sorted(tuple(r) for r in divergence.divergences(df.repartition(5), buckets=3).collect())
    assert got == audit(rows)
    few = sorted(tuple(r) for r in divergence.divergences(df, top=3).collect())
    assert few == audit(rows, top=3)
    assert divergence.divergences(df.limit(0)).count() == 0


def test_texts_do_not_run_into_each_other():
    data = np.frombuffer("abcdé".encode() + b"x" * 20 + b"ab", np.uint8)
    found = divergence.counted(data, np.array([0, 2, 6, 26, 28]), np.array([0, 0, 1, 0]))
    made = {(int(g), bytes(t)): (int(n), int(d)) for groups, terms, ns, ds in found for g, t, n, d in zip(groups, terms, ns, ds)}
    assert made == {(0, b"ab"): (2, 2), (0, "cdé".encode()): (1, 1), (1, b"x" * 20): (1, 1)}


def test_radix_order_and_shares_are_exact():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 63, 5000).astype(np.uint64) >> np.uint64(rng.integers(0, 60)), rng.integers(0, 5, 5000).astype(np.uint32)
    assert (divergence.radix_order(b, a) == np.lexsort((np.arange(5000), a, b))).all()
    size = rng.integers(1, 9 * 10**15, 2000)
    count = np.maximum(1, (size * rng.random(2000)).astype(np.int64))
    assert divergence.shares(count, size).tolist() == [1 + 10**9 * c // s for c, s in zip(count.tolist(), size.tolist())]


@pytest.mark.parametrize("name", ["op13_source_divergence"])
def test_op13_over_its_table(spark, sf, name):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "source", "text").collect()]
    assert sorted(tuple(r) for r in queries.queries()[name](spark, sf).select("lang", "source", "part", "item", "value", "rank").collect()) == audit(rows)
