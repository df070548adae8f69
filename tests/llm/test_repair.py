import functools
import hashlib
import random
import re
import zlib

import pytest
from compare import spark_rows  # noqa: F401

from asofkit.llm import queries, repair

GRAMMAR = re.compile(r"(s?(ua)+)?")
WHITE = set(" \t\n\x0b\x0c\r")


def cheapest(rows):
    """rows: (initial, must go, truncated); least (cost, edits, repaired roles) over all texts of edits, by the grammar's prefixes."""

    @functools.cache
    def best(i, said, puts):
        """said: the last initial ('' at the start) is all that the grammar asks for."""
        found = []
        if i == len(rows):
            if said in ("", "a"):
                found.append((0, ""))
        else:
            initial, gone, cut = rows[i]
            more = lambda cost, letter, to: found.append((cost + best(i + 1, to, 0)[0], letter + best(i + 1, to, 0)[1]))
            more(2, "D", said)
            if not gone:
                fits = {"": "su", "s": "u", "u": "a", "a": "u"}[said]
                if initial and initial in fits:
                    more(5 * cut, "K", initial)
                for role in "ua":
                    if role in fits:
                        more(1 + 5 * cut, "R", role)
        if puts < 3:
            for role in "ua":
                if role in {"": "u", "s": "u", "u": "a", "a": "u"}[said]:
                    cost, rest = best(i, role, puts + 1)
                    found.append((cost + 5, "I" + rest))
        return min(found, default=(10**9, ""))

    return best(0, "", 0)


def expected(rows, ids):
    """rows: (conv, turn, role, text) after damage."""
    out = {}
    for conv in ids:
        mine = [(t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, marks = set(), []
        for _, role, text in mine:
            solid = [c for c in text if c not in WHITE]
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marks.append(fault)
        cost, audit = cheapest(tuple((r[1][:1], m in ("blank", "duplicate"), m == "truncated") for r, m in zip(mine, marks)))
        said, at, last = [], 0, ""
        for edit in audit:
            new = "u" if last != "u" else "a"
            name = {"u": "user", "a": "assistant"}[new]
            if edit == "I":
                said.append(name + ":")
            else:
                _, role, text = mine[at]
                at += 1
                if edit == "D":
                    continue
                if edit == "K":
                    name, new = role, role[0]
                said.append(f"{name}:{text}")
            last = new
        assert at == len(mine) and GRAMMAR.fullmatch("".join(x[0] for x in said))
        turns = [t for t, *_ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        steps = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out[conv] = (gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), steps, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(), len(mine), len(said))
    return out


def result(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def invented(rng, convs, most, sure=0.5):
    rows = []
    for conv in convs:
        for turn in range(rng.randint(0, most)):
            role = ("user", "assistant")[turn % 2] if rng.random() < sure else rng.choice(["system", "user", "assistant", "tool", "", None, "Über"])
            rows.append((conv, rng.choice([turn, turn, turn, turn - 1, None]), role, rng.choice(["Yes.", "No!", "why?  ", "cut", " \n", "", None, "a", f"{turn}.", f"{turn}", " ", "e.\x0b\x0c"])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_repairs_equal_search_over_all_edits(spark):
    rng = random.Random(11)
    convs = [None, *range(150)]
    rows = invented(rng, convs, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    want = expected(rows, convs)
    assert result(repair.audits(df.repartition(7), ids)) == want
    text = {}
    for r in repair.repaired(df).orderBy("conv_id", "place").collect():
        text.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in text.items()} == {c: w[7] for c, w in want.items() if w[9]}


def test_long_conversations_over_many_blocks(spark, monkeypatch):
    """One conversation of many blocks and ranges equals the same rows taken whole; copies fill blocks of their own."""
    rng = random.Random(12)
    rows = invented(rng, [1], 300, 0.8)
    while len(rows) < 250:
        rows = invented(rng, [1], 300, 0.8)
    rows += [(1, 40, "user", "Again.")] * 900 + [(2, i, ("user", "assistant")[i % 2], f"{i}.") for i in range(9000)]
    want = {}
    for conv in (1, 2):
        codes, v = b"", repair.END
        mine = sorted(((t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen = set()
        for _, role, text in mine:
            solid = text.strip(" \t\n\x0b\x0c\r")
            fault = 1 if not solid else 2 if (role, text) in seen else 0 if solid[-1] in ".!?" else 3
            seen.add((role, text))
            codes += bytes([4 * fault + (3 if not role or role[0] not in "sua" else "sua".index(role[0]))])
        edits, ends = repair.walks(codes, v)
        want[conv] = edits[0] + repair.TAIL[ends[0]]
    got = {r["conv_id"]: r for r in repair.audits(spark.createDataFrame(rows, SCHEMA).repartition(9)).collect()}
    assert {c: r["audit"] for c, r in got.items()} == want
    assert got[2]["audit"] == "K" * 9000 and got[1]["duplicate"] > 890
    assert got[1]["cost"] == sum({"D": 2, "I": 5, "K": 0, "R": 1}[e] for e in want[1]) + 5 * _cut(rows, want[1])


def _cut(rows, audit):
    mine = sorted(((t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == 1), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    kept = [r for r, e in zip(mine, (e for e in audit if e != "I"), strict=True) if e != "D"]
    return sum(r[2].strip(" \t\n\x0b\x0c\r")[-1] not in ".!?" for r in kept)


def test_walks_equal_search_with_short_strides(monkeypatch):
    monkeypatch.setattr(repair, "STRIDE", 3)
    rng = random.Random(13)
    for _ in range(300):
        rows = [(rng.choice(["s", "u", "a", ""]), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(0, 9))]
        codes = bytes(4 * (1 if gone else 3 if cut else 0) + (3 if not i else "sua".index(i)) for i, gone, cut in rows)
        cost, audit = cheapest(tuple(rows))
        edits, ends = repair.walks(codes, repair.END)
        assert edits[0] + repair.TAIL[ends[0]] == audit
        if codes:
            half = rng.randint(0, len(codes))
            both = [repair.product(c) for c in (codes[:half], codes[half:]) if c]
            least = both[0] if len(both) == 1 else (both[0][:, :, None] + both[1][None]).min(1)
            assert min(least[0] + repair.END) == cost


def test_op11_over_its_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    made = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if kind:
            role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            made += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    got = result(queries.queries()["op11_conversation_repair"](spark, sf))
    assert got == expected(made, {r[0] for r in rows})


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(repair.audits(df)) == expected(rows, {r[0] for r in rows})


def test_columns_of_clashing_names(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", 5, "z"), (1, 1, "assistant", "Yes.", 6, "y")], SCHEMA + ", kind int, digest string")
    assert repair.audits(df).first()["audit"] == "KK"
