"""Operator 10: language-model scores of whole documents by a gated recurrent network.

Training documents are those whose crc32(id as text) mod 5 is not 1 (a null id counts as the empty text); the
others are held out. Tokens are the words of the lower-cased (A-Z) text between ASCII white space, then one end.

Counts cover all training documents: words are counted by task, then summed by a shuffle. The counts of the `known` most
frequent words (a bound) go to all tasks; those of the other words reach the documents by a join.

The network (see `gru`) knows the `head` most frequent words, each with an embedding as input and its own weights as output.
P(word) = P(class | state) P(word | class, state), both softmaxes of the state that the words before have left. Rarer words are one class,
the tail, within which the state plays no part: there it is the share of (c + 0.5), with 0.5 for all words never seen. So a
text's score is the log of a proper probability under the same convention as the base score.

Training takes each training document once. Documents are dealt to shards by a hash of their id and length; the
number of shards follows the tokens of the corpus (`shard_tokens` each), not the partitions, and their order within a shard is that of
a hash, so that scores don't depend on how the input is partitioned. A tenth of the shards is trained from the same start, by
truncated backpropagation, each with its own optimizer state; the mean of their weights, by tokens (a word's own: by how often a shard
had it), is where the other shards start, whose mean is the model. Means are summed within each task, then by a shuffle of
blocks of rows. In scoring, the state is carried from window to window through a whole document.

Null and empty texts are one end token. Without training documents all counts are 0 and the network stays as it starts.
Repeated rows are scored, and counted, as often as they occur. Other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from ._common import id_text, once, written

END = b""
KNOWN, HEAD = 300_000, 6_144
SHARD_TOKENS = 2_000_000
CHUNK = 524_288  # tokens that are trained on or scored together
BLOCK = 1024  # rows of the tables
#: Rates of the dense weights and of the words in the two rounds.
RATES = ((0.01, 1.0), (0.003, 1.0))
SLICE = 1 << 20  # bytes of a text that are split at once
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def remainder(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def words_of(text: str) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    data = text.encode("utf-8", "surrogatepass").lower()  # bytes: lower() and split() know ASCII only
    while len(data) > SLICE:
        *some, last = data[:SLICE].split() or [b""]
        if data[SLICE - 1 : SLICE].isspace():
            some, last = [*some, last] if last else some, b""
        if not some and last:  # one word longer than a slice
            break
        yield some
        data = last + data[SLICE:]
    yield data.split()


def word_counts(texts: DataFrame, flush: int = 400_000) -> DataFrame:
    """word binary, c: all tokens of all texts, ends as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for text in batch["text"]:
                for words in words_of(text.as_py()):
                    counts.update(words)
                counts[END] += 1
                if len(counts) > flush:
                    yield out()
                    counts.clear()
        yield out()

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class _Index(dict):
    """Numbers of words; 0 for all others."""

    def __missing__(self, word: bytes) -> int:
        return 0


class Words:
    """The most frequent words and what the counts say; bounded, and the same in all tasks."""

    def __init__(self, known: list[tuple[bytes, int]], head: int, ends: int, total: int, distinct: int):
        """known: words and counts without the end, most frequent first."""
        self.total, self.distinct, self.ends = total, distinct, ends
        self.index = _Index({w: i + 1 for i, (w, _) in enumerate(known)})
        self.counts = np.array([0, *(n for _, n in known)], np.float64)
        self.head = min(head, len(known))
        self.end = self.head + 1  # as a word of the network
        held = self.counts[1 : self.end].sum()
        tail_seen = distinct - self.head - (1 if ends else 0)
        self.tail_mass = (total - held - ends) + 0.5 * (tail_seen + 1)
        self.network_counts = np.concatenate([[total - held - ends], self.counts[1 : self.end], [ends]])
        self.log_c = np.log10(self.counts + 0.5)
        self.log_c[0] = 0.0  # these counts come by a join

    def encoded(self, text: str) -> tuple[np.ndarray, float, float, int, list[bytes]]:
        """Network words of a text, sums of log10(c + 0.5) over its known words and over those of the tail, tokens of the tail, words for the join."""
        number, parts, base, tail, n_tail, rare = self.index.__getitem__, [], 0.0, 0.0, 0, []
        for words in words_of(text):
            ids = np.fromiter(map(number, words), np.int64, len(words))
            log_c = self.log_c[ids]
            rare += [words[i] for i in np.flatnonzero(ids == 0).tolist()]
            base += float(log_c.sum())
            outside = np.flatnonzero((ids == 0) | (ids > self.head))
            tail += float(log_c[outside].sum())
            n_tail += len(outside)
            ids[outside] = 0
            parts.append(ids)
        return np.concatenate([*parts, [self.end]]), base + float(np.log10(self.ends + 0.5)), tail, n_tail, rare


def encoded(texts: DataFrame, sent, shards: int) -> DataFrame:
    """uid, doc_id, shard (-1: held out), place, ids (network words), n_tokens, known, base, tail, n_tail, rare (words for the join): a row for each text."""
    kind = np.dtype("<u2" if sent.value.end < 1 << 16 else "<u4")
    names = ["uid", "doc_id", "shard", "place", "ids", "n_tokens", "known", "base", "tail", "n_tail", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Words = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch, rows = whole.slice(at, 500), []
                for text in batch["text"]:
                    ids, base, tail, n_tail, rare = words.encoded(text.as_py())
                    rows.append((ids.astype(kind).tobytes(), len(ids), len(ids) - 1 - len(rare) + (words.ends > 0), base, tail, n_tail, rare))
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.binary()))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("uid", "doc_id", "shard", "place")), *columns], names=names)

    h = F.xxhash64("doc_id", F.octet_length("text"))
    shard = F.when(remainder() != 1, F.pmod(h, F.lit(shards))).otherwise(-1)
    rows = texts.select(F.monotonically_increasing_id().alias("uid"), "doc_id", shard.cast("long").alias("shard"), F.xxhash64(h).alias("place"), "text")
    return rows.mapInArrow(run, "uid long, doc_id long, shard long, place long, ids binary, n_tokens long, known long, base double, tail double, n_tail long, rare array<binary>")


def _copy(start: gru.Model) -> gru.Model:
    return gru.Model(start.v, {k: x.copy() for k, x in start.dense.items()}, start.e.copy(), start.w.copy())


class _Sums:
    """Weighted sums of the models of a task's shards."""

    def __init__(self, m: gru.Model):
        self.dense = {k: np.zeros(x.shape) for k, x in m.dense.items()}
        self.e, self.w = np.zeros((len(m.e), m.e.shape[1] + 1)), np.zeros((len(m.w), m.w.shape[1] + 1))
        self.tokens = 0

    def add(self, m: gru.Model) -> None:
        self.tokens += m.tokens
        for k, x in m.dense.items():
            self.dense[k] += x * float(m.tokens)
        for sums, table, seen in ((self.e, m.e, m.seen_e), (self.w, m.w, m.seen_w)):
            sums[:, :-1] += table * seen[:, None]
            sums[:, -1] += seen

    def rows(self) -> Iterator[tuple[str, int, bytes]]:
        yield "dense", 0, np.concatenate([*(self.dense[k].ravel() for k in sorted(self.dense)), [self.tokens]]).tobytes()
        for name, sums in (("e", self.e), ("w", self.w)):
            for lo in range(0, len(sums), BLOCK):
                yield name, lo, sums[lo : lo + BLOCK].astype(np.float32).tobytes()


def _trained(docs: DataFrame, start: gru.Model, rates: tuple[float, float], kind: str, shard_tokens: int) -> gru.Model:
    """The mean of the models of all shards of docs (shard, place, ids), each trained from start."""
    sent = docs.sparkSession.sparkContext.broadcast((start.v, start.dense, start.e, start.w))
    schema, names, types = "name string, block long, s binary", ["name", "block", "s"], (pa.string(), pa.int64(), pa.binary())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 3, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = gru.Model(*sent.value)
        sums, model, mine, chunk, size = _Sums(begin), None, None, [], 0

        def learn() -> None:
            nonlocal chunk, size
            done = min(1.0, model.tokens / shard_tokens)
            gru.train(model, chunk, rates[0] * (1 - 0.8 * done), rates[1])
            chunk, size = [], 0

        for batch in batches:
            for shard, ids in zip(batch["shard"].to_pylist(), batch["ids"], strict=True):
                if shard != mine:
                    if model:
                        learn()
                        sums.add(model)
                    model, mine = _copy(begin), shard
                chunk.append(np.frombuffer(ids.as_buffer(), kind).astype(np.int32))
                size += len(chunk[-1])
                if size >= CHUNK:
                    learn()
        if model:
            learn()
            sums.add(model)
            for row in sums.rows():
                yield batch_of([row])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}  # of the few blocks of a partition
        for batch in batches:
            for name, block, s in zip(batch["name"].to_pylist(), batch["block"].to_pylist(), batch["s"], strict=True):
                s = np.frombuffer(s.as_buffer(), np.float64 if name == "dense" else np.float32).astype(np.float64)
                held[name, block] = held[name, block] + s if (name, block) in held else s
        for (name, block), s in held.items():
            yield batch_of([(name, block, s.tobytes())])

    dealt = docs.select("shard", "place", "ids").repartition("shard").sortWithinPartitions("shard", "place")
    made = dealt.mapInArrow(run, schema).repartition("name", "block").mapInArrow(summed, schema).collect()  # bounded by the head
    model = _copy(start)
    for row in made:
        s = np.frombuffer(row["s"], np.float64)
        if row["name"] == "dense":
            at = 0
            for k in sorted(model.dense):
                n = model.dense[k].size
                model.dense[k] = (s[at : at + n] / s[-1]).reshape(model.dense[k].shape).astype(np.float32)
                at += n
            continue
        table = model.e if row["name"] == "e" else model.w
        s = s.reshape(-1, table.shape[1] + 1)
        some = np.flatnonzero(s[:, -1] > 0)
        table[row["block"] + some] = s[some, :-1] / s[some, -1:]
    return model


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: int = KNOWN, head: int = HEAD, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row."""
    sc = df.sparkSession.sparkContext
    texts = id_text(df, id_col, text_col)
    counts = written(word_counts(texts.where(remainder() != 1)))
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))), F.lit(0)).alias("ends")).first()
    top = counts.where(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit(known).toArrow()  # bounded
    sent = sc.broadcast(Words(list(zip(top["word"].to_pylist(), top["c"].to_pylist(), strict=True)), head, totals["ends"], totals["n"], totals["v"]))
    words = sent.value
    shards = max(1, -(-words.total // shard_tokens))
    docs = written(encoded(texts, sent, shards))
    kind = "<u2" if words.end < 1 << 16 else "<u4"
    model = gru.initial(gru.vocabulary(words.head), words.network_counts)
    first = -(-shards // 10)
    for rates, part in zip(RATES, (F.col("shard").between(0, first - 1), F.col("shard") >= first), strict=True):
        model = _trained(docs.where(part), model, rates, kind, shard_tokens)
    final, name = sc.broadcast((model.v, model.dense, model.e, model.w)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once(("network", name), lambda: gru.Model(*final.value))
        for batch in batches:
            out, chunk, size = [], [], 0
            for ids in batch["ids"]:
                chunk.append(np.frombuffer(ids.as_buffer(), kind).astype(np.int32))
                size += len(chunk[-1])
                if size >= 2 * CHUNK:
                    out.append(gru.score(model, chunk))
                    chunk, size = [], 0
            out.append(gru.score(model, chunk))
            columns = [c for c in batch.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(np.concatenate(out) / np.log(10))], names=[*columns, "network"])

    scored = docs.drop("shard", "place", "rare").mapInArrow(run, "uid long, doc_id long, n_tokens long, known long, base double, tail double, n_tail long, network double")
    rare = docs.select("uid", F.explode("rare").alias("word")).join(counts, "word", "left")
    rare = rare.groupBy("uid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("log_c"), F.count("c").alias("seen"))
    joined = scored.join(rare, "uid", "left").fillna(0, ["seen"]).fillna(0.0, ["log_c"])
    log_all = F.lit(float(np.log10(words.total + 0.5 * (words.distinct + 1))))
    log_tail = F.lit(float(np.log10(words.tail_mass)))
    return joined.select(
        "doc_id",
        (remainder() == 1).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.col("seen")).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("log_c") - F.col("n_tokens") * log_all).alias("base_score"),
        (F.col("network") + F.col("tail") + F.col("log_c") - F.col("n_tail") * log_tail).alias("score"),
    )
