"""The queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, language_model, mixture, near_join, pieces, pii, repair, suffix_dedup, syncmers, token_counts, toxicity

#: P(toxic) from which a document is rejected.
REJECT = 0.35
#: The key of the surrogates. Production keys come from the caller.
PII_KEY = "asofkit"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grade() -> Column:
    """Grade of a label: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    return F.when(F.col("toxic") == 1, 2 - F.coalesce(F.col("quality"), F.lit(1))).when(F.col("toxic") == 0, 0)


GRADES = 3


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.OrdinalModel:
    return toxicity.fitted(docs, labels, grade(), GRADES)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_and_decoded(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.severities(docs, model).withColumn("rejected", F.col("p_toxic") >= REJECT)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(more)
    made = chat.format_turns(chat.turns_of_rows(rows)).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_mask")))
    spoken = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymised(docs, PII_KEY).select("doc_id", "n_entities", "entity_kinds", "text")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.audits(repair.damaged(rows), rows)


def op12_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.taken(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_token_counts,
        op2_sentencepiece,
        op3_decontamination,
        op4_fingerprints,
        op5_ngram_join,
        op6_toxicity,
        op7_chat,
        op8_suffix_dedup,
        op9_pii,
        op10_language_model,
        op11_conversation_repair,
        op12_source_mixture,
        op13_source_divergence,
        pipeline,
    )
    return {f.__name__: f for f in ops}


def _chat_sql() -> str:
    def safe(c: str) -> str:
        out = f"replace({c}, '\\', '\\\\')"
        for control in chat.CONTROL:
            out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
        return out

    fixed = len(chat.TURN) + len(chat.TEXT) + len(chat.END)
    return f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum({fixed} + length({safe("role")}) + length({safe("text")}))::bigint as formatted_chars,
  'messages' as layout
from rows group by conv_id"""


NEAR_SQL = """
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '') as w from documents),
places as (select doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) as i from words),
shingles as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from places),
sets as (select doc_id, count(*) as n, sha256(string_agg(s, chr(10) order by s)) as cls from shingles group by doc_id),
docs as (select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(cls, '') as cls from documents d left join sets using (doc_id)),
classes as (select cls, min(doc_id) as class_id, count(*) as class_size, min(n_shingles) as n from docs group by cls),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
  where a.doc_id in (select class_id from classes) and b.doc_id in (select class_id from classes) group by a.doc_id, b.doc_id),
links as (
  select x, y, q.class_size as docs from pairs join classes p on p.class_id = x join classes q on q.class_id = y
  where c >= 0.8 * (p.n + q.n - c) - 1e-9),
reach(x, y) as (select class_id, class_id from classes where n > 0 union select r.x, l.y from reach r join links l on l.x = r.y),
groups as (select x, min(y) as group_id from reach group by x),
counts as (select x, sum(docs) as docs, count(*) as n from links group by x)
select d.doc_id, d.n_shingles, c.class_id, c.class_size,
  case when d.n_shingles > 0 then c.class_size - 1 + coalesce(k.docs, 0) else 0 end::bigint as n_links,
  coalesce(k.n, 0)::bigint as n_class_links,
  case when d.n_shingles > 0 then g.group_id else d.doc_id end as group_id
from docs d join classes c using (cls) left join counts k on k.x = c.class_id left join groups g on g.x = c.class_id"""


DIVERGENCE_SQL = r"""
with docs as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents),
said as (select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
counts as (select lang, source, term, count(*) as n, count(distinct r) as d from said group by lang, source, term),
kept as (select lang, term, sum(n)::hugeint as n from counts group by lang, term having sum(d) >= 3),
sizes as (select lang, count(*)::hugeint as v, sum(n)::hugeint as n from kept group by lang),
held as (select c.lang, c.source, c.term, c.n::hugeint as n from counts c semi join kept k on c.lang = k.lang and c.term = k.term),
groups as (select distinct lang, source from docs),
totals as (select g.lang, g.source, coalesce(sum(h.n), 0)::hugeint as n from groups g left join held h using (lang, source) group by g.lang, g.source),
p as (
  select t.lang, t.source, k.term, coalesce(h.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(h.n, 0) + 1)) // (t.n + s.v) as p
  from totals t join sizes s using (lang) join kept k using (lang) left join held h on h.lang = t.lang and h.source = t.source and h.term = k.term),
q as (select k.lang, k.term, 1 + (1000000000::hugeint * (k.n + 1)) // (s.n + s.v) as q from kept k join sizes s using (lang)),
sums as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (
  select p.lang, p.source, 'term' as part, p.term as item, ((p.p - q.q) * (p.p - q.q) // q.q)::bigint as value
  from p join q using (lang, term) where p.n > 0 and p.p > q.q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 200"""


def oracle_sql() -> dict[str, str]:
    return {"op7_chat": _chat_sql(), "op5_ngram_join": NEAR_SQL, "op13_source_divergence": DIVERGENCE_SQL}
