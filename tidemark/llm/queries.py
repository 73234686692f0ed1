"""Registered queries of the corpus operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, stored
from . import bpe, filter_audit, grammar, language, lengths, lines, mixing, pseudo_lm, quality, simhash, toxicity, treap, vptree
from .rows import fold, position

RANKS, WORD_BPE, BYTE_BPE = "byte_bpe_50k.tiktoken", "word_bpe_49k.json", "byte_bpe_50k.json"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def op1_token_counts(spark: SparkSession, root: str) -> DataFrame:
    """Exact totals, suffix sums and quantiles for every encoded length that occurs."""
    hist = lengths.length_histogram(table(spark, root, "documents"), public_tokenizers.path(RANKS))
    return lengths.context_table(stored(hist, "lengths"))


def op2_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, root, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, root: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, root, "documents"))


def op4_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    judged = quality.judge(table(spark, root, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "quality")


def op5_token_files(spark: SparkSession, root: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    grammar.write_token_files(table(spark, root, "documents"), path, public_tokenizers.path(WORD_BPE))
    return grammar.read_token_files(spark, path, ids=False)


def op6_pseudo_likelihood(spark: SparkSession, root: str) -> DataFrame:
    return pseudo_lm.pseudo_likelihood(table(spark, root, "documents"))


def op7_toxicity(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    scored = toxicity.score(docs, table(spark, root, "labels"))
    doc_id = F.col(f"c{position(docs, 'doc_id')}")
    return scored.select(doc_id.alias("doc_id"), (fold(doc_id) == 0).alias("held_out"),
                         F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
                         F.size("passages").alias("n_passages"))


def op8_mixing(spark: SparkSession, root: str) -> DataFrame:
    return mixing.allocation(table(spark, root, "documents"))


def op9_nearest(spark: SparkSession, root: str) -> DataFrame:
    return vptree.nearest(table(spark, root, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_bpe(spark: SparkSession, root: str) -> DataFrame:
    return bpe.round_trip(table(spark, root, "documents"), public_tokenizers.path(BYTE_BPE))


def op11_filter_audit(spark: SparkSession, root: str) -> DataFrame:
    filters = filter_audit.standard_filters()
    cells = filter_audit.mask_cells(filter_audit.failures(table(spark, root, "documents"), filters), table(spark, root, "labels"))
    return filter_audit.audit(cells, "".join(f.letter for f in filters))


def op12_lexical_search(spark: SparkSession, root: str) -> DataFrame:
    return treap.search(treap.build(table(spark, root, "documents")), table(spark, root, "benchmark"))


def op13_language_id(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    read = language.predict(docs, language.fit(docs))
    doc_id = F.col(f"c{position(docs, 'doc_id')}")
    return read.select(doc_id.alias("doc_id"), language.held_out(doc_id).alias("held_out"), "lang_pred",
                       F.col("lang_score").alias("score"))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_line_dedup, op3_simhash, op4_quality_rules, op5_token_files, op6_pseudo_likelihood,
    op7_toxicity, op8_mixing, op9_nearest, op10_bpe, op11_filter_audit,
    op12_lexical_search, op13_language_id)}

_SPACES = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

_LINE_DEDUP = f"""
with cut as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lines as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from cut),
keyed as (select *, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
          from lines),
often as (select k, max(doc_id) as holder from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
marked as (select keyed.*, holder is not null and holder <> doc_id as gone from keyed left join often using (k))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""

_WORDS = "[^\\x20\\x09-\\x0D]+"

_MIXING = f"""
with cut as (select doc_id, source, regexp_extract_all(coalesce(text, ''), '{_WORDS}') as ws,
                    md5('{mixing.SEED}:' || coalesce(doc_id::varchar, md5(coalesce(text, '')))
                        || case when nth > 1 then ':' || nth else '' end) as h
             from (select *, row_number() over (partition by doc_id, text, lang, source, n_chars) as nth from documents)),
units as (select doc_id, source, len(ws)::bigint as size,
                 -ln((list_sum(list_transform(range(1, 14), lambda i: (instr('0123456789abcdef', substr(h, i, 1)) - 1)
                      * pow(16::double, 13 - i))) + 0.5) / pow(16::double, 13))
                 / (0.5 + 0.5 * (len(list_distinct(ws))::double / greatest(len(ws), 1))) as key from cut),
sizes as (select source, sum(size)::bigint as s,
                 [3.0, 1.0, 2.0][1 + (row_number() over (order by source nulls last) - 1) % 3]::double as w
          from units group by source),
leveled as (select *, row_number() over o as r,
                   (1.5 * sum(s) over () - coalesce(sum(2.0 * s) over (o rows between unbounded preceding and 1 preceding), 0.0))
                   / sum(w) over (o rows between current row and unbounded following) as level
            from sizes window o as (order by 2.0 * s / w, source nulls last)),
targets as (select source, s, least(2.0 * s, coalesce(w * (select arg_min(level, r) from leveled where level <= 2.0 * s / w),
                                                      2.0 * s))::double as target from leveled),
plan as (select *, case when s > 0 then floor(target / s) else 0 end as epochs from targets),
placed as (select doc_id, size, s, target, epochs,
                  sum(size) over (partition by units.source order by key, doc_id rows between unbounded preceding and current row)
                  - size as start
           from units join plan on units.source is not distinct from plan.source)
select doc_id, size, s as source_size, target,
       (size * (epochs + case when start + size / 2.0 <= target - epochs * s then 1 else 0 end))::bigint as taken
from placed
"""

_AUDIT = """
with recursive filters(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
measured as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws, min(doc_id) over (partition by t) as first from texts),
marks as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
judged as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
                  (len(ws) < 200)::int + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::int
                  + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::int
                  + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(first < doc_id, false)::int as mask
           from measured left join marks using (doc_id)),
cells as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from judged group by all),
orders(o, used) as (select letter, bit from filters
                    union all select o || letter, used + bit from orders join filters on used & bit = 0),
steps as (select o as filter_order, s::int as step, substr(o, s::int, 1) as letter,
                 (select sum(bit) from filters where instr(substr(o, 1, s::int - 1), letter) > 0) as before
          from orders, range(1, 6) as r(s) where length(o) = 5),
numbers as (
  select part, filter_order, step, letter,
         sum(n * (mask & (coalesce(before, 0) | bit) = 0)::int)::bigint as kept,
         sum(n * (mask & coalesce(before, 0) = 0 and mask & bit <> 0)::int)::bigint as removed,
         sum(n * (mask & coalesce(before, 0) <> 0 and mask & bit <> 0)::int)::bigint as redundant,
         sum(n * (mask = bit)::int)::bigint as unique_fails,
         sum(good * (mask & coalesce(before, 0) = 0 and mask & bit <> 0)::int)::bigint as good_lost,
         sum(toxic * (mask & coalesce(before, 0) = 0 and mask & bit <> 0)::int)::bigint as toxic_lost
  from cells, steps join filters using (letter) group by part, filter_order, step, letter)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, letter))::bigint as shapley
from numbers
"""

_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

_SEARCH = f"""
with docs as (select doc_id, row_number() over () as d, {_TERMS} as ts from documents),
lengths as (select doc_id, d, len(ts)::bigint as n from docs where len(ts) > 0),
whole as (select count(*)::bigint as docs, sum(n)::bigint as terms from lengths),
postings as (select d, t, count(*)::bigint as tf from (select d, unnest(ts) as t from docs) group by d, t),
items as (select item_id, t, count(*)::bigint as times
          from (select item_id, unnest({_TERMS}) as t from (select distinct item_id, text from benchmark)) group by item_id, t),
weights as (select t, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
            from postings, whole where t in (select t from items) group by t),
scored as (select item_id, d, doc_id,
                  sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::bigint as score
           from items join weights using (t) join postings using (t) join lengths using (d), whole group by item_id, d, doc_id),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank
           from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 20
"""

ORACLES = {"op12_lexical_search": _SEARCH, "op11_filter_audit": _AUDIT, "op2_line_dedup": _LINE_DEDUP, "op8_mixing": _MIXING}
