"""Registered queries of the operators, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path, settle
from . import columns, ledger, lines, manifest, minhash, negatives, packing, passages, patterns, rans, rollup, rules, sketch, viterbi

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_token_files")
def op1(spark, folder):
    """Ids written as interleaved range coder blocks and read back."""
    return rans.token_files(table(spark, folder, "documents"))


@query("op2_rule_classifier")
def op2(spark, folder):
    """Quality score by a sparse rule ensemble."""
    scored, _ = rules.classify(table(spark, folder, "documents"), table(spark, folder, "labels"), keep=["doc_id"])
    return scored


@query("op3_minhash_bayes")
def op3(spark, folder):
    """Near-duplicate components by banded MinHash with sequential Bayesian verification."""
    found = minhash.near_duplicates(table(spark, folder, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op4_scaled_sketch")
def op4(spark, folder):
    """Fingerprints of texts and their edited texts."""
    return sketch.edit_test(table(spark, folder, "documents"))


@query("op5_repeated_strings")
def op5(spark, folder):
    """Bytes under repeated strings of 400 bytes removed."""
    cut = columns.drop_repeated_strings(table(spark, folder, "documents"))
    spans = F.coalesce("spans", F.array())
    removed = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size(spans).cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_piece_viterbi")
def op6(spark, folder):
    """Texts cut into pieces by the shared-prefix Viterbi search, and decoded."""
    return viterbi.piece_summary(table(spark, folder, "documents"))


@query("op7_token_rollups")
def op7(spark, folder):
    """Totals after inserts of all documents, deletes of exact copies and revised counts of one language.

    The revision counts the end id of English documents.  Two batches are
    committed twice, which changes nothing.
    """
    counts = settle(rollup.token_counts(table(spark, folder, "documents")), "counts")
    lowest = counts.groupBy("place").agg(F.min("doc_id").alias("lowest"))
    ranked = counts.join(lowest, "place")
    copies = ranked.where("doc_id > lowest")
    english = ranked.where("doc_id = lowest and lang = 'en'")
    path = scratch_path(spark, "rollup")
    rollup.commit(rollup.signed(counts, 1), path, "load")
    rollup.commit(rollup.signed(copies, -1), path, "copies")
    rollup.commit(rollup.revised(english, english.withColumn("n_tokens", F.col("n_tokens") + 1)), path, "end-id")
    rollup.commit(rollup.signed(copies, -1), path, "copies")
    rollup.commit(rollup.signed(counts, 1), path, "load")
    return rollup.totals(spark, path)


@query("op8_vector_packing")
def op8(spark, folder):
    """Documents packed under limits on tokens, segments and loss-bearing tokens."""
    return packing.pack_documents(table(spark, folder, "documents"), loss=packing.SEQUENCE_TOKENS)


def _cut_summary(cut: DataFrame, *more: str) -> DataFrame:
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", *more, F.size("removed").cast("long").alias("n_removed"), removed.alias("removed_bytes"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op9_passage_dedup")
def op9_passages(spark, folder):
    """Repeated lines of any length and repeated runs of more than 50 words removed, as in the pipeline; ``text`` is what is left."""
    return _cut_summary(lines.drop_repeated_units(table(spark, folder, "documents"), min_words=1, passage=passages.PASSAGE), "text")


_UNITS = """
with cut as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) as no
  from documents where text is not null),
norm as (
  select doc_id, line, no,
         list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words
  from cut),
ranked as (
  select doc_id, line, no, len(words) as n,
         case when len(words) >= 5 then row_number() over (partition by words order by doc_id, no) else 1 end as nth
  from norm),
docs as (
  select doc_id, count(*) filter (where n > 0) as n_units, count(*) filter (where nth > 1) as n_removed,
         coalesce(sum(strlen(line)) filter (where nth > 1), 0) as removed_bytes,
         coalesce(string_agg(line, chr(10) order by no) filter (where nth = 1), '')
           || case when arg_max(nth, no) > 1 and count(*) filter (where nth = 1) > 0 then chr(10) else '' end as kept
  from ranked group by doc_id)
select d.doc_id, cast(coalesce(u.n_removed, 0) as bigint) as n_removed,
       cast(coalesce(u.removed_bytes, 0) as bigint) as removed_bytes,
       sha256(coalesce(u.kept, '')) as kept_sha256
from documents d left join docs u using (doc_id)
"""


@query("op9_line_dedup", _UNITS)
def op9(spark, folder):
    """Repeated lines removed; the earliest one of equal lines stays."""
    return _cut_summary(lines.drop_repeated_units(table(spark, folder, "documents")))


_LEDGER = r"""
with base as (
  select doc_id, coalesce(text, '') as text from documents),
w as (
  select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from base),
pos as (
  select doc_id, i, words[i] as a, words[i + 1] as b, words[i + 2] as c
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w where len(words) >= 3)),
rep as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from pos) where n > 1),
covered as (
  select doc_id, count(distinct i + k) as n from rep, (select unnest([0, 1, 2]) as k) group by doc_id),
top as (
  select doc_id, max(n) as n from (
    select doc_id, word, count(*) as n from (select doc_id, unnest(words) as word from w) group by doc_id, word) group by doc_id),
m as (
  select w.doc_id, cast(len(words) as bigint) as n_words,
         cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
         cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
         cast(coalesce(covered.n, 0) as bigint) as n_repeat_words, len(ls) as n_lines, coalesce(top.n, 0) as top_word,
         length(regexp_replace(text, '[^!?]', '', 'g')) as n_shouts, length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_upper,
         length(regexp_replace(text, '[^a-z]', '', 'g')) as n_lower, length(regexp_replace(text, '[^0-9]', '', 'g')) as n_digits,
         length(regexp_replace(text, '[^\(\)\[\]\{\}/\\=_+@~^"''\-]', '', 'g')) as n_brackets
  from w left join covered using (doc_id) left join top using (doc_id)),
v as (
  select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 100 * n_symbols > 10 * n_words or 100 * n_dup_lines > 50 * n_lines or word_chars < 2 * n_words
            or word_chars > 15 * n_words or 100 * n_shouts > 20 * n_words or 100 * n_upper > 50 * (n_upper + n_lower)
            or 100 * n_digits > 50 * word_chars or 100 * top_word > 40 * n_words or 100 * n_brackets > 60 * n_words) as kept
from v
"""


@query("op10_rule_ledger", _LEDGER)
def op10(spark, folder):
    """Measurements, base verdict and verdict of the current policy."""
    done = ledger.apply_policy(ledger.rule_ledger(table(spark, folder, "documents")))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_CRC = """xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(cast(doc_id as varchar), ''),
  lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end), 4294967295)"""
_LEAF = " || ".join(f"case when {c} is null then '-' else strlen(cast({v} as varchar)) || ':' || cast({v} as varchar) end"
                    for c, v in (("doc_id", "doc_id"), ("source", "source"), ("lang", "lang"), ("n_chars", "(n_chars + {0})"), ("text", "text")))
_MANIFEST = f"""
with recursive leaf as (
  select doc_id, lang, sha256({_LEAF.format(0)}) as h,
         case when {_CRC} % 7 = 0 then sha256({_LEAF.format(1)}) end as tampered,
         row_number() over (partition by lang order by doc_id nulls first) - 1 as pos, count(*) over (partition by lang) as n
  from documents),
tree as (
  select 0 as lvl, lang, pos, h, n from leaf
  union all
  select lvl + 1, lang, pos // 2, sha256(h || coalesce(follows, '')), (n + 1) // 2
  from (select *, lead(h) over (partition by lang order by pos) as follows from tree) where n > 1 and pos % 2 = 0),
sub as (
  select lang, h, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from tree where n = 1),
top as (
  select 0 as lvl, pos, h, n from sub
  union all
  select lvl + 1, pos // 2, sha256(h || coalesce(follows, '')), (n + 1) // 2
  from (select *, lead(h) over (order by pos) as follows from top) where n > 1 and pos % 2 = 0),
upper as (
  select s.lang, list(t.pos % 2 || coalesce(b.h, '') order by t.lvl) as steps
  from sub s join top t on t.n > 1 and t.pos = s.pos >> t.lvl left join top b on b.lvl = t.lvl and b.pos = xor(t.pos, 1)
  group by s.lang),
lower as (
  select l.doc_id, list(t.pos % 2 || coalesce(b.h, '') order by t.lvl) as steps
  from leaf l join tree t on t.n > 1 and t.lang is not distinct from l.lang and t.pos = l.pos >> t.lvl
  left join tree b on b.lang is not distinct from l.lang and b.lvl = t.lvl and b.pos = xor(t.pos, 1) group by l.doc_id),
path as (
  select l.doc_id, l.h as leaf, l.tampered, s.h as subroot, (select h from top where n = 1) as root,
         list_concat(coalesce(a.steps, []), coalesce(u.steps, [])) as steps
  from leaf l join sub s on s.lang is not distinct from l.lang left join lower a using (doc_id)
  left join upper u on u.lang is not distinct from l.lang),
done as (
  select *, list_reduce(list_concat([coalesce(tampered, leaf)], steps),
                        lambda a, x: sha256(case when x[1] = '1' then x[2:] || a else a || x[2:] end)) as folded_root from path)
select doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(steps, lambda x: x[2:]), 'string_agg', ''), '')) as proof_sha256,
       folded_root, folded_root = root as verified from done
"""


@query("op11_merkle_manifest", _MANIFEST)
def op11(spark, folder):
    """Proofs of all documents, folded again from a copy in which some rows were tampered with."""
    return manifest.verified_manifest(table(spark, folder, "documents")).drop("lang", "steps")


_NEGATIVES = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) as x
  from embeddings
  where label is not null and vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_dot_product(a.x, b.x) as bigint) as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (
  select p.anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score,
         row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as rank
  from p join s on p.anchor_id = s.anchor_id and not s.same
    and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""


@query("op12_hard_negatives", _NEGATIVES)
def op12(spark, folder):
    """Negatives between 30 and 90 percent of each positive's score, for every hundredth vector."""
    rows = negatives.vectors_of(table(spark, folder, "embeddings"), "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


@query("op13_pattern_packing")
def op13(spark, folder):
    """Whole documents in sequences of 2,048 tokens by fitted length patterns."""
    return patterns.pack_patterns(table(spark, folder, "documents"))
