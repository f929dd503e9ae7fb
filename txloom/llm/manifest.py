"""Merkle manifest of a dataset: one root over all rows, and a proof per row.

Rows are leaves; the leaves of a group (a language, say) ascend by their id.
While a level has several nodes, every two consecutive ones become the hash of
their digests and a last lone one the hash of its own.  The subroots of the
groups, in the order of the groups, give the root in the same way.

The rank of a leaf is cut into digits of base ``FANOUT``.  Three digits make a
block of at most 4,096 leaves.  Inside a block the lowest digit is grouped away
first: at most 16 children become a struct with the four levels of hashes above
them, then at most 16 of these structs are nested in one of the next digit, and
so on.  Blocks are the leaves of the next round, so a round has 4,096 times
fewer rows than the one below.  The proofs of a round come back as one row per
block; that row meets the nested block in an aggregate, and a transform and an
explode over the block emit the proofs of its leaves.  No join, no gathered
group: a task holds a block of bounded size, however large a group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import row_index
from ..session import settle

FANOUT = 16
LEVELS = 4  # levels of two in a digit: 2 ** LEVELS = FANOUT
DIGITS = 3
BLOCK = FANOUT ** DIGITS
STEPS = "array<struct<side:int,h:string>>"


def field_text(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated texts."""
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(values: list[Column]) -> Column:
    return digest(*[field_text(v) for v in values])


# The nested expressions below are SQL text: one call each, where columns would be thousands of calls to the JVM.


def _level_up(level: str) -> str:
    """Every two consecutive digests hashed."""
    return (f"transform(sequence(0, cast((size({level}) - 1) div 2 as int)), "
            f"i -> sha2(concat(get({level}, 2 * i), coalesce(get({level}, 2 * i + 1), '')), 256))")


def _nested(rows: DataFrame, keys: list[str], digit: str, above: list[str], kept: list[str]) -> DataFrame:
    """One node per ``keys``: children in the order of ``digit``, and the levels of hashes above them.

    A group of the digit that has fewer than ``FANOUT`` children and only zeros
    ``above`` it is alone in its tree: there the levels end with one node.
    """
    out = rows.groupBy(*keys).agg(F.expr(f"sort_array(collect_list(struct({', '.join([digit, 'h', *kept])})))").alias("kids"))
    zeros = " and ".join(f"{c} = 0" for c in above)
    out = out.selectExpr("*", f"{zeros} and size(kids) < {FANOUT} as alone", "transform(kids, k -> k.h) as l0")
    for j in range(LEVELS):
        out = out.selectExpr("*", f"if(alone and size(l{j}) = 1, l{j}, {_level_up(f'l{j}')}) as l{j + 1}")
    levels = ", ".join(f"l{j}" for j in range(LEVELS))
    return out.selectExpr(*[f"`{k}`" for k in keys], f"get(l{LEVELS}, 0) as h", "alone", f"array({levels}) as levels", "kids")


def _blocks(nodes: DataFrame, by: list[str], payload: list[str]) -> DataFrame:
    """(by, block, h, alone, levels, kids): a nested struct per block of ``rank``; one exchange for all digits."""
    digits = [f"cast(rank div {FANOUT ** k} % {FANOUT} as int) as d{k}" for k in range(DIGITS)]
    fields = ", ".join(f"`{c}`" for c in payload)
    rows = nodes.selectExpr(*[f"`{c}`" for c in by], f"rank div {BLOCK} as block", *digits, "h",
                            f"struct({fields}) as row").repartition(*by, "block")
    kept = ["row"]
    for k in range(DIGITS):
        above = ["block", *[f"d{i}" for i in reversed(range(k + 1, DIGITS))]]
        rows = _nested(rows, [*by, *above], f"d{k}", above, kept)
        kept = ["alone", "levels", "kids"]
    return rows


def _path(alone: str, levels: str, i: str) -> str:
    """Steps from child ``i`` to its node: the side the child is on (1: right) and its sibling (null: it has none)."""
    steps = []
    for j in range(LEVELS):
        at = f"({i} div {2 ** j})"
        sibling = f"get({levels}[{j}], cast({at} + 1 - 2 * ({at} % 2) as int))"
        steps.append(f"if({alone} and size({levels}[{j}]) = 1, null, struct(cast({at} % 2 as int) as side, {sibling} as h))")
    return f"cast(array_compact(array({', '.join(steps)})) as {STEPS})"


def _emitted(blocks: DataFrame, by: list[str]) -> DataFrame:
    """(by, payload, subroot, root, steps) of every leaf of the blocks."""
    steps = ", ".join([_path("g1.alone", "g1.levels", "i0"), _path("g2.alone", "g2.levels", "i1"), _path("alone", "levels", "i2"), "above"])
    leaves = (f"flatten(transform(kids, (g2, i2) -> flatten(transform(g2.kids, (g1, i1) -> transform(g1.kids, "
              f"(leaf, i0) -> struct(leaf.row as row, concat({steps}) as steps))))))")
    out = blocks.selectExpr(*[f"`{c}`" for c in by], "subroot", "root", f"explode({leaves}) as leaf")
    return out.selectExpr(*[f"`{c}`" for c in by], "leaf.row.*", "subroot", "root", "leaf.steps as steps")


def _rollup(nodes: DataFrame, by: list[str], payload: list[str], finish) -> DataFrame:
    """Proofs of ``nodes`` (by, rank, h, payload); ``finish`` gives the rows above blocks that are alone in their group."""
    blocks = settle(_blocks(nodes, by, payload), "blocks")
    last = blocks.agg(F.max("block")).first()[0] or 0
    if last == 0:
        above = finish(blocks.select(*by, "block", "h"))
    else:
        above = _rollup(blocks.select(*by, F.col("block").alias("rank"), "h", "block"), by, ["block"], finish)
    nested = ["alone", "levels", "kids"]
    none = {c: F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in nested}
    upper = above.select(*by, "block", *none.values(), "subroot", "root", F.col("steps").alias("above"))
    lower = blocks.select(*by, "block", *nested, *[F.lit(None).cast(t).alias(c) for c, t in (
        ("subroot", "string"), ("root", "string"), ("above", STEPS))])
    both = lower.unionByName(upper).groupBy(*by, "block").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in (*nested, "subroot", "root", "above")])
    return _emitted(both, by)


def _root(tops: DataFrame) -> DataFrame:
    return tops.select("block", F.lit(None).cast("string").alias("subroot"), F.col("h").alias("root"),
                       F.array().cast(STEPS).alias("steps"))


def merkle_proofs(leaves: DataFrame, by: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """(by, payload, subroot, root, steps) of every row of ``leaves``, whose digest is the column ``h``.

    ``order`` ranks the rows of a group (nulls first, then the digest, so rows
    that are equal in both are alike); groups ascend by ``by``, null first.
    ``steps`` lead from the leaf to the root.  An empty table has no proofs.
    """
    kept = list(dict.fromkeys([*by, *order, *payload, "h"]))
    ranked = row_index(leaves.select(*kept), by, [*order, "h"], "rank")

    def forest(tops: DataFrame) -> DataFrame:
        groups = row_index(tops.select(*by, "h"), [], by, "rank")
        up = _rollup(groups.withColumn("own", F.col("h")), [], [*by, "own"], _root)
        return up.select(*by, F.lit(0).cast("long").alias("block"), F.col("own").alias("subroot"), "root", "steps")

    return _rollup(ranked, by, payload, forest if by else _root)


def fold(leaf: str, steps: str = "steps") -> Column:
    """The root that a leaf and the siblings of its steps lead to."""
    return F.expr(f"aggregate({steps}, {leaf}, (h, s) -> sha2(if(s.side = 1, concat(s.h, h), concat(h, coalesce(s.h, ''))), 256))")


def siblings_text(steps: str = "steps") -> Column:
    """The digests of all siblings, from the leaf upwards."""
    return F.expr(f"array_join(transform({steps}, s -> s.h), '')")


#: Columns that make a leaf of ``documents``, in this order.
LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def document_leaves(docs: DataFrame, changed: Column, columns: list[str] = LEAF_COLUMNS, count: str = "n_chars") -> DataFrame:
    """(doc_id, lang, h, tampered): the digest of each row, and of the row with ``count`` + 1 where ``changed`` holds."""
    values = [F.col(c) for c in columns]
    more = [F.col(c).cast("decimal(20,0)") + 1 if c == count else F.col(c) for c in columns]
    return docs.select("doc_id", "lang", leaf_hash(values).alias("h"), F.when(changed, leaf_hash(more)).alias("tampered"))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the root that a tampered copy leads to.

    Rows whose crc32 of the decimal id is divisible by 7 are tampered with in
    the copy (``n_chars`` + 1; null stays null).  A null field is ``-`` in its
    leaf, a null language a group of its own before all others; null ids come
    first in their group and are not tampered with, repeated rows are leaves of
    their own, an empty table gives no row.  Other columns are not read.
    """
    changed = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaves = document_leaves(docs, changed).withColumn("leaf", F.col("h"))
    proofs = merkle_proofs(leaves, ["lang"], ["doc_id"], ["doc_id", "leaf", "tampered"])
    folded = proofs.withColumn("folded_root", fold("coalesce(tampered, leaf)"))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings_text(), 256).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "lang", "steps")
