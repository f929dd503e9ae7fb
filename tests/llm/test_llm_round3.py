"""Merkle manifest, hard negatives and pattern packing against brute force, with the odd cases of each."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from llm_helpers import SCHEMA, library
from txloom.llm import manifest, negatives, patterns


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}"
                       for c in ("doc_id", "source", "lang", "n_chars", "text")))


def climb(hashes):
    """(root, siblings of each leaf from below)."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for k, p in enumerate(at):
            if p ^ 1 < len(hashes):
                paths[k].append(hashes[p ^ 1])
        hashes = [sha("".join(hashes[k:k + 2])) for k in range(0, len(hashes), 2)]
        at = [p // 2 for p in at]
    return hashes[0], paths


def proofs(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    found = []
    for lang in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        own = sorted(groups[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        found.append((own, *climb([leaf_of(r) for r in own])))
    root, upper = climb([sub for _, sub, _ in found])
    for (own, sub, paths), above in zip(found, upper):
        for r, path in zip(own, paths):
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            yield r["doc_id"] if r["doc_id"] is not None else -1, leaf_of(r), sub, root, sha("".join(path + above)), not changed


@pytest.mark.parametrize("sizes", [(1,), (2, 1, 3), (17, 16, 1, 33, 5), (4097, 256, 40)])
def test_manifest_against_brute_force(spark, sizes):
    """Groups of one leaf, of whole and broken runs, and of more than one block."""
    rows, langs = [], [None, "en", "é", "ü", "zz"]
    for lang, n in zip(langs, sizes):
        rows += [dict(doc_id=len(rows) + k, text=f"t{k}é" if k % 5 else None, lang=lang, source="s" if k % 3 else None,
                      n_chars=k if k % 4 else None) for k in range(n)]
    rows += [dict(doc_id=None, text="x", lang="en", source=None, n_chars=1)] * 3 + rows[:2]
    docs = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    clash = docs.withColumns({c: F.lit(c) for c in ("h", "rank", "block", "Leaf", "row", "root", "steps", "kids", "d0", "tampered")})
    got = manifest.verified_manifest(clash).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in got) == sorted(proofs(rows))
    assert all((r.folded_root == r.root) == r.verified for r in got)


def test_manifest_of_an_empty_table(spark):
    assert manifest.verified_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def mined(rows):
    """Brute force over (vec_id, label, whole vector) rows; rows that share an id count each, none for its own id."""
    out = []
    for aid, label, q in rows:
        if aid % 100:
            continue
        score = [(-sum(a * b for a, b in zip(q, x)), v, tag) for v, tag, x in rows if v != aid]
        good = sorted((s, v) for s, v, tag in score if tag == label)[:5]
        for ps, pid in good:
            inside = sorted((s, v) for s, v, tag in score if tag != label and 30 * -ps <= 100 * -s <= 90 * -ps)[:10]
            out += [(aid, pid, k + 1, v, -ps, -s) for k, (s, v) in enumerate(inside)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double, low string")


def found(spark, rows):
    df = negatives.vectors_of(vectors(spark, [(*r, 1.0, "x") for r in rows]), "vec_id", "embedding", "label")
    keys = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in keys) for r in negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).collect())


def whole(rows):
    ok = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[1])]
    return [(i, tag, [int(np.floor(256 * float(np.float32(v)))) for v in x]) for i, x, tag in ok]


def test_hard_negatives_against_brute_force(spark):
    """Clusters, a hot group of equal vectors, ties, nulls, odd values, short and empty vectors, shared ids."""
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = [(k, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)], rng.randrange(3)) for k in range(900)]
    rows += [(k, centres[0], k % 2) for k in range(1000, 1500)]
    rows += [(2000, None, 1), (2100, [0.1, None, 0.2], 1), (2200, [float("nan")] * 6, 0), (2300, [float("inf")] * 6, 0), (2400, centres[1], None),
             (None, centres[1], 1), (2500, [], 1), (2600, [1.0, 0.5], 1), (2601, centres[2], 7), (2700, centres[2], 9), (300, centres[3], 2), (301, centres[3], 2)]
    got = found(spark, rows)
    assert got == mined(whole(rows)) and len(got) > 300


def test_hard_negatives_of_large_values_and_no_rows(spark):
    rows = [(k, [1e6 * (k % 7 + 1), -3e3 * k, 2.0 ** 20], k % 2) for k in range(0, 300, 5)]
    assert found(spark, rows) == mined(whole(rows))
    assert found(spark, []) == []
    assert found(spark, [(100, [1.0], 1)]) == []


def test_tree_leaves_nothing_out_and_eliminates():
    """Every row in a window lies in a visited leaf; on clustered rows most leaves are not visited."""
    rng = np.random.default_rng(5)
    x = np.floor(256 * (rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + 0.02 * rng.normal(size=(3000, 16))))
    tree = negatives.Tree(x[:600], float((x * x).sum(axis=1).max()), 4, 16)
    for node in tree.nodes:
        node.low, node.high = np.full((2, len(node.parts), len(node.parts)), np.inf)
        node.high = -node.high
    for at, low, high in tree.ranges(x):
        tree.nodes[at].low, tree.nodes[at].high = np.fmin(tree.nodes[at].low, low), np.fmax(tree.nodes[at].high, high)
    leaf, q = tree.route(x), x[rng.integers(0, 3000, 200)]
    score = q @ x.T
    best = -np.sort(-score, axis=1)[:, :5]
    for low, high in ((best[:, 4], np.full(200, 1e15)), (0.3 * best[:, 4], 0.5 * best[:, 0]), (best[:, 0] + 1, best[:, 0])):
        go = tree.visits(q, low[:, None], high[:, None])
        a, r = np.nonzero((score >= low[:, None]) & (score <= high[:, None]))
        assert go[a, leaf[r]].all()
    first = tree.visits(q, best[:, 4:5], np.full((200, 1), 1e15))
    assert tree.leaves > 20 and first.mean() < 0.25


def placed(plan, tokens):
    got = np.zeros(tokens + 1, np.int64)
    for times, content in plan:
        assert times > 0 and sum(length * n for length, n in content) <= tokens
        for length, n in content:
            got[length] += times * n
    return got


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 64), st.integers(1, 300)), max_size=12), st.sampled_from([1, 7, 64]))
def test_plans_place_every_piece(lengths, tokens):
    histogram = np.zeros(tokens + 1, np.int64)
    for length, n in lengths:
        histogram[min(length, tokens)] += n
    plan = patterns.packing_plan(histogram, tokens)
    assert (placed(plan, tokens) == histogram).all()
    slots = patterns.Slots(plan, tokens)
    length = np.repeat(np.arange(tokens + 1), histogram)
    rank = np.arange(len(length)) - np.repeat(np.cumsum(histogram) - histogram, histogram)
    if len(length):
        sequence, offset = slots.find(length, rank)
        order = np.lexsort((offset, sequence))
        s, o, n = sequence[order], offset[order], length[order]
        new = np.r_[True, s[1:] != s[:-1]]
        assert (o[new] == 0).all() and (o[1:][~new[1:]] == (o + n)[:-1][~new[1:]]).all() and new.sum() == slots.sequences
    one = patterns.best_fit(histogram, tokens)
    assert (placed(one, tokens) == histogram).all()


def test_best_fit_is_the_plain_one():
    rng = random.Random(2)
    for _ in range(50):
        items = sorted((rng.randrange(1, 41) for _ in range(rng.randrange(0, 120))), reverse=True)
        space = []
        for x in items:
            fits = [s for s in space if s >= x]
            if fits:
                space.remove(min(fits))
            space.append((min(fits) if fits else 40) - x)
        plan = patterns.best_fit(np.bincount(items, minlength=41) if items else np.zeros(41, int), 40)
        assert sorted(40 - sum(n * k for n, k in c) for t, c in plan for _ in range(t)) == sorted(space)


def test_patterns_fill_a_sequence():
    rows = patterns.length_patterns(60)
    assert all(a * p + b * q == 60 and p + q <= 4 for a, p, b, q in rows.tolist())
    assert len({tuple(sorted([a] * p + [b] * q)) for a, p, b, q in rows.tolist()}) == len(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_plans_come_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    for lengths in (rng.integers(1, 2049, 30000), np.clip(rng.lognormal(5.8, 1, 30000).astype(int), 1, 2048)):
        plan = patterns.packing_plan(np.bincount(lengths, minlength=2049))
        assert sum(t for t, _ in plan) <= 1.004 * -(-lengths.sum() // 2048)


def test_pattern_packing_of_documents(spark):
    """Null, empty, long and repeated texts, null and equal ids, clashing columns."""
    rng = random.Random(6)
    texts = [None, "", " \n", "one two", "long " * 9000, *[" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 900))) for _ in range(60)]]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)] + [(None, "same row", "en", "s", 1)] * 40 + [(7, "other", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("length", "piece", "rank", "Salt", "start")})
    got = [r.asDict() for r in patterns.pack_patterns(docs).collect()]
    plain, want = library(), []
    for doc, text, *_ in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(-1 if doc is None else doc, k, 2048 * k, len(part), zlib.crc32(part.tobytes()))
                 for k, part in enumerate(ids[i:i + 2048] for i in range(0, len(ids), 2048))]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    held = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == held.get(r["sequence_id"], 0)
        held[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(held.values()) <= 2048 and len(held) == max(-(-sum(held.values()) // 2048), 1)
    assert patterns.pack_patterns(docs.limit(0)).collect() == []
