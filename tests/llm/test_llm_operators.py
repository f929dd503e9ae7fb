"""Each operator against a brute-force version on small tables with nulls, ties, repeats and hot groups."""

import array
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from txloom.llm import columns, ledger, lines, minhash, packing, rans, rollup, rules, sketch, stats, tokens, viterbi
from txloom.llm.text import Words, text_buffer

from llm_helpers import WORD, library, shingles, table


@pytest.fixture(scope="module")
def mixed():
    """Nulls, empty and blank texts, one long text, repeated ids and rows, copies, near copies, odd signs."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "One two"), (4, "one  TWO"), (None, "null id here"), (None, None),
            (5, "naïve İstanbul's 12,345 <|endoftext|> don't — 中文字 ß×÷ é \x1c x\x00y"), (5, "same id, other text"),
            (6, "long " * 30_000), (7, base[0]), (7, base[0])]
    for k in range(8, 70):
        text = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 3])):
            text[rng.randrange(len(text))] = f"edit{k}"
        rows.append((k, " ".join(text[:60]) + "\n" + " ".join(text[60:])))
    return rows


def test_ids_are_those_of_the_library(mixed):
    texts = [t or "" for _, t in mixed]
    ids, at = tokens.encoder().encode(pa.array(texts))
    plain = library()
    for k, text in enumerate(texts):
        assert ids[at[k]:at[k + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB1é'<|ÀÿŸß×.,#́Å \n\t\x1c\x85 中İ_-", max_size=25), max_size=4))
def test_ids_of_any_text(texts):
    ids, at = tokens.encoder().encode(pa.array(texts, pa.string()))
    plain = library()
    for k, text in enumerate(texts):
        assert ids[at[k]:at[k + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60_000), max_size=400), st.integers(1, 300))
def test_range_coder_round_trip(ids, block):
    ids = np.array(ids, dtype=np.uint32)
    coded = rans.encode_ids(ids, block)
    assert (rans.decode_ids(coded) == ids).all()


def test_blocks_decode_alone_and_checksums_bite():
    ids = np.arange(5000, dtype=np.uint32) % 97
    coded = rans.encode_ids(ids, 1000)
    per = coded["steps"] * coded["lanes"]
    assert (rans.decode_ids(coded, 1, 3) == ids[per:3 * per]).all()
    bad = bytearray(coded["payload"])
    bad[len(bad) // 2] ^= 1
    with pytest.raises((ValueError, IndexError)):
        rans.decode_ids({**coded, "payload": bytes(bad)})


def test_token_files(spark, mixed):
    plain = library()
    want, at = [], 0
    for doc, text in sorted(mixed, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc, at, len(ids), zlib.crc32(array.array("I", ids).tobytes())))
        at += len(ids)
    got = rans.token_files(table(spark, mixed).withColumnRenamed("lang", "part")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert rans.token_files(table(spark, [])).collect() == []


@pytest.mark.parametrize("limits", [(4096, 512, None), (64, 3, 40), (16, 512, None)])
def test_packing(spark, mixed, limits):
    size, segments, loss = limits
    out = packing.pack_documents(table(spark, mixed), tokens=size, segments=segments, loss=loss).collect()
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size and len(pieces) <= segments and sum(r.loss_tokens for r in pieces) <= (loss or size)
        padding += 0 if at & (at - 1) == 0 else size - at
    assert padding == 0 or (segments, loss) != (512, None)
    plain = library()
    want = Counter((doc, len(plain.encode(text or "", add_special_tokens=False).ids) + 1) for doc, text in mixed)
    got = Counter()
    for r in out:
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == Counter({k: k[1] * n for k, n in want.items()})
    assert packing.pack_documents(table(spark, [])).collect() == []


def components(rows, percent=85):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, a in enumerate(sets):
        for j, b in enumerate(sets[:k]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[max(top(k), top(j))] = min(top(k), top(j))
    out = []
    for k, (doc, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if top(j) == top(k) and rows[j][0] is not None]
        component = (min(same) if same else None) if sets[k] else doc
        out.append((doc, len(sets[k]), component, doc == component))
    return sorted(out, key=str)


def near(spark, rows):
    found = minhash.near_duplicates(table(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept")
    return sorted(map(tuple, found.collect()), key=str)


def test_near_duplicates(spark, mixed):
    assert near(spark, mixed) == components(mixed)
    assert near(spark, []) == []


def test_near_duplicates_in_one_hot_group(spark, monkeypatch):
    """Many texts around the threshold share every bucket; links do not all meet its first class."""
    monkeypatch.setattr(minhash, "BLOCK", 32)
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = []
    for k in range(160):
        text = list(base)
        for _ in range(rng.randrange(7)):
            text[rng.randrange(len(text))] = f"z{rng.randrange(9999)}"
        rows.append((k, " ".join(text)))
    assert near(spark, rows) == components(rows)


def test_one_of_each_group(spark, mixed):
    docs = table(spark, mixed).selectExpr("doc_id", "text", "lang as place", "source as digest", "n_chars")
    kept = minhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    want = {(d, t) for (d, t), (_, _, _, keep) in zip(sorted(mixed, key=str), _by_row(mixed)) if keep}
    assert set(got) == want and got[7, mixed[10][1]] == 1


def _by_row(rows):
    ordered = sorted(rows, key=str)
    found = {}
    for doc, text in ordered:
        found[doc, text] = None
    by_id = {}
    for (doc, n, component, keep) in components(ordered):
        by_id.setdefault((doc, n), (doc, n, component, keep))
    return [by_id[doc, len(shingles(text))] for doc, text in ordered]


def test_posterior_limits_grow():
    least = minhash.least_matches(0.85, 1e-6)
    assert list(least) == sorted(least) and least[-1] < 0.85 * minhash.HASHES
    same = np.ones((3, minhash.HASHES), np.uint32)
    other = same.copy()
    other[1, ::2] = 5
    other[2] = 7
    assert minhash.posterior_keeps(same, other, 0.85, 1e-6).tolist() == [True, False, False]


def test_edit_fingerprints(spark, mixed):
    order = sorted(mixed, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for k, (doc, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        edited = text[:len(text) - n] + after[:n]
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    out = sketch.edit_test(table(spark, mixed)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in out), key=str) == sorted(want, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    marks = {r.doc_id: r.fingerprint for r in out}
    assert marks[3] == marks[4] and marks[1] == marks[2] == ""
    assert sketch.edit_test(table(spark, [])).collect() == []


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << sketch.HASH_BITS, 4000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[::10], rng.integers(0, 1 << sketch.HASH_BITS, 40_000, dtype=np.uint64)]))
    x, y = sketch.canonical(a), sketch.canonical(b)
    assert (sketch.merge(x, y) == sketch.canonical(np.union1d(a, b))).all()
    assert (sketch.from_text(sketch.to_text(x)) == x).all()
    assert sketch.containment(x, y) == pytest.approx(0.1, abs=0.03)
    lone = np.array([(1 << sketch.HASH_BITS) - 1], dtype=np.uint64)
    assert (sketch.canonical(lone) == lone).all() and (sketch.merge(lone, x) == x).all()
    assert sketch.likeness(x, x) == 1.0 and sketch.likeness(x, lone[:0]) == 0.0


def without_repeats(rows, length):
    count = Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        count.update(b[s:s + length] for s in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        out.append((i, len(b), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,gram,hot", [(20, 6, 512), (20, 6, 2), (12, 3, 0), (8, 8, 3)])
def test_repeated_strings(spark, monkeypatch, length, gram, hot):
    rng = random.Random(length)
    passages = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (15, 25, 40, 60)]
    rows = []
    for k in range(70):
        parts = [rng.choice([rng.choice(passages), "".join(rng.choice("xyzuv ") for _ in range(rng.randint(0, 30)))])
                 for _ in range(rng.randint(0, 6))]
        rows.append((k if k % 17 else None, "".join(parts) if k % 13 else None))
    rows += [(500, "a" * 150), (501, "ab" * 50), (7, rows[7][1]), (502, "")]
    docs = table(spark, rows)
    spans = columns.repeated_spans(docs, length, gram, hot)
    monkeypatch.setattr(columns, "repeated_spans", lambda d, n: spans)
    got = [(r.doc_id, r.n_bytes, bytes(r.kept)) for r in columns.drop_repeated_strings(docs, length).collect()]
    assert sorted(got, key=str) == without_repeats(rows, length)


def test_no_strings_in_an_empty_table(spark):
    assert columns.drop_repeated_strings(table(spark, [])).collect() == []


def best_score(pieces, word):
    """(score, ids) of a marked word by a search over all its prefixes, without shared work."""
    known = {p: (i, s) for i, (p, s) in pieces.items()}
    best = [(0.0, [])]
    for i in range(1, len(word) + 1):
        found = None
        for j in range(i):
            hit = known.get(word[j:i])
            if hit and (found is None or best[j][0] + hit[1] > found[0]):
                found = (best[j][0] + hit[1], best[j][1] + [hit[0]])
        best.append(found)
    return best[-1]


@settings(max_examples=80, deadline=None)
@given(st.sets(st.text(alphabet="abc", min_size=1, max_size=6), min_size=1, max_size=12))
def test_shared_prefix_search_is_the_plain_one(words):
    rng = random.Random(len(words))
    names = ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "bb", "aab"]
    pieces = {i: (p, -float(rng.randint(1, 6))) for i, p in enumerate(names)}
    model = viterbi.Pieces([pieces[i] for i in range(len(names))], {})
    ordered = sorted(words)
    assert model.solve(ordered) == [best_score(pieces, w)[1] for w in ordered]


def library_ids(texts):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(viterbi.MODEL)).encode(texts, num_threads=1)


def own_ids(texts):
    ids, offsets = viterbi.piece_encoder().encode(pa.array(texts))
    return [ids[s:e].tolist() for s, e in zip(offsets.tolist(), offsets.tolist()[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="the aeiornst \n.", max_size=60),
                          st.text(alphabet="\u4e00\u68a6\U0001f600\u00e9 ax\t", max_size=20)), min_size=1, max_size=5))
def test_pieces_are_those_of_the_library(texts):
    assert own_ids(texts) == library_ids(texts)


def test_long_words_and_all_documents_have_the_ids_of_the_library(spark):
    rng = random.Random(5)
    texts = ["a" * 20000, "the " + "".join(rng.choices("etaoinshr", k=9000)) + " end", "=" * 5000 + "x", "ab" * 3000 + " ab", " " * 300 + "x"]
    assert own_ids(texts) == library_ids(texts)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    found = {r.doc_id: list(r.ids) for r in viterbi.encode_pieces(docs).collect()}
    assert [found[r.doc_id] for r in rows] == library_ids([r.text or "" for r in rows])


def test_pieces_round_trip(spark, mixed):
    docs = table(spark, mixed)
    encoded = viterbi.encode_pieces(docs)
    decoded = Counter((r.doc_id, r.text) for r in viterbi.decode_pieces(encoded).collect())
    assert decoded == Counter((doc, text or "") for doc, text in mixed)
    out = viterbi.piece_summary(docs).collect()
    assert len(out) == len(mixed) and all(r.same_text for r in out)
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(viterbi.MODEL))
    for r in encoded.collect():
        assert r.doc_id is None or model.decode(list(r.ids)) in [t or "" for d, t in mixed if d == r.doc_id]


def test_rollups_follow_signed_changes(spark, tmp_path):
    counts = spark.createDataFrame([("a", "en", "t", 1, 10, 40), ("a", "en", "t", 2, 5, 20), (None, None, "t", 3, 7, 30)],
                                   "source string, lang string, tokenizer string, doc_id long, n_tokens long, n_chars long")
    path = str(tmp_path)
    assert rollup.totals(spark, f"{path}/none").collect() == []
    assert rollup.commit(rollup.signed(counts, 1), path, "b1")
    assert rollup.commit(rollup.signed(counts.where("doc_id = 3"), -1), path, "b2")
    old = counts.where("doc_id = 2")
    assert rollup.commit(rollup.revised(old, old.selectExpr("source", "'de' as lang", "tokenizer", "6L as n_tokens", "n_chars")),
                         path, "b3")
    assert not rollup.commit(rollup.signed(counts, 1), path, "b1")
    (tmp_path / "batch=b4").mkdir()  # an attempt that failed half way
    want = [("a", "de", "t", 1, 6, 20), ("a", "en", "t", 1, 10, 40)]
    assert sorted(map(tuple, rollup.totals(spark, path).collect())) == want
    assert rollup.commit(rollup.signed(counts.limit(0), 1), path, "b4")
    assert sorted(map(tuple, rollup.totals(spark, path).collect())) == want
    with pytest.raises(ValueError):
        rollup.commit(counts, path, "a/b")


def test_token_counts(spark, mixed):
    plain = library()
    got = Counter((r.doc_id, r.n_tokens, r.n_chars) for r in rollup.token_counts(table(spark, mixed)).collect())
    assert got == Counter((d, len(plain.encode(t or "", add_special_tokens=False).ids), len(t or "")) for d, t in mixed)


def test_repeated_lines(spark):
    rows = [(3, "A b c d e\nown line of three here\na  b C d e"), (1, "x\na b c d e\nx"), (None, "a b c d e"), (2, None),
            (4, "a b c d e"), (4, "a b c d e"), (5, ""), (6, "tail stays alone here now\r\na b c d e\n")]
    docs = table(spark, rows).withColumnRenamed("lang", "spans").withColumnRenamed("source", "place")
    out = lines.drop_repeated_units(docs)
    assert out.columns == [*docs.columns, "removed"]
    got = sorted(((r.doc_id, r.text, [(s.start, s.end) for s in r.removed]) for r in out.collect()), key=str)
    want = [(3, "own line of three here\n", [(0, 9), (33, 43)]), (1, "x\na b c d e\nx", []), (None, "", [(0, 9)]), (2, None, []),
            (4, "", [(0, 9)]), (4, "", [(0, 9)]), (5, "", []), (6, "tail stays alone here now\r\n", [(27, 36)])]
    assert got == sorted(want, key=str)
    assert lines.drop_repeated_units(docs.limit(0)).collect() == []


def test_paragraph_units():
    text = "one two three four five\nsix\n\nshort\n\n\none two"
    doc, start, end, count, *_ = lines.text_units(pa.array([text]), paragraphs=True)
    assert [text[s:e].strip("\n") for s, e in zip(start, end)] == ["one two three four five\nsix", "short", "one two"]


def measures(text):
    text = text or ""
    words = [w.decode() for w in WORD.findall(text.encode())]
    triples = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if triples[tuple(words[i:i + 3])] > 1 for k in range(3)}
    used = [x for x in text.split("\n") if WORD.search(x.encode())]
    return dict(n_chars=len(text), n_words=len(words), word_chars=sum(map(len, words)), n_lines=len(used),
                n_dup_lines=len(used) - len(set(used)), n_repeat_words=len(covered), n_distinct_words=len(set(words)),
                n_symbols=len(re.findall(r"[#*$%&|<>]", text)), top_word=max(Counter(words).values(), default=0))


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aab é\n\t#<", max_size=40)), max_size=5))
def test_measures_of_any_text(texts):
    found = stats.measure(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        for name, value in measures(text).items():
            assert found[name][k] == value, name


def test_rule_ledger(spark, mixed):
    book = ledger.apply_policy(ledger.rule_ledger(table(spark, mixed))).collect()
    assert len(book) == len(mixed)
    for r in book:
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == base and (not base or not r.kept)
        assert r.kept == (r.fail_bits & ledger.mask(ledger.CURRENT) == 0)
    shown = {r.rule: (r.failed, r.only_this) for r in ledger.ablations(ledger.rule_ledger(table(spark, mixed))).collect()}
    for rule in ledger.RULES:
        bit = 1 << rule.bit
        assert shown[rule.name] == (sum(r.fail_bits & bit > 0 for r in book), sum(r.fail_bits == bit for r in book))
    assert ledger.rule_ledger(table(spark, [])).collect() == []
    with pytest.raises(ValueError):
        ledger.mask(("no such rule",))


def test_kept_documents_carry_all_columns(spark, mixed):
    docs = table(spark, mixed).selectExpr("n_chars as fail_bits", "doc_id", "text", "lang as n_words")
    kept = ledger.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(
        r.kept for r in ledger.apply_policy(ledger.rule_ledger(docs.select("doc_id", "text"))).collect())


def test_tree_paths():
    printed = "Model\n  Tree 0 (weight 1.0):\n    If (feature 0 <= 0.5)\n     If (feature 0 <= 0.25)\n      Predict: 1.0\n" \
              "     Else (feature 0 > 0.25)\n      Predict: 0.0\n    Else (feature 0 > 0.5)\n     Predict: 0.0\n"
    assert rules.tree_paths(printed, ["x"]) == [(("x", "<=", 0.5),), (("x", "<=", 0.25),),
                                                (("x", "<=", 0.5), ("x", ">", 0.25)), (("x", ">", 0.5),)]


def test_rule_classifier(spark):
    rng = random.Random(9)
    good = [" ".join(rng.choice("the of and to in was it for".split()) + rng.choice("abcde") for _ in range(80)) for _ in range(120)]
    bad = ["#$% " * rng.randint(30, 60) for _ in range(60)]
    rows = [*enumerate(good + bad), (900, None), (None, "no id")]
    docs = table(spark, rows).withColumnRenamed("lang", "label").withColumnRenamed("source", "score")
    labels = spark.createDataFrame([(k, int(k < 120), 0) for k in range(180)] + [(None, 1, 0), (3, None, 0)],
                                   "doc_id long, quality int, toxic int")
    scored, model = rules.classify(docs, labels, keep=["doc_id"])
    got = scored.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
            if r.doc_id < 180:
                assert r.predicted == int(r.doc_id < 120)
    assert model.rules
    kept = rules.accepted_documents(docs, labels)
    assert kept.columns == docs.columns and set(range(120)) <= {r.doc_id for r in kept.collect()}
    flat, _ = rules.classify(docs, labels.limit(0), keep=["doc_id"])
    assert {r.score for r in flat.collect()} == {0.5}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n", max_size=30), max_size=5))
def test_words(texts):
    words = Words(*text_buffer(pa.array(texts, pa.string())))
    assert words.counts.tolist() == [len(WORD.findall(t.encode())) for t in texts]
    forms = [w for t in texts for w in WORD.findall(t.encode())]
    assert len(set(words.hashes.tolist())) == len(set(forms))
