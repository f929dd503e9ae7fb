"""Pipeline stages on small planted cases."""

import random

import corpus_pipeline
from llm_helpers import SCHEMA, WORD, shingles, table
from txloom.llm import lines, passages


def test_stage_links_from_80_percent(spark):
    base = [f"w{k}" for k in range(204)]
    near, far = list(base), list(base)
    for k in (20, 70, 120, 170):
        near[k] = f"x{k}"
    for k in (20, 60, 100, 140, 180):
        far[k] = f"y{k}"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    one, two, three = (shingles(t) for _, t in rows)
    assert 0.80 <= len(one & two) / len(one | two) < 0.85 and len(one & three) / len(one | three) < 0.80
    kept = corpus_pipeline.near_duplicates(spark, table(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def covered(rows, size):
    """Bytes under the later ones of equal windows, in each row."""
    first, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = text.encode()
        at = [m.span() for m in WORD.finditer(raw.lower())]
        own = out.setdefault((doc, text), set())
        for k in range(len(at) - size + 1):
            key = tuple(raw[s:e].lower() for s, e in at[k:k + size])
            start, end = at[k][0], at[k + size - 1][1]
            where = first.setdefault(key, (doc, text, start, end))
            if where[:3] != (doc, text, start):
                own.update(range(max(start, where[3]) if where[:2] == (doc, text) else start, end))
    return out


def test_passages_against_all_windows(spark):
    rng = random.Random(8)
    pool = [[f"p{k}w{i}" for i in range(rng.choice([40, 50, 51, 52, 60, 130]))] for k in range(12)]
    rows = [(1, "long " * 300), (2, "a b c " * 60 + "end"), (None, " ".join(pool[5] + pool[4])), (3, "")]
    for doc in range(10, 70):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += rng.choice(pool) if rng.random() < 0.7 else [f"d{doc}u{rng.randrange(10**6)}" for _ in range(30)]
        rows.append((doc, "".join(w.upper() * (rng.random() < 0.1) or w for w in [x + rng.choice([" ", " ", "\n", "  "]) for x in words])))
    rows.append(rows[-1])
    docs = table(spark, rows)
    places = {(r.doc_id, r.place): r.text for r in docs.selectExpr("doc_id", "xxhash64(text) as place", "text").collect()}
    got = {k: set() for k in covered(rows, 51)}
    for r in passages.repeated_passages(docs).collect():
        got[r.doc_id, places[r.doc_id, r.place]].update(*(range(s.start, s.end) for s in r.spans))
    assert got == covered(rows, 51) and sum(map(bool, got.values())) > 20


def test_stage_cuts_a_passage_inside_lines(spark):
    passage = [f"p{k}" for k in range(60)]
    own = [[f"{d}{k}" for k in range(40)] for d in "abc"]
    rows = [(1, " ".join(own[0] + passage) + "\nfirst tail"),
            (2, " ".join(own[1][:20] + passage[:25]) + "\n" + "  ".join(passage[25:] + own[1][20:])),
            (3, " ".join(own[2] + passage[:50]))]
    left = {r.doc_id: r.text.split() for r in corpus_pipeline.substring_dedup(spark, table(spark, rows), "").collect()}
    assert left == {1: own[0] + passage + ["first", "tail"], 2: own[1], 3: own[2] + passage[:50]}


def test_stage_cuts_short_lines(spark):
    rows = [(1, "read more\nfirst text"), (2, "second text\nRead  more\nfirst"), (3, "first\nthird")]
    left = {r.doc_id: r.text for r in corpus_pipeline.substring_dedup(spark, table(spark, rows), "").collect()}
    assert left == {1: "read more\nfirst text", 2: "second text\nfirst", 3: "third"}


def test_column_called_removed_and_one_word_texts(spark):
    """A clashing name stays, and a text of one word a million times costs a sort."""
    rows = [(1, "same words in two lines here", "a"), (2, "same words in two lines here\nown", "b"), (3, "long " * 600_000, "c")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), x) for i, t, x in rows], SCHEMA + ", Removed string")
    cut = lines.drop_repeated_units(docs, min_words=1, passage=passages.PASSAGE)
    assert cut.columns == [*docs.columns, "removed_1"]
    got = {r.doc_id: (r.text, r.Removed, [(s.start, s.end) for s in r.removed_1]) for r in cut.collect()}
    assert got[1] == (rows[0][1], "a", []) and got[2] == ("own", "b", [(0, 28)])
    assert got[3][2] == [(51 * 5 - 1, 3_000_000 - 1)]
    stage = corpus_pipeline.substring_dedup(spark, docs, "")
    assert stage.columns == docs.columns and stage.where("doc_id = 2").first().text == "own"
