"""Fingerprints against a walk written plainly."""

import hashlib
import random

import numpy as np

from tests.llm.conftest import words
from tidemark.llm import edit_embedding as ee


def walk(text: str) -> str:
    """One text's fingerprint, a step at a time."""
    x = [*ee.codes(text).tolist(), ee.STOP]
    shown, at, step = [], 0, 0
    while x[at] != ee.STOP or step % ee.DRAWN:
        shown.append(x[at])
        at += int(ee.moves(step // ee.DRAWN)[step % ee.DRAWN][x[at]])
        step += 1
    out, octave = "", 0
    while octave == 0 or ee.SAMPLES << (octave - 1) < len(shown):
        for s in ee.sampled_steps(octave):
            out += "f" if s >= len(shown) or shown[s] == ee.STOP else "0123456789abcde"[shown[s] % 15]
        octave += 1
    return out.rstrip("f")


def test_walks_equal_plain_ones():
    r = random.Random(4)
    texts = ["", "a", "é日本", words(r, 300), words(r, 5000)]
    assert ee.digits(ee.fingerprints(texts)) == [walk(t) for t in texts]


def test_few_edits_give_like_fingerprints():
    r = random.Random(5)
    base = words(r, 400)
    near = base[:500] + "xy" + base[503:1200] + base[1201:]
    p = ee.fingerprints([base, near, words(r, 400)])
    assert ee.likeness(p[:1], p[1:2])[0] > 0.8 > 0.3 > ee.likeness(p[:1], p[2:])[0]
    empty = np.full((1, 32), ee.PAD, np.uint8)
    assert ee.likeness(empty, empty)[0] == 1.0


def test_rows(spark, messy, empty):
    docs = [(r.doc_id, r.text or "") for r in messy.collect()]
    rows = ee.fingerprint(messy).collect()
    assert len(rows) == len(docs)
    order = sorted(docs, key=lambda d: (-d[0] if d[0] is not None else 1 << 62, d[1]))
    want = sorted((i if i is not None else -1, len(t), hashlib.sha256(ee.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_chars, r.edited_sha256) for r in rows) == want
    by_text = {}
    prints = {r.doc_id: r.fingerprint for r in rows if r.doc_id is not None}
    for i, t in docs:
        if i is not None:
            by_text.setdefault(t, set()).add(prints[i])
    assert all(len(p) == 1 for p in by_text.values())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert ee.fingerprint(empty).collect() == []
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert ee.fingerprint(one).first().edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


def test_similar_pairs(spark):
    r = random.Random(6)
    base = words(r, 300)
    texts = {1: base, 2: base[:700] + base[702:], 3: base, 4: words(r, 300), 5: "", 6: "short", 7: "short"}
    prints = spark.createDataFrame([(i, p) for i, p in zip(texts, ee.digits(ee.fingerprints(list(texts.values()))), strict=True)] + [(None, "0"), (9, None)], "doc_id long, fingerprint string")
    got = {(x.query_id, x.doc_id) for x in ee.similar_pairs(prints, prints).collect()}
    assert got == {(a, b) for g in ({1, 2, 3}, {6, 7}) for a in g for b in g if a != b}


def brute_force(prints: list[str], queries: list[int], least: float) -> set[tuple[int, int]]:
    """All pairs (query, row) at least so like, from whole fingerprints."""
    n = max(-(-len(p) // ee.SAMPLES) * ee.SAMPLES for p in prints)
    rows = np.array([[int(c, 16) for c in p.ljust(n, "f")] for p in prints], np.uint8)
    return {(q, int(i)) for q in queries for i in np.flatnonzero(ee.likeness(rows[q : q + 1].repeat(len(rows), 0), rows) >= least) if i != q}


def test_recall_near_the_threshold(spark):
    r = random.Random(8)
    texts = []
    for n in (15, 40, 60, 120, 250, 500) * 12:
        base = words(r, n)
        texts.append(base)
        for share in range(1, 20):
            # edits spread over the text or gathered at a place, and lengths that straddle a doubling
            edited, low = list(base), r.choice([0, 0, len(base) // 2])
            for _ in range(max(1, len(base) * share // 250)):
                edited[r.randrange(low, len(edited))] = r.choice(["", "x", "kk", " y"])
            texts.append("".join(edited) + words(r, n)[: r.choice([0, 0, n // 4, n // 2])])
    prints = ee.digits(ee.fingerprints(texts))
    queries = list(range(0, len(texts), 20))
    want = brute_force(prints, queries, 0.8)
    close = want - brute_force(prints, queries, 0.88)
    rows = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")
    got = {(x.query_id, x.doc_id) for x in ee.similar_pairs(rows, rows.where("doc_id % 20 = 0")).collect()}
    assert len(close) > 50 and got <= want
    assert len(want - got) <= 0.01 * len(want) and len(close - got) <= 0.03 * len(close)


def test_recall_of_spread_disagreement(spark):
    r = random.Random(9)
    prints = []
    for octaves in (2, 3, 4, 6, 9) * 30:
        base = [r.choice("0123456789abcde") for _ in range(octaves * ee.SAMPLES - r.choice([0, 0, 12]))]
        prints.append("".join(base))
        for _ in range(19):
            # likenesses of some 0.78 to 0.88 in every doubling
            share = r.uniform(0.12, 0.22)
            prints.append("".join(r.choice("0123456789abcde") if r.random() < share else c for c in base))
    queries = list(range(0, len(prints), 20))
    want = brute_force(prints, queries, 0.8)
    rows = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")
    got = {(x.query_id, x.doc_id) for x in ee.similar_pairs(rows, rows.where("doc_id % 20 = 0")).collect()}
    print("RECALL", len(want), len(want - got))
    assert len(want) > 1000 and got <= want and len(want - got) <= 0.02 * len(want)


def test_registered_pairs(spark, sf_dir):
    from tidemark.llm.queries import QUERIES

    prints = QUERIES["op10_fingerprints"](spark, sf_dir).select("doc_id", "fingerprint").collect()
    ids = [x.doc_id for x in prints]
    want = {(ids[q], ids[i]) for q, i in brute_force([x.fingerprint for x in prints], [k for k, i in enumerate(ids) if i % 20 == 0], 0.8)}
    got = QUERIES["op10_similar_pairs"](spark, sf_dir).collect()
    assert want and len(got) == len({(x.query_id, x.doc_id) for x in got}) and {(x.query_id, x.doc_id) for x in got} == want
