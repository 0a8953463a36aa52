"""Near duplicates against all pairs."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

import tidemark.llm.shingles as sh
from tests.llm.conftest import words
from tidemark.llm import near_dedup as nd
from tidemark.llm.shared import components
from tidemark.llm.shingles import shingled


def brute(texts: dict[int, str], table, similar: float = 0.8) -> tuple[dict[int, int], set[tuple[int, int]]]:
    """(classes, links) by comparing all pairs of shingle lists, shingles being made word by word."""
    known: dict[tuple, int] = {}
    docs = {}
    for k, t in texts.items():
        w = t.lower().split() or [""]
        count = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
        docs[k] = {known.setdefault(s, len(known)): n for s, n in count.items()}
    weight = lambda s, n: n * (1 + nd.IDF * table.get(s, 1.0))
    table = {known[s]: idf for s, idf in table.items() if s in known}
    docs = {k: {s: weight(s, n) for s, n in d.items()} for k, d in docs.items()}
    root, links = {k: k for k in texts}, set()
    for a in texts:
        for b in texts:
            if a < b:
                common = sum(min(w, docs[b].get(s, 0)) for s, w in docs[a].items())
                if common / (sum(docs[a].values()) + sum(docs[b].values()) - common) >= similar:
                    links.add((a, b))
                    ra, rb = root[a], root[b]
                    root = {k: min(ra, rb) if r in (ra, rb) else r for k, r in root.items()}
    return root, links


def frequencies(texts: dict[int, str], common: float = nd.COMMON) -> dict[tuple, float]:
    """idf of shingles that a share of documents holds, by counting them word by word."""
    df = Counter(s for t in texts.values() for w in [t.lower().split() or [""]] for s in {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return {s: np.log(len(texts) / n) / np.log(1 / common) for s, n in df.items() if n >= common * len(texts)}


def test_classes_equal_all_pairs(spark):
    r = random.Random(5)
    texts, n = {}, 0
    for g in range(12):
        base = words(r, 90).split()
        for copy in range(r.randint(1, 14)):
            t = list(base)
            for _ in range(0 if copy == 0 else r.randint(0, 3)):
                t[r.randrange(len(t))] = f"new{r.random()}"
            if r.random() < 0.2:
                t = t[: r.randint(60, 90)]
            texts[n] = " ".join(t)
            n += 1
        if g % 3 == 0:
            texts[n] = " ".join(base)
            n += 1
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()}
    want, links = brute(texts, frequencies(texts))
    assert len(links) > 60 and sum(got[a] == got[b] for a, b in links) >= 0.99 * len(links)
    assert all(want[a] == want[b] for a, b in got.items())


def test_hot_group_of_copies_loses_no_link(spark):
    """Copies edited so much that half aren't similar to the original, copies cut at either end, and a variant with a long passage of its own."""
    r = random.Random(11)
    base, more = words(r, 120).split(), words(r, 60).split()
    texts = {}
    for n in range(420):
        t = list(base) + (more if n % 7 == 0 else [])
        if n % 5 == 1:
            t = t[: r.randint(50, 110)] if n % 2 else t[r.randint(10, 70) :]
        for _ in range(r.randint(0, 9)):
            t[r.randrange(len(t))] = r.choice(base[:20])
        texts[n] = " ".join(t)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()}
    want, links = brute(texts, frequencies(texts))
    assert all(want[a] == want[b] for a, b in got.items())
    assert sum(got[a] == got[b] for a, b in links) >= 0.999 * len(links)
    assert sum(got[k] == want[k] for k in texts) >= 0.97 * len(texts), [(k, got[k], want[k]) for k in texts if got[k] != want[k]][:10]


def test_ids_may_be_strings(spark):
    r = random.Random(12)
    base, other = words(r, 90), words(r, 90)
    rows = [("b", base), ("a", base + " more"), ("c", base.replace(base.split()[45], "new")), ("z", other), ("y", other), ("k", "alone")]
    got = {x.doc_id: x.class_id for x in nd.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "z": "y", "y": "y", "k": "k"}


def test_shingles_of_words(spark):
    texts = ["a b c d e f g", "", None, " \n", "a b", "x a b c d e f g", "A  b\tc\nd e f g ", "b c d e f g", "é è ü\xa0x y", "a a a a a a a"]
    a = [dict(zip(h.tolist(), n.tolist(), strict=True)) for h, n in shingled(pa.array([t and t.lower() for t in texts]))]
    assert [sum(x.values()) for x in a] == [3, 1, 1, 1, 1, 4, 3, 2, 1, 3] and len(a[9]) == 1
    assert a[0] == a[6] and a[1] == a[2] == a[3] and set(a[7]) < set(a[0]) < set(a[5]) and not set(a[8]) & set(a[0])
    many = [" ".join(str(i * j % 97) for j in range(50)) for i in range(300)]
    whole = list(shingled(pa.array(many)))
    old, sh.SLICE = sh.SLICE, 400
    try:
        cut = list(shingled(pa.array(many).slice(10, 100)))
    finally:
        sh.SLICE = old
    assert all((x[0] == y[0]).all() and (x[1] == y[1]).all() for x, y in zip(whole[10:110], cut, strict=True))


def test_samples_agree_as_often_as_weighted_jaccard_says():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    wa, wb = rng.uniform(1, 3, 400), rng.uniform(1, 3, 400)
    wa[:60] = 0
    a, b = (h[wa > 0], wa[wa > 0]), (h, wb)
    common, _, _ = nd.overlap((np.sort(a[0]), a[1][np.argsort(a[0])]), (np.sort(b[0]), b[1][np.argsort(b[0])]))
    j = common / (wa.sum() + wb.sum() - common)
    sampler = nd.Sampler(3000)
    old, nd.ROWS = nd.ROWS, 1
    try:
        same = float((sampler.keys(*a) == sampler.keys(*b)).mean())
    finally:
        nd.ROWS = old
    assert abs(same - j) < 0.03


def test_common_shingles_are_counted(spark):
    docs = spark.createDataFrame([(i, "very common words stand here and " + (f"own{i} " * 5 if i % 2 else "")) for i in range(60)], "doc_id long, text string")
    for window in (nd.WINDOW, 20):
        hashes, idf = nd.common_shingles(docs, docs["text"], common=0.4, window=window)
        assert len(hashes) == 2 and (idf == 0).all()


def test_what_is_frequent_is_never_lost():
    rng = np.random.default_rng(6)
    for window in (50, 400, 10_000):
        found, true = nd.Frequent(0.05, window), Counter()
        for i in range(600):
            h = np.unique(np.concatenate([rng.integers(0, 40, rng.integers(0, 6)), rng.integers(100, 10**9, 20), [10**10] * (i > 560), [10**10 + 1] * (i < 40)]).astype(np.uint64))
            true.update(h.tolist())
            found.add(h)
        found.close()
        got = dict(zip(found.h.tolist(), found.n.tolist(), strict=True))
        assert all(got.get(h, 0) >= n - 0.025 * 600 for h, n in true.items() if n >= 0.05 * 600) and all(n <= true[h] for h, n in got.items())
        assert len(got) < 200 or window == 10_000


def test_messy(messy, empty):
    rows = nd.near_duplicates(messy).collect()
    assert len(rows) == messy.count()
    got = {r.doc_id: r.class_id for r in rows}
    assert got[51] == got[52] == 50 and got[60] == got[61] == got[62] == 60 and got[None] is None
    out = nd.one_of_each(messy)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == messy.columns and ids.count(0) == 1 and ids.count(None) == 2 and 50 in ids and not {51, 52, 61} & set(ids)
    assert nd.near_duplicates(empty).collect() == [] and nd.one_of_each(empty).collect() == []


def test_a_repeated_id_loses_no_text(spark):
    r = random.Random(21)
    x, y, z = (words(r, 80) for _ in range(3))
    df = spark.createDataFrame([(3, y), (5, x), (5, y), (8, z)], "doc_id long, text string")
    assert sorted((a.doc_id, a.class_id) for a in nd.near_duplicates(df).collect()) == [(3, 3), (5, 3), (5, 5), (8, 8)]
    assert sorted((a.doc_id, a.text) for a in nd.one_of_each(df).collect()) == sorted([(3, y), (5, x), (8, z)])


def test_repeated_ids_against_all_pairs(spark):
    """Many texts under few ids: every class of texts keeps one, links between texts are those of all pairs."""
    r = random.Random(22)
    rows = []
    for _ in range(25):
        base = words(r, 80).split()
        for _ in range(r.randint(1, 6)):
            t = list(base)
            for _ in range(r.randint(0, 2)):
                t[r.randrange(len(t))] = f"new{r.random()}"
            rows += [(r.randint(1, 30), " ".join(t))] * r.randint(1, 2)
    texts = sorted({t for _, t in rows}, key=lambda t: min(i for i, u in rows if u == t))
    numbered = dict(enumerate(texts))
    want, _ = brute(numbered, frequencies({i: t for i, (_, t) in enumerate(rows)}))
    root = {texts[k]: v for k, v in want.items()}
    first = {v: min(i for i, t in rows if root[t] == v) for v in root.values()}
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string").repartition(4)
    found = Counter((a.doc_id, a.class_id) for a in nd.near_duplicates(df).collect())
    assert found == Counter((i, first[root[t]]) for i, t in rows)
    kept = [(a.doc_id, a.text) for a in nd.one_of_each(df).collect()]
    assert len(kept) == len(first) and {(root[t], i) for i, t in kept} == set(first.items())


def test_lists_name_each_pair_about_once(spark):
    """Nodes that share passages of many shingles over their leader: a list for each passage, and of two nodes' lists only the first, shortest ones make a pair."""
    rows = []
    for b in range(40):
        for passage in {b % 4, 4 + b % 5}:
            rows += [(0, b, 200.0, 140.0, b, True, 1000 * passage + i, 1.0) for i in range(20)]
    posts = spark.createDataFrame(rows, "a long, b long, size double, common double, c long, away boolean, s long, w double")
    want = lambda x, y: 0.8 / 1.8 * (x + y) - 1e-9
    lists = nd.narrowed(posts, want)
    assert lists.count() == 80 and {r.over for r in lists.collect()} == {40.0} and nd.narrowed(lists, want).count() == 80
    kept = nd.rarest(lists).collect()
    # 178 less 140 are needed, so both passages must be shared: the shorter list finds each such pair, and no other
    assert {(r.b, r.over) for r in kept} == {(b, 40.0) for b in range(40)} and len(kept) == 40


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (105, 101), (105, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in (100, 101, 105)}
