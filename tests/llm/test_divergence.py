"""The audit of sources against a plain version."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import divergence
from tidemark.llm.divergence import audit_sources, share, skyband

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs: list[tuple], min_docs: int, top: int) -> set[tuple]:
    """All rows by loops, documents being (text, lang, source)."""
    docs = [tuple(x or "" for x in d) for d in docs]
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    words = [(g, s, TERM.findall(low(t))) for t, g, s in docs]
    out = set()
    for lang in {g for _, g, _ in docs}:
        held = Counter(t for g, _, w in words if g == lang for t in set(w))
        kept = sorted(t for t, n in held.items() if n >= min_docs)
        counts = defaultdict(Counter)
        for g, s, w in words:
            if g == lang:
                counts[s].update(t for t in w if t in set(kept))
        whole = sum(counts.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        q = p(whole)
        for s, c in counts.items():
            own = p(c)
            pairs = [(sum(abs(own[t] - x) for t, x in p(other).items()), o) for o, other in counts.items() if o != s]
            terms = [(own[t] - q[t], t) for t in kept if c[t] and own[t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < top}
    return out


def compare(spark, docs, min_docs=3, top=4):
    df = spark.createDataFrame([(i, *d, "x", 1) for i, d in enumerate(docs)], "doc_id long, text string, lang string, source string, term string, n int").repartition(5)
    rows = audit_sources(df, min_docs=min_docs, top=top).collect()
    got = [(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in rows]
    assert len(set(got)) == len(got) and set(got) == plain(docs, min_docs, top)


def test_equals_plain_version(spark):
    r = random.Random(5)
    words = ["the", "The", "tide", "É", "é", "a1b", "word", "straße", "\U0001f600x", "zz", "ab\u0085", "x_y", "ſ", "K"] + [f"w{chr(97 + i)}" for i in range(20)]
    docs = [(" ".join(r.choices(words, weights=[1 + (j * (i % 5 + 1)) % 7 for j in range(len(words))], k=r.randint(0, 30))), r.choice(["en", "de", None]), r.choice(["a", "b", "c", "", None, "é", "\U0001f600"])) for i in range(120)]
    docs += [(None, "en", "silent"), (None, "nothing", "x"), ("", "nothing", "y"), ("one two", "nothing", "y"), (None, None, None), docs[0], docs[0], ("tide " * 50_000, "en", "a")]
    compare(spark, docs)


def test_tiles_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 4)
    monkeypatch.setattr(divergence, "BUCKET", 8)
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "CHUNK", 8)
    r = random.Random(6)
    docs = [(" ".join(r.choices([f"w{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(6)], k=25)), "en", f"s{r.randint(0, 17)}") for _ in range(150)]
    compare(spark, docs)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_skyband(k):
    r = np.random.default_rng(k)
    rows = pd.DataFrame({"n": r.integers(1, 30, 1500), "total": r.integers(30, 90, 1500), "term": [f"{x:04d}é" for x in r.permutation(1500)]})
    n, total, term = rows["n"].to_numpy(), rows["total"].to_numpy(), rows["term"].rank().to_numpy()
    over = [((n >= n[i]) & (total <= total[i]) & (term <= term[i])).sum() - 1 for i in range(len(rows))]
    assert set(skyband(rows, k)["term"]) == {t for t, m in zip(rows["term"], over) if m < k}


def test_large_numbers_stay_exact(spark):
    from pyspark.sql import functions as F

    n, total, kept = 3 * 10**15, 9 * 10**15 + 7, 10**6 + 3
    row = spark.range(1).select(share(F.lit(n), F.lit(total), F.lit(kept), 5, 10**9).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (total + 5 * kept)


def test_messy_rows(spark, messy, empty):
    docs = [(r.text, r.lang, r.source) for r in messy.collect()]
    rows = audit_sources(messy, min_docs=2, top=50).collect()
    assert {(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in rows} == plain(docs, 2, 50)
    assert audit_sources(empty).collect() == []
