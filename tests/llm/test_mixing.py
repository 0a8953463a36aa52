"""The mixture against a plain water-filling."""

import re
from collections import defaultdict

from tidemark.llm.mixing import mix, mixed


def targets(sizes: dict, weights=(3, 1, 2)) -> dict:
    """Targets by repeated sharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        level = left / max(1, sum(w[s] for s in open_))
        full = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.discard(s)


def test_targets_and_takes(messy):
    docs = messy.collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += count(r.text)
    want = targets(sizes)
    rows, spans = mix(messy, block=16)
    rows = rows.collect()
    assert len(rows) == len(docs)
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mix(messy, block=16)[0].collect()), key=str)
    spans = spans.collect()
    assert sum(r.to_word - r.from_word for r in spans) == sum(taken.values())
    # any long stretch of the schedule has every source near its share
    by_slot = sorted((r.slot, r.source, r.to_word - r.from_word) for r in spans if r.source == "a")
    half = max(r.slot for r in spans) // 2
    assert abs(sum(n for s, _, n in by_slot if s < half) / max(1, taken["a"]) - 0.5) < 0.1


def test_mixed_reads_as_the_rows_say(messy):
    rows, _ = mix(messy, block=16)
    words = sum(r.taken for r in rows.collect())
    out = mixed(messy, block=16)
    assert out.columns == messy.columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in out.collect()) == words


def test_empty(empty):
    rows, spans = mix(empty)
    assert rows.collect() == [] and spans.collect() == []
