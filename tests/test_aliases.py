"""Aliases found by the automaton against the rule applied alias by alias."""

import random
import re

from tidemark.functions.aliases import Entry, Matcher
from tidemark.functions.symbols import NOISE, companies
from tidemark.operators import news


def plain(dictionary, noise, title, body):
    """(symbol, mentions, relevance) by looking for each alias in what the longer ones have left."""
    parts = [title, body]
    for term in noise:
        parts = [p.replace(term, " ") for p in parts]
    found = {}
    for alias, e in sorted(((a, e) for e in dictionary for a in e.aliases), key=lambda x: -len(x[0])):
        whole = re.compile(rf"(?<![A-Za-z0-9]){re.escape(alias)}(?![A-Za-z0-9])", re.I) if re.fullmatch(r"[\x20-\x7e]+", alias) else None
        counts = [len(whole.findall(p)) if whole else p.count(alias) for p in parts]
        if any(counts):
            parts = [p.replace(alias, " ") if n else p for p, n in zip(parts, counts)]
            had = found.setdefault(e.symbol, [0, 0])
            had[0] += sum(counts)
            had[1] = max(had[1], min(100, (72 if counts[0] else 40) + min(sum(counts) * 6, 28)))
    return sorted(((s, *v) for s, v in found.items()), key=lambda x: (-x[2], -x[1]))[:8]


def compare(dictionary, noise, texts):
    m = Matcher(dictionary, noise)
    for title, body in texts:
        assert [(x["symbol"], x["mentions"], x["relevance"]) for x in m.matches(title, body, 8)] == plain(dictionary, noise, title, body), (title, body)


def test_random_texts_over_few_letters():
    r = random.Random(1)
    for _ in range(60):
        alias = lambda: "".join(r.choice("abA 한é") for _ in range(r.randint(1, 4))).strip() or "a"
        dictionary = [Entry(f"S{i}", "n", "m", "s", tuple(alias() for _ in range(r.randint(1, 3)))) for i in range(r.randint(1, 7))]
        text = lambda: "".join(r.choice("aabbAB  한é.") for _ in range(r.randint(0, 40)))
        compare(dictionary, [alias()] if r.random() < 0.5 else [], [(text(), text()) for _ in range(40)])


def test_default_dictionary():
    r = random.Random(2)
    entries = companies()
    assert len(entries) == len({(e.symbol, e.name) for e in entries}) and all(e.aliases and e.market in ("KR", "US") for e in entries)
    pieces = [a for e in entries for a in e.aliases] + NOISE + [" ", " ", ".", "의", "a", "X", "Arm", "Holdings", "Kakao"]
    compare(entries, NOISE, [("".join(r.choices(pieces, k=r.randint(0, 6))), "".join(r.choices(pieces, k=r.randint(0, 25))).swapcase() if r.random() < 0.2 else "".join(r.choices(pieces, k=r.randint(0, 25)))) for _ in range(3000)])


def test_letters_beyond_ascii_and_formed_aliases():
    entries = [Entry("A", "a", "m", "s", ("Intel", "Arm Holdings")), Entry("B", "b", "m", "s", ("Meta Platforms", "SKT", "KB금융"))]
    compare(entries, ["noise"], [("İntel ıntel INTEL", "ſKT KB금융 skt"), ("ArmMeta PlatformsHoldings Meta Platforms", "Meta Platforms"), ("ArmnoiseHoldings", "ßİ Intel"), ("", "")])
    assert Matcher([]).matches("Intel", "x", 8) == []


def test_default_dictionary_in_spark(spark):
    df = spark.createDataFrame([(1, "카카오뱅크, 카카오톡 제휴", "SK이노베이션과 arm holdings"), (2, None, "alarm"), (3, None, None)], "article_id long, title string, body string")
    got = {x.article_id: [(m.symbol, m.mentions, m.relevance) for m in x.matches] for x in news.match_symbols(df).collect()}
    assert got == {1: [("323410", 1, 78), ("ARM", 1, 46), ("034730", 1, 46)], 2: [], 3: []}
    q = spark.createDataFrame([("네이버",), ("nvidia ",), ("035720",), ("none",)], "query string")
    assert {x.query: x.symbol for x in news.lookup_symbol(q, news.symbol_table(spark)).collect()} == {"네이버": "035420", "nvidia ": "NVDA", "035720": "035720", "none": None}
