"""Language identification: held-out accuracy, and what each kind of evidence does."""

import math
import random
from collections import Counter

import tidemark.llm.language as model
from tidemark.llm.language import identify, identify_pages, only_accepted
from tidemark.llm.queries import QUERIES

VOCABULARY = {"en": "the and of to in that with for was from this which".split(), "fr": "le la les des est dans pour que avec sur une être".split(), "de": "der die und das ist nicht mit für auf eine über schön".split()}


def text(r: random.Random, lang: str, n: int) -> str:
    """n words of a language."""
    return " ".join(r.choice(VOCABULARY[lang]) for _ in range(n))


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    half = docs.selectExpr("doc_id", "text", "source", "case when doc_id % 2 = 0 then lang end as label")
    rows = identify(half, declared=None, label="label").where("doc_id % 2 = 1").collect()
    assert sum(r.lang == truth[r.doc_id] for r in rows) / len(rows) > 0.97


def test_evidence_decides_where_text_is_short(spark):
    r = random.Random(1)
    rows = [(i, text(r, lang, 40), lang, f"https://{lang}{i % 3}.site.{'com' if lang == 'en' else lang}/x") for i in range(90) for lang in [list(VOCABULARY)[i % 3]]]
    rows += [(1000, "ok", "de", None), (1001, "ok", None, "https://fr1.site.fr/a"), (1002, "ok", None, "https://new.other.de/"), (1003, "123 !!", "en", None), (1004, None, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, url string")
    got = {x.doc_id: x for x in identify(docs, url="url", host=None).collect()}
    assert all(got[i].lang == rows[i][2] and got[i].accepted for i in range(90))
    assert got[1000].lang == "de" and got[1001].lang == "fr" and got[1002].lang == "de"
    assert got[1003].lang is None and not got[1003].accepted and not got[1004].accepted
    wanted = identify(docs, url="url", host=None, wanted=["en"]).where("accepted").collect()
    assert {x.doc_id for x in wanted} == {i for i in range(90) if rows[i][2] == "en"}


def test_rare_languages_are_known_however_large_the_table(spark):
    r = random.Random(2)
    rows = [(i, text(r, "en", 12), "en", "a") for i in range(1500)] + [(2000 + i, text(r, "fr", 12), "fr", "a") for i in range(3)]
    rows += [(None, text(r, "de", 12), "de", "a") for _ in range(400)] + [(3000 + i, "123", "it", "a") for i in range(100)] + [(4000, "perché così", "it", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = identify(docs, sample=30).collect()
    assert len(got) == len(rows)
    for lang in ("en", "fr", "de"):
        own = [x for x in got if x.declared == lang]
        assert sum(x.lang == lang for x in own) > 0.99 * len(own), lang
    assert [x.lang for x in got if x.doc_id == 4000] == ["it"]


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = identify_pages(pages).collect()
    assert len(rows) == pages.count() and sum(r.lang == r.declared for r in rows) / len(rows) > 0.95


def test_messy(messy, empty):
    out = only_accepted(messy)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == messy.columns and not {60, 61, 62, 63} & set(ids) and ids.count(0) == 3 and 70 in ids
    assert identify(empty).collect() == [] and only_accepted(empty).collect() == []


def plain_posteriors(rows: list[dict]) -> list[tuple[str | None, float]]:
    """(language, posterior) of rows (text, declared, suffix, host, label) by counting one by one."""
    def grams(text: str) -> list[bytes]:
        raw = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in f" {text.lower()} ".encode())
        return [raw[i : i + 3] for i in range(len(raw) - 2) if raw[i + 1] != 32]

    cell = lambda g: (int.from_bytes(g, "big") * 2654435769 % (1 << 32)) >> 16
    names = sorted({r["label"] for r in rows if r["label"] and grams(r["text"])})
    table = {n: Counter(cell(g) for r in rows if r["label"] == n for g in grams(r["text"])) for n in names}
    size = {n: sum(c.values()) + model.SMOOTH * model.SIZE for n, c in table.items()}
    texts = []
    for r in rows:
        g = grams(r["text"])
        logs = [sum(math.log((table[n][cell(x)] + model.SMOOTH) / size[n]) for x in g) * min(len(g), model.EVIDENCE) / len(g) for n in names] if g else None
        texts.append(logs)
    best = [max(range(len(names)), key=lambda i: (t[i], -i)) if t else None for t in texts]
    tally = lambda key: {v: [sum(b == i for b, r in zip(best, rows, strict=True) if r[key] == v) for i in range(len(names))] for v in {r[key] for r in rows if r[key] is not None}}
    whole = [best.count(i) for i in range(len(names))]
    prior = [(n + 1) / (sum(whole) + len(names)) for n in whole]
    declared, suffix, host = tally("declared"), tally("suffix"), tally("host")
    site = lambda h: ".".join(h.split(".")[-2:])
    sites = {}
    for h, n in host.items():
        sites[site(h)] = [a + b for a, b in zip(sites.get(site(h), [0] * len(names)), n, strict=True)]
    out = []
    for r, t in zip(rows, texts, strict=True):
        if t is None:
            out.append((None, 0.0))
            continue
        total = list(t)
        for i, n in enumerate(names):
            if r["declared"] is not None:
                total[i] += math.log((declared[r["declared"]][i] + (model.TRUST if r["declared"] == n else 0.1)) / (whole[i] + model.TRUST + 0.1 * len(names)))
            if r["suffix"] is not None:
                total[i] += math.log((suffix[r["suffix"]][i] + model.TRUST * prior[i]) / (whole[i] + model.TRUST))
            if r["host"] is None:
                total[i] += math.log(prior[i])
            else:
                m, h = sites[site(r["host"])], host[r["host"]]
                above = (m[i] + model.LEVEL * prior[i]) / (sum(m) + model.LEVEL)
                total[i] += math.log((h[i] + model.LEVEL * above) / (sum(h) + model.LEVEL))
        top = max(total)
        out.append((names[total.index(top)], 1 / sum(math.exp(x - top) for x in total)))
    return out


def test_documents_equal_the_plain_posterior(spark, sf_dir):
    docs = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = plain_posteriors([{"text": r.text or "", "declared": r.lang, "suffix": None, "host": r.source, "label": r.lang} for r in docs])
    got = {r.doc_id: (r.lang, r.posterior) for r in QUERIES["op9_language_id"](spark, sf_dir).collect()}
    assert all(got[r.doc_id][0] == w[0] and abs(got[r.doc_id][1] - w[1]) < 1e-4 for r, w in zip(docs, want, strict=True))


def test_addresses_equal_the_plain_posterior(spark):
    r = random.Random(2)
    words = {"en": "the and of house tree running".split(), "fr": "le et la maison arbre courant".split(), "de": "der und das haus baum laufend".split()}
    rows = []
    for i in range(150):
        n = r.choice(list(words))
        text = " ".join(r.choice(words[n if r.random() < 0.8 else "en"]) for _ in range(r.randint(0, 12)))
        host = f"{r.choice('ab')}.{r.choice(['news', 'blog'])}.{ {'en': 'com', 'fr': 'fr', 'de': 'de'}[n] if r.random() < 0.7 else 'org'}"
        rows.append({"id": i, "text": text, "declared": r.choice([n, None, "en"]), "suffix": host.split(".")[-1], "host": host, "label": r.choice([n, None])})
    want = plain_posteriors(rows)
    table = spark.createDataFrame([(x["id"], x["text"], x["declared"], f"https://{x['host']}/p", x["label"]) for x in rows], "doc_id long, text string, lang string, url string, label string")
    got = {x.doc_id: (x.lang, x.posterior) for x in identify(table, url="url", host=None, label="label").collect()}
    assert all(got[x["id"]][0] == w[0] and abs(got[x["id"]][1] - w[1]) < 1e-4 for x, w in zip(rows, want, strict=True))


def test_very_long_text_and_references(spark):
    long = "the tree and the house of the running " * 60_000
    table = spark.createDataFrame([(i, t, "en" if i < 3 else None) for i, t in enumerate([long, long[:500], "the tree", "the house and the tree", "12 34 !"])], "doc_id long, text string, lang string").selectExpr("*", "cast(null as string) source")
    got = {x.doc_id: x.lang for x in identify(table).collect()}
    assert got == {0: "en", 1: "en", 2: "en", 3: "en", 4: None}
    pages = spark.createDataFrame([(1, "http://a.fr/", "<p>&eacute;t&eacute;</p>"), (2, "http://a.fr/", "<html lang=fr><p>le pain et la maison</p>")], "page_id long, url string, html string")
    assert {x.page_id: x.lang for x in identify_pages(pages).collect()} == {1: "fr", 2: "fr"}
