"""The pipeline, stage by stage, over a small table."""

import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_mixing import targets
from tests.llm.test_near_dedup import brute, frequencies
from tidemark.llm.shared import saved


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(saved(stage(spark, seen[-1], sf_dir)))
        assert seen[-1].columns == columns and seen[-1].dtypes == docs.dtypes
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert ids[1] == ids[0]  # all are in known languages
    first: dict[str, int] = {}
    for r in sorted(seen[1].collect(), key=lambda r: r.doc_id):
        for line in r.text.split("\n"):
            first.setdefault(line.strip(" \t\r\x0b\x0c").lower(), r.doc_id)
    for r in seen[2].collect():
        assert all(len(x) < 10 or first[x.strip(" \t\r\x0b\x0c").lower()] == r.doc_id for x in r.text.split("\n"))
        assert r.n_chars == len(r.text)
    texts = {r.doc_id: r.text for r in seen[2].collect()}
    root, _ = brute(texts, frequencies(texts))
    assert len(ids[3]) == seen[3].count() and ids[3] == {k for k, r in root.items() if k == r}
    size = lambda d: {s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in d.collect() if r.source == s) for s in {r.source for r in d.select("source").collect()}}
    mixed = size(seen[4])
    assert all(abs(mixed.get(s, 0) - target) <= 1 for s, target in targets(size(seen[3])).items())
    words = lambda d: sum(len(r.text.split()) for r in d.select("text").collect())
    assert abs(words(seen[4]) / words(seen[3]) - 1.5) < 0.02
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.STAGES[-1][1](spark, seen[4], sf_dir).collect()
    assert sum(p.length for p in pieces) == sum(len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for r in seen[4].collect())


def test_messy_and_empty(spark, messy, empty, sf_dir):
    docs = messy
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
        assert docs.columns == messy.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    assert docs.count() == 0
