"""Packing against the tokenizer itself."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm.packing import LINEAR, QUADRATIC, Encoder, pack, pack_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_gives_the_tokenizers_ids():
    coder, plain = Encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["", " ", "a  b\n\n c", "it's 'LL", "<|endoftext|> x", "é日本 \x1c\x85", "a" * 12_000, "1234 €", "\n "] + [f"a{chr(c)} {chr(c)}1{chr(c)}" for c in range(1, 0x3100, 3)]
    for t in texts:
        assert coder.encode(t) == np.asarray(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_pieces_cover_documents_and_sequences(messy):
    plain = Tokenizer.from_file(PATH)
    rows = pack_documents(messy, PATH, length=64).collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in messy.collect())
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        seq[r.sequence_id].append(r)
        by[r.doc_id].append(r)
    for s in seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64 and (at == 64 or at & (at - 1) == 0)
    unique = {d: ids for d, ids in want if sum(d == x for x, _ in want) == 1}
    for d, ids in unique.items():
        got = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(by[d], key=lambda r: r.start)])
        assert got.tolist() == ids and {r.doc_tokens for r in by[d]} == {len(ids)}
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in want)


def test_pack_takes_descending_documents_to_the_cheapest_sequence():
    placed, rest = pack([60, 50, 40, 30, 20], 100, True)
    assert not rest
    first = {i: q for i, _, _, q, _ in placed[:2]}
    assert first == {0: 0, 1: 1}  # the largest two open two sequences
    assert next(q for i, _, _, q, _ in placed if i == 2) == 1  # the third goes to the cheaper one with room


def plain_pack(lengths: list[int], room: int) -> list[list[tuple[int, int, int]]]:
    """The rule, step by step: the costliest piece left goes to the cheapest sequence with room for it, else fills the cheapest with any."""
    sequences = [[] for _ in range(sum(lengths) // room)]
    used = lambda s: sum(size for _, _, size in s)
    cost = lambda s: sum(LINEAR * size + QUADRATIC * size * size for _, _, size in s)
    left = [(i, 0, size) for i, size in enumerate(lengths) if size]
    while left:
        left.sort(key=lambda p: (-p[2], p[0], p[1]))
        i, start, size = left.pop(0)
        fits = [s for s in sequences if room - used(s) >= size] or [s for s in sequences if used(s) < room]
        if not fits:
            continue
        s = min(fits, key=cost)
        take = min(size, room - used(s))
        s.append((i, start, take))
        if take < size:
            left.append((i, start + take, size - take))
    return sequences


def test_pack_equals_the_plain_rule():
    r = random.Random(1)
    for _ in range(30):
        lengths = [r.choice([r.randint(0, 63), r.randint(1, 8), 17]) for _ in range(r.randint(0, 60))]
        placed, rest = pack(lengths, 64, False)
        want = [(i, start, size, q) for q, s in enumerate(plain_pack(lengths, 64)) for i, start, size in s]
        assert sorted(p[:4] for p in placed) == sorted(want)
        assert sum(p[2] for p in placed) + sum(x[2] for x in rest) == sum(lengths) and sum(x[2] for x in rest) < 64


def test_windows_close_by_tokens_and_long_texts_are_cut_once(spark, monkeypatch):
    import tidemark.llm.packing as packing

    monkeypatch.setattr(packing, "TOKENS", 500)
    docs = [(i, "word " * (50 * i)) for i in range(12)] + [(99, "long text of many words " * 20_000)]
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), PATH, length=64).collect()
    plain = Tokenizer.from_file(PATH)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for d, text in docs:
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(by[d], key=lambda r: r.start)]).tolist()
        assert ids == [*plain.encode(text, add_special_tokens=False).ids, 1]


def test_empty(empty):
    assert pack_documents(empty, PATH).collect() == []


def test_arrow_batches_of_long_texts_are_bounded_and_texts_come_whole(spark):
    from tidemark.llm.shared import PIECE, in_pieces, whole_texts

    texts = ["é日" * 300_000, None, "", "x" * PIECE, "y" * (PIECE + 1), *(f"{i} " + "word 日本 " * 400 for i in range(3000)), "z" * 3_000_000]
    docs = in_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) <= 10_000 * (PIECE + 40)
    assert {r.doc_id: r.text for r in docs.mapInArrow(whole_texts, "doc_id long, text string").collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_packing_gets_pieces_of_texts(messy):
    plan = pack_documents(messy, PATH)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(" in plan and "Filter" not in plan
