"""Repairs of conversations against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tidemark.llm.conversations import ENDS, NEVER, Auction, copies_arcs, repair_conversations, row_arcs
from tidemark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows: list[tuple]) -> tuple[int, str, list]:
    """Least cost, then least edits: Dijkstra's rule over (cost, edits), states being (rows done, what has come out)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    queue, done = [(0, "", 0, "", [])], set()
    while queue:
        cost, edits, i, place, out = heapq.heappop(queue)
        if (i, place) in done:
            continue
        done.add((i, place))
        if i == len(rows) and place in ("", "a"):
            return cost, edits, out
        ways = []
        if i < len(rows):
            role, text, fault = rows[i]
            more = 3 if fault == "truncated" else 0
            ways.append((4, "D", None, None, 1))
            if fault in (None, "truncated"):
                ways += [(more, "K", role[:1], (role, text), 1), *[(3 + more, "R", r[0], (r, text), 1) for r in ("user", "assistant")]]
        ways += [(3, "I", r[0], (r, ""), 0) for r in ("user", "assistant")]
        for price, letter, initial, made, moved in ways:
            if initial is None or (place, initial) in step:
                heapq.heappush(queue, (cost + price, edits + letter, i + moved, place if initial is None else step[place, initial], out + ([made] if made else [])))
    raise AssertionError


def plain(table: list[tuple]) -> dict:
    """Rows (conv_id, turn, role, text) to conv_id: result."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            damage = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            row = (turn, "user" if damage == 4 else role, "" if damage == 1 else re.sub("[.!?]", "", text) if damage == 2 else text)
            rows += [row] * (0 if damage == 0 else 2 if damage == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, faulty = set(), []
        for _, role, text in rows:
            found = WORD.findall(text)
            faulty.append((role, text, "blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else None))
            seen.add((role, text))
        cost, edits, made = cheapest(faulty)
        turns = {r[0] for r in rows} - {None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        count = lambda f: sum(x[2] == f for x in faulty)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, edits, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, `key` string, n int"


def compare(spark, table, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in table], SCHEMA).repartition(4)
    rows = repair_conversations(df, **options).collect()
    want = plain(table)
    assert len(rows) == len(want)
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows} == want


def conversations(r: random.Random, n: int, longest: int) -> list[tuple]:
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", "Fine. ", "Ünï.", None, "Yes.", "a.\nb.", "…"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "S", "unknown"]
    out = []
    for conv in range(n):
        for turn in range(r.randint(1, longest)):
            usual = ["user", "assistant"][turn % 2] if turn or r.random() < 0.7 else "system"
            out.append((conv, turn * r.choice([1, 1, 1, 2]) if r.random() < 0.95 else None, usual if r.random() < 0.7 else r.choice(roles), f"Turn {turn}." if r.random() < 0.6 else r.choice(texts)))
    return out


def test_short_conversations(spark):
    table = conversations(random.Random(1), 250, 9)
    table += [(None, 0, "user", "Hello."), (None, 1, "assistant", "Hi."), (None, None, None, None), (900, 5, "user", "x." * 100_000), (901, 1, "user", "Once."), (901, 1, "user", "Once."), (901, 2, "assistant", "Once."), (-3, -5, "user", "A."), (-3, 9, "assistant", "B.")]
    compare(spark, table)


def test_long_conversations_in_blocks(spark):
    r = random.Random(2)
    table = conversations(r, 12, 60)
    table += [(50, 7, "user", "The same row.")] * 90 + [(51, t, "assistant" if t % 3 else "user", "The same text." if t % 2 else "") for t in range(80)] + [(52, None, "user", f"{t}.") for t in range(30)]
    for piece in (3, 10, 256):
        compare(spark, table, piece=piece)


def test_all_rows_dropped_and_empty_table(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    compare(spark, [(gone, 0, "user", "Hello.")])
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_conversations(empty).collect() == []


@pytest.mark.parametrize("step", [1, 2, 8, 1000])
def test_auction_finds_shortest_paths_and_their_tight_arcs(step):
    r = random.Random(step)
    for _ in range(60):
        layers = [r.choice([row_arcs(r.choice("suax "), r.randint(0, 2)), copies_arcs(r.randint(1, 3))]) for _ in range(r.randint(1, 40))]
        exits = [r.choice([0, 3, 6, NEVER]) for _ in range(4)]
        exits[r.randint(0, 3)] = 0
        want = [(p, "") for p in exits]
        for arcs in reversed(layers):
            want = [min(((cost + want[t][0], label + want[t][1]) for t, cost, label in arcs[q] if want[t][0] < NEVER), default=(NEVER, "")) for q in range(4)]
        found = Auction(layers, exits, step)
        assert found.price[0] == [w[0] for w in want]
        assert ["".join(found.trace(q)[1]) if want[q][0] < NEVER else "" for q in range(4)] == [w[1] for w in want]
        assert all(found.price[i][q] <= cost + found.price[i + 1][t] for i, arcs in enumerate(layers) for q in range(4) for t, cost, _ in arcs[q])
    assert ENDS == (0, 6, 3, 0)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = QUERIES["op12_conversation_repair"](spark, sf_dir).collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in found} == plain(rows)
