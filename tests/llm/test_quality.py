"""Quality rules against a plain version."""

import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.quality import RULES, STOP_WORDS, Rule, judge_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(t: str | None, lang: str | None) -> tuple:
    """The counts and the verdict by loops."""
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    held = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if held[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    listed = {y for ws in STOP_WORDS.values() for x in ws for y in (x, x.capitalize())}
    stripped = [x.strip(" \t\n\x0b\x0c\r") for x in lines]
    n = {
        "n_words": len(w), "n_lines": len(lines), "word_chars": sum(map(len, w)), "n_symbols": sum(t.count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "n_stop_words": sum(x in listed for x in w), "n_echoed_words": sum(a == b for a, b in zip(w, w[1:])),
        "n_bullet_lines": sum(x[0] in "-*•‣●" for x in stripped), "n_cut_lines": sum(x.endswith(("...", "…")) for x in stripped),
    }
    base = n["n_words"] < 20 or 100 * n["n_repeat_words"] > 30 * n["n_words"]
    failed = [r.name for r in RULES if not (r.part == "n_stop_words" and lang not in (None, *STOP_WORDS)) and not ((r.least is None or 100 * n[r.part] >= r.least * n[r.whole]) and (r.most is None or 100 * n[r.part] <= r.most * n[r.whole]))]
    return (*n.values(), base, failed, not base and not failed)


COUNTS = ["n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_echoed_words", "n_bullet_lines", "n_cut_lines", "base_failed", "failed", "kept"]


def compare(spark, docs):
    rows = judge_quality(spark.createDataFrame([(i, t, g, "kept as it is") for i, (t, g) in enumerate(docs)], "doc_id long, text string, lang string, row string")).collect()
    assert {r.doc_id: tuple(r[c] for c in COUNTS) for r in rows} == {i: plain(t, g) for i, (t, g) in enumerate(docs)}
    assert all(r.row == "kept as it is" for r in rows)


def test_hard_texts(spark):
    passage = "The one passage of eight words stands here twice"
    docs = [
        (None, None), ("", "en"), (" \t\n\x0b\x0c\r", "en"), ("a " * 30, "en"), ("a b " * 8, "en"), ("one two\n" * 15, "en"), (f"{passage} and {passage} in the end of it all for this is text " + "of the most plain kind there is " * 2, "en"),
        ("\n".join(["- a line of the list"] * 3 + ["• other"] * 2 + ["The rest..."] * 4 + [" "]), "fr"), ("# * $ % & | < > " * 9, None), ("x\u0085y z \U0001f600\U0001f600 " * 12, "zh"),
        (" ".join(f"word{i}" for i in range(60_000)) + " of the end", "de"), ("no stop words " * 2 + " ".join(f"w{i}" for i in range(30)), "sv"), ("x" * 100_000, "es"),
    ]
    compare(spark, docs)


def test_random_texts(spark):
    @settings(max_examples=6, deadline=None, database=None)
    @given(st.lists(st.tuples(st.lists(st.sampled_from(["a", "b", "the", "...", "-", "##", "é", "\n", "\t"]), max_size=70).map(" ".join), st.sampled_from(["en", "sv", None])), min_size=20, max_size=60))
    def check(docs):
        compare(spark, docs)

    check()


def test_other_tables_of_thresholds(spark, messy, empty):
    text = "This is the text of a page that holds some thirty plain words, so that it is long enough for the base rule and for all of the others of the table too."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(r.failed, r.kept) for r in judge_quality(df, lang=None).collect()] == [([], True)]
    assert [(r.failed, r.kept) for r in judge_quality(df, rules=(Rule("long", "word_chars", "n_words", 900, None),), lang=None).collect()] == [(["long"], False)]
    assert [(r.failed, r.kept) for r in judge_quality(df, rules=(), lang=None).collect()] == [([], True)]
    again = judge_quality(judge_quality(df, lang=None), lang=None)
    assert len(set(again.columns)) == len(again.columns)
    assert judge_quality(messy).count() == messy.count() and judge_quality(empty).collect() == []


def test_one_projection_without_user_functions_or_shuffles(messy, capsys):
    judge_quality(messy.coalesce(1)).select("kept").explain()
    plan = capsys.readouterr().out
    assert not any(x in plan.split("Exchange")[0] for x in ("Python", "Arrow", "Pandas")) and plan.count("Exchange") <= 1
