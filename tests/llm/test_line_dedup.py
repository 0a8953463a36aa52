"""Common lines against a plain version."""

from tidemark.llm.line_dedup import drop_common_lines


def plain(docs: list[tuple], least: int = 2) -> list[tuple]:
    """(id, text, lines, dropped) by loops."""
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held: dict[str, set] = {}
    for i, t in docs:
        for x in (t or "").split("\n") if i is not None else []:
            if len(key(x)) >= 10:
                held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in docs:
        x = (t or "").split("\n")
        kept = [y for y in x if i is None or len(key(y)) < 10 or len(held[key(y)]) < least or min(held[key(y)]) == i]
        out.append((i, "\n".join(kept), len(x), len(x) - len(kept)))
    return sorted(out, key=str)


LINES = ["This line is COMMON", " this line is common\t", "THIS LİNE is common", "É is not é here", "é is not é here", "short", "", "a line by itself", "Kelvin K is not k", "kelvin K is not k"]


def test_equals_plain_version(spark, messy, empty):
    docs = [(i, "\n".join(LINES[(i * 7 + k * 3) % len(LINES)] for k in range(i % 5 + 1))) for i in range(30)]
    docs += [(40, None), (41, ""), (42, "\n\n"), (43, "\n".join(LINES * 400)), (None, "This line is COMMON\nx"), docs[3], docs[3]]
    df = spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id long, text string, lines string, n_dropped int")
    for least in (2, 3):
        out = drop_common_lines(df, min_docs=least)
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=str) == plain(docs, least)
    assert drop_common_lines(messy).count() == messy.count()
    assert drop_common_lines(empty).collect() == []


def test_no_python_on_the_main_path(spark, messy, capsys):
    drop_common_lines(messy).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
