"""Valuation scenarios from assumptions; what can't be valued says why instead of failing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import finite

RAW = ["price", "eps", "book_value_per_share", "ebitda", "cash", "debt", "shares"]
ASSUMED = ["target_pe", "target_pb", "target_ev_ebitda", "fcff", "growth_pct", "discount_pct", "terminal_growth_pct"]


def valuation_inputs(snapshot: DataFrame) -> DataFrame:
    """A snapshot's inputs by symbol; those in the statements' currency are null unless it is the price's."""
    same = F.col("currency") == F.col("financial_currency")
    return snapshot.select("symbol", "price", *[F.when(same, F.col(c)).alias(c) for c in RAW[1:]])


def valuation(inputs: DataFrame, assumptions: DataFrame) -> DataFrame:
    """(symbol, method, value, upside_pct, reason, error) for each method that the assumptions (by symbol) ask for: pe, pb, ev_ebitda, dcf.

    A value that isn't above zero or a missing base gives null and a reason; assumptions or inputs outside their limits give an error for all of a symbol's methods.
    """
    x = inputs.join(assumptions, "symbol")
    bad = F.lit(None).cast("string")
    for c in RAW[1:]:
        bad = F.when(F.col(c).isNotNull() & (finite(F.col(c)).isNull() | (F.abs(F.col(c)) > 1e18)), c).otherwise(bad)
    for c in ASSUMED:
        v = F.col(c)
        low, high = (0, 1000) if c.startswith("target_") else (-100, 100) if c.endswith("growth_pct") else (0, 100) if c == "discount_pct" else (0, 1e18)
        bad = F.when(v.isNotNull() & (finite(v).isNull() | (v <= low) | (v > high)), c).otherwise(bad)
    whole = F.col("fcff").isNotNull() & F.col("growth_pct").isNotNull() & F.col("discount_pct").isNotNull() & F.col("terminal_growth_pct").isNotNull()
    some = F.coalesce("fcff", "growth_pct", "discount_pct", "terminal_growth_pct").isNotNull()
    bad = F.when(finite(F.col("price")).isNull() | (F.col("price") <= 0), "price").when(bad.isNotNull(), bad).when(whole & (F.col("discount_pct") <= F.col("terminal_growth_pct")), "discount_pct")
    capital = (F.col("cash") >= 0) & (F.col("debt") >= 0) & (F.col("shares") > 0)
    g, d, t = F.col("growth_pct") / 100, F.col("discount_pct") / 100, F.col("terminal_growth_pct") / 100
    flow = lambda y: F.col("fcff") * F.pow(1 + g, F.lit(y)) / F.pow(1 + d, F.lit(y))
    worth = sum((flow(y) for y in range(2, 6)), flow(1)) + F.when(d > t, flow(5) * (1 + t) / (d - t))
    methods = [
        ("pe", F.col("target_pe").isNotNull(), F.when(F.col("eps") > 0, F.col("eps") * F.col("target_pe"))),
        ("pb", F.col("target_pb").isNotNull(), F.when(F.col("book_value_per_share") > 0, F.col("book_value_per_share") * F.col("target_pb"))),
        ("ev_ebitda", F.col("target_ev_ebitda").isNotNull(), F.when(capital & (F.col("ebitda") > 0), (F.col("ebitda") * F.col("target_ev_ebitda") + F.col("cash") - F.col("debt")) / F.col("shares"))),
        ("dcf", some, F.when(capital & whole, (worth + F.col("cash") - F.col("debt")) / F.col("shares"))),
    ]
    each = F.filter(F.array(*[F.struct(F.lit(n).alias("method"), asked.alias("asked"), value.alias("v")) for n, asked, value in methods]), lambda m: m["asked"])
    x = x.withColumn("error", bad).select("symbol", "price", "error", F.inline(each))
    value = F.when(F.col("error").isNull() & (finite(F.col("v")) > 0), F.col("v"))
    reason = F.when(F.col("error").isNotNull(), F.lit("")).when(F.col("v").isNull(), "missing or not above zero").when(value.isNull(), "value not above zero").otherwise(F.lit(""))
    return x.select("symbol", "method", value.alias("value"), ((value / F.col("price") - 1) * 100).alias("upside_pct"), reason.alias("reason"), F.when(F.col("error").isNotNull(), F.concat(F.lit("invalid "), "error")).alias("error"))
