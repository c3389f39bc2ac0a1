"""Event study: what happened after each signal, against an arbitrary long entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from barloom.operators.indicators import by_symbol, frame

RELIABLE_SIGNALS = 20


def forward_columns(horizons: tuple[int, ...], close: str = "close") -> dict[str, Column]:
    """Per horizon: exit close and the lowest low / highest high on the way."""
    w = by_symbol()
    out: dict[str, Column] = {}
    for h in horizons:
        out[f"exit_{h}"] = F.lead(close, h).over(w)
        out[f"low_{h}"] = F.min("low").over(frame(1, h))
        out[f"high_{h}"] = F.max("high").over(frame(1, h))
    return out


def outcome(horizon: int, direction: Column, cost_bps: float, entry: Column | None = None) -> Column:
    """Struct of gross, net, adverse and favourable percent moves; NULL without an exit bar."""
    price = entry if entry is not None else F.col("close")
    exit_close, low, high = (F.col(f"{n}_{horizon}") for n in ("exit", "low", "high"))
    gross = (F.try_divide(exit_close, price) - 1) * 100 * direction

    def move(p: Column) -> Column:
        return (F.try_divide(p, price) - 1) * 100 * direction

    long = direction > 0
    adverse = F.when(long, move(low)).otherwise(move(high))
    favourable = F.when(long, move(high)).otherwise(move(low))
    value = F.struct(
        F.round(gross, 3).alias("return_pct"),
        F.round(gross - cost_bps / 100, 3).alias("return_pct_net"),
        F.round(adverse, 3).alias("max_drawdown_pct"),
        F.round(favourable, 3).alias("max_favourable_pct"),
    )
    return F.when(exit_close.isNotNull() & (price != 0), value)


def apply_cooldown(signals: DataFrame, cooldown: int, index: str = "rn", key: str = "symbol", counts: Column | None = None, also: Column | None = None) -> DataFrame:
    """Greedy selection per symbol: a signal counts when at least ``cooldown`` bars after the last kept one.

    Rows where ``counts`` holds (all by default) are signals; the fold sees their
    bar numbers only. Rows where ``also`` holds come out whatever the fold says.
    With either given, ``is_signal`` tells the kept signals.
    """
    counts = counts if counts is not None else F.lit(True)
    kept_too = also if also is not None else F.lit(False)
    payload = [c for c in signals.columns if c != key]
    marked = signals.withColumns({"_counts": F.coalesce(counts, F.lit(False)), "_also": F.coalesce(kept_too, F.lit(False))})
    grouped = marked.groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(F.col("_counts"), F.col(index).cast("long")))).alias("_k"),
        F.collect_list(F.struct("_counts", "_also", F.col(index).cast("long").alias("_i"), F.struct(*payload).alias("_v"))).alias("_rows"),
    )
    start = F.struct(F.lit(-(2**31)).cast("long").alias("last"), F.expr("cast(array() as array<bigint>)").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x - acc["last"] >= cooldown
        return F.struct(
            F.when(fresh, x).otherwise(acc["last"]).alias("last"),
            F.when(fresh, F.array_append(acc["kept"], x)).otherwise(acc["kept"]).alias("kept"),
        )

    chosen = grouped.select(key, "_rows", F.aggregate("_k", start, step)["kept"].alias("_kept"))
    told = F.transform(
        "_rows", lambda r: F.struct((r["_counts"] & F.array_contains(F.col("_kept"), r["_i"])).alias("s"), r["_also"].alias("a"), r["_v"].alias("v"))
    )
    rows = chosen.select(key, F.explode(F.filter(told, lambda r: r["s"] | r["a"])).alias("_x"))
    flag = [] if also is None else [F.col("_x.s").alias("is_signal")]
    return rows.select(key, *[F.col("_x.v")[c].alias(c) for c in payload], *flag)


def is_baseline_bar(start: int, longest: int, step: int) -> Column:
    """Every ``step``-th bar from ``start`` that still has a full holding period (0-based)."""
    index = F.col("rn") - 1
    return (index >= start) & (index < F.col("bar_count") - longest) & ((index - start) % max(1, step) == 0)


def summarize(outcomes: DataFrame, groupings: list[list[str]]) -> DataFrame:
    """Statistics per horizon for each grouping, in one pass.

    ``outcomes``: group columns, ``horizon``, ``return_pct_net``,
    ``max_drawdown_pct``. Values are first counted per (groups, horizon, net
    return): returns carry three decimals, so the rows that reach a group's
    final task - and the exact median's buffer - are bounded by the number of
    distinct returns, however many signals a pattern or market has.
    """
    groups = sorted({c for g in groupings for c in g})
    counted = outcomes.groupBy(*groups, "horizon", "return_pct_net").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("max_drawdown_pct").alias("dd_sum"),
        F.min("max_drawdown_pct").alias("dd_min"),
    )
    # (grouping label, its columns or NULL) once per requested grouping.
    picks = F.array(
        *[
            F.struct(
                F.lit("+".join(g) if g else "overall").alias("group_kind"),
                *[(F.col(c) if c in g else F.lit(None).cast("string")).alias(c) for c in groups],
            )
            for g in groupings
        ]
    )
    spread = counted.select(F.explode(picks).alias("g"), "horizon", "return_pct_net", "n", "dd_sum", "dd_min").select(
        "g.*", "horizon", "return_pct_net", "n", "dd_sum", "dd_min"
    )
    merged = spread.groupBy("group_kind", *groups, "horizon", "return_pct_net").agg(
        F.sum("n").alias("n"), F.sum("dd_sum").alias("dd_sum"), F.min("dd_min").alias("dd_min")
    )
    net, n = F.col("return_pct_net"), F.col("n")
    return merged.groupBy("group_kind", *groups, "horizon").agg(
        F.sum("n").alias("samples"),
        F.round(F.try_divide(F.sum(F.when(net > 0, n).otherwise(0)), F.sum("n")) * 100, 2).alias("hit_rate_pct"),
        F.round(F.try_divide(F.sum(net * n), F.sum("n")), 3).alias("average_return_pct_net"),
        F.round(F.expr("percentile(return_pct_net, 0.5, n)"), 3).alias("median_return_pct_net"),
        F.max("return_pct_net").alias("best_pct"),
        F.min("return_pct_net").alias("worst_pct"),
        F.round(F.try_divide(F.sum("dd_sum"), F.sum("n")), 3).alias("average_max_drawdown_pct"),
        F.min("dd_min").alias("worst_max_drawdown_pct"),
    )


def with_reliability(stats: DataFrame, minimum: int = RELIABLE_SIGNALS) -> DataFrame:
    return stats.withColumn("reliable", F.col("samples") >= minimum)


def by_signals(stats: DataFrame) -> DataFrame:
    """Group summaries with ``place``, their order inside a kind of grouping: most signals first, then by name."""
    names = [c for c in ("pattern", "market") if c in stats.columns]
    order = Window.partitionBy("group_kind", "horizon").orderBy(F.desc("samples"), *names)
    return stats.withColumn("place", F.row_number().over(order))


def edges_of(summary: DataFrame) -> DataFrame:
    """Return and hit-rate advantage of signals over the baseline at the same horizon.

    ``summary`` holds both, told apart by ``group_kind``; the baseline's figures
    reach the other rows of their horizon in the same pass.
    """
    same = Window.partitionBy("horizon")
    of_baseline = lambda c: F.max(F.when(F.col("group_kind") == "baseline", F.col(c))).over(same)
    out = summary.withColumns(
        {"baseline_return_pct_net": of_baseline("average_return_pct_net"), "baseline_hit_rate_pct": of_baseline("hit_rate_pct")}
    )
    return with_reliability(out.filter("market is null and group_kind not in ('market', 'baseline')")).withColumns(
        {
            "return_edge_pp": F.round(F.col("average_return_pct_net") - F.col("baseline_return_pct_net"), 3),
            "hit_rate_edge_pp": F.round(F.col("hit_rate_pct") - F.col("baseline_hit_rate_pct"), 2),
        }
    )


# --- evidence gate ----------------------------------------------------------

MINIMUM_SIGNALS = 200
MINIMUM_EDGE_PP = 0.5


def evidence(edges: DataFrame, timeframe: str) -> DataFrame:
    """Verdict per pattern at the longest measured horizon.

    ``edges`` is the by-pattern output of :func:`edges_of`. Every pattern is
    judged at the study's longest horizon.
    """
    # A row for each pattern and horizon: few enough for one window, and the study is planned once.
    longest = F.max("horizon").over(Window.partitionBy(F.lit(True)))
    rows = edges.filter("pattern is not null").withColumn("_longest", longest).filter(F.col("horizon") == F.col("_longest"))
    edge, hit = (F.coalesce(c, F.lit(0.0)) for c in (F.col("return_edge_pp"), F.col("hit_rate_edge_pp")))
    few = F.col("samples") < MINIMUM_SIGNALS
    wins = (edge >= MINIMUM_EDGE_PP) & (hit > 0)
    verdict = (
        F.when(few, "insufficient").when(wins, "edge").when(edge > 0, "marginal").otherwise("no_edge")
    )
    return rows.select(
        "pattern",
        F.lit(timeframe).alias("timeframe"),
        F.lit(True).alias("available"),
        verdict.alias("verdict"),
        (verdict == "edge").alias("tradeable"),
        F.col("samples").alias("signals"),
        F.col("horizon").alias("horizon_bars"),
        "average_return_pct_net",
        "hit_rate_pct",
        "average_max_drawdown_pct",
        "baseline_return_pct_net",
        "baseline_hit_rate_pct",
        F.round(edge, 3).alias("return_edge_pp"),
        F.round(hit, 2).alias("hit_rate_edge_pp"),
    )


def with_best_evidence(signals: DataFrame, evidence_table: DataFrame, hits: str = "patterns") -> DataFrame:
    """Add the evidence of the strongest fired pattern of each row.

    Tradeable patterns come first, then measured ones by edge, then the first
    that fired. Hits are exploded, matched and folded back in one pass, so the
    signals are not computed twice. The evidence table has one row per pattern
    and timeframe; there is one row per (symbol, date) in ``signals``.
    """
    others = [c for c in signals.columns if c not in ("symbol", "date")]
    fired = signals.select("symbol", "date", F.struct(*others).alias("_row"), F.posexplode(hits).alias("_pos", "_hit")).withColumn(
        "pattern", F.col("_hit.name")
    )
    joined = fired.join(evidence_table, "pattern", "left").withColumns(
        {
            "available": F.coalesce("available", F.lit(False)),
            "tradeable": F.coalesce("tradeable", F.lit(False)),
            "verdict": F.coalesce("verdict", F.lit("unmeasured")),
        }
    )
    rank = F.when(F.col("tradeable"), 2).when(F.col("available"), 1).otherwise(0)
    # A measured edge of exactly zero ranks below any other measured one.
    edge = F.when(F.col("tradeable"), F.col("return_edge_pp")).otherwise(F.expr("nullif(return_edge_pp, 0D)"))
    weight = F.when(rank == 0, F.lit(0.0)).otherwise(F.coalesce(edge, F.lit(-999.0)))
    kept = ["pattern", "available", "tradeable", "verdict", "signals", "horizon_bars", "return_edge_pp", "hit_rate_edge_pp"]
    best = F.struct(rank.alias("r"), weight.alias("w"), (-F.col("_pos")).alias("p"), F.struct(*[c for c in kept if c in joined.columns]).alias("e"))
    return (
        joined.groupBy("symbol", "date")
        .agg(F.max(best).alias("b"), F.first("_row").alias("_row"))
        .select("symbol", "date", *[F.col(f"_row.{c}").alias(c) for c in others], F.col("b.e").alias("evidence"))
    )
