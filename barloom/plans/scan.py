"""The market scan: pattern first, books second, risk last."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import computed_once, message
from barloom.operators import scoring as X
from barloom.operators.bars import check_timeframe, completed, last_bars, resample, with_min_history
from barloom.operators.filters import eligible, expected_eod, is_fresh
from barloom.operators.liquidity import tail_metrics, with_liquidity
from barloom.operators.patterns import SCAN_PATTERNS, Pattern, detect, technical_score, with_pattern_features
from barloom.operators.risk import risk_plan
from barloom.operators.study import with_best_evidence
from barloom.operators.valuation import derive_valuation


def scan_market(
    bars: DataFrame,
    snapshots: DataFrame,
    fx: DataFrame,
    evidence: DataFrame | None = None,
    *,
    as_of: dt.date | str,
    market: str = "ALL",
    universe: str = "ALL",
    patterns: Sequence[Pattern] = SCAN_PATTERNS,
    min_score: float = 70.0,
    min_liquidity: float = 40.0,
    timeframe: str = "D",
    check_freshness: bool = True,
    detail: bool = True,
    in_order: bool = True,
) -> DataFrame:
    """Ranked symbols whose latest bar shows a pattern and passes the filters.

    ``detail`` adds the nested insights and decision summary. Ordering draws range
    bounds from a sample, for which Spark runs the whole scan once more; with
    ``in_order`` off the caller writes the rows first and ranks what is written.
    """
    timeframe = check_timeframe(timeframe)
    # The cheap predicates run on the snapshot before any bar is touched.
    names = eligible(snapshots, market, universe)
    daily = completed(bars, as_of).join(names.select("symbol"), "symbol", "left_semi")
    chart = with_min_history(resample(daily, timeframe, as_of), timeframe)
    features = with_pattern_features(chart, timeframe, patterns, keep_last=1)
    kept = ["close", "ema20", "ema50", "ema200", "vr20", "phase"]
    hits = detect(features, timeframe, patterns, keep=kept, only=F.col("rn") == F.col("bar_count"))
    hits = hits.withColumn("technical_score", technical_score(F.col("hits"))).select(
        "symbol", "date", F.col("hits").alias("patterns"), F.col("phase").alias("market_phase"), "technical_score"
    )
    if evidence is None:
        hits = hits.withColumn("evidence", F.lit(None).cast("struct<pattern:string,tradeable:boolean,verdict:string>"))
    else:
        hits = with_best_evidence(hits, evidence)

    base = names.drop(*[c for c in ("liquidity_score", "turnover_usd", "currency") if c in names.columns])
    out = hits.drop("date").join(tail_metrics(daily), "symbol").join(base, "symbol")
    out = with_liquidity(out.withColumn("_listed", F.col("market")), fx).drop("_listed")
    out = out.filter(F.col("liquidity_score") >= min_liquidity)
    out = derive_valuation(out, fx)
    fresh = is_fresh(F.col("price_as_of"), expected_eod(as_of)) if check_freshness else F.lit(True)
    out = computed_once(
        out,
        {
            "bearish": F.exists("patterns", lambda h: h["side"] == "SELL"),
            "price_is_fresh": fresh,
            "tradeable": F.coalesce(F.col("evidence.tradeable"), F.lit(False)),
            "evidence_verdict": F.coalesce(F.col("evidence.verdict"), F.lit("unmeasured")),
            "fundamental_score": F.when(F.col("fundamentals_verified"), X.financial_score()).otherwise(0.0),
            "business_score": F.when(F.col("research_verified"), X.business_score()).otherwise(0.0),
            "valuation_score": X.valuation_score(),
            "verification_level": X.verification_level(),
        },
    )
    level = F.col("verification_level")
    out = computed_once(
        out,
        {
            "score_cap": X.score_cap(level),
            "final_score": X.final_score(
                level, F.col("technical_score"), F.col("fundamental_score"), F.col("valuation_score"),
                F.col("business_score"), F.col("bearish"),
            ),
        },
    ).filter(F.col("final_score") >= min_score)
    out = computed_once(out, {"warnings": X.scan_warnings()})
    out = computed_once(
        out,
        {
            "grade": X.grade(F.col("final_score"), level == "full"),
            "decision": X.decision(
                F.col("final_score"), F.col("warnings"), F.col("bearish"), F.col("price_is_fresh"), F.col("tradeable")
            ),
            "risk_plan": risk_plan(
                F.col("last_price"), F.col("atr"), F.col("support"), F.col("resistance"), F.col("bearish")
            ),
            "timeframe": F.lit(timeframe),
        },
    )
    result = [
        "symbol", "name", "market", "sector", "index_groups", "last_price", "market_phase", "technical_score",
        "fundamental_score", "business_score", "valuation_score", "final_score", "grade", "decision", "patterns",
        "risk_plan", "warnings", "fundamentals_verified", "financial_history_complete", "research_verified",
        "valuation_verified", "research_status", "verification_level", "score_cap", "liquidity_score", "turnover_usd",
        "currency", "reporting_currency", "pe", "pbv", "upside_pct", "price_as_of", "price_is_fresh", "evidence", "timeframe",
    ]
    if detail:
        out = out.withColumns({"insights": insights(), "decision_summary": decision_summary()})
        result += ["insights", "decision_summary"]
    out = out.select(*result)
    return ranked(out) if in_order else out


def ranked(results: DataFrame) -> DataFrame:
    """Scan rows, best score first, ties by symbol."""
    return results.orderBy(F.col("final_score").desc(), "symbol")


def insights():
    return F.array(
        X.technical_insight(F.col("technical_score"), F.col("patterns")),
        X.financial_insight(F.col("fundamental_score")),
        X.business_insight(F.col("business_score")),
        X.valuation_insight(F.col("valuation_score")),
        X.report_insight(),
    )


def decision_summary():
    """What an analyst reads first: setup, books, price, risk, evidence."""
    plan = F.col("risk_plan")
    return F.struct(
        F.struct((~F.col("bearish")).alias("pass"), F.concat_ws(", ", F.transform("patterns", lambda h: h["name"])).alias("label")).alias(
            "technical"
        ),
        F.struct(
            (F.col("fundamentals_verified") & F.col("financial_history_complete")).alias("verified"),
            F.col("fundamentals_verified").alias("data_verified"),
            F.col("financial_history_complete").alias("history_complete"),
            message("ROE %.1f%%, D/E %.2f, growth %.1f%%", "roe", "debt_to_equity", "revenue_growth").alias("detail"),
        ).alias("financials"),
        F.struct(
            F.col("valuation_verified").alias("verified"),
            X.valuation_verdict(F.col("valuation_score")).alias("label"),
            F.col("valuation_note").alias("detail"),
        ).alias("valuation"),
        F.struct(
            message("stop %.2f %s", plan["stop"], F.col("currency")).alias("label"),
            (plan["risk_pct"] > 12.0).alias("wide"),
            message("entry %.2f, first target %.2f, R:R %.2f", plan["entry"], plan["targets"][0], plan["reward_risk"]).alias("detail"),
        ).alias("risk"),
        F.struct(F.col("tradeable").alias("tradeable"), F.col("evidence_verdict").alias("label"), F.col("evidence.pattern").alias("pattern")).alias(
            "evidence"
        ),
        F.col("research_status").alias("research_status"),
        F.col("thesis").alias("thesis"),
    )


def scan_overview(results: DataFrame) -> DataFrame:
    """Headline numbers of a scan: count, best score, top grades, busiest market."""
    by_market = results.groupBy("market").agg(
        F.count(F.lit(1)).alias("n"), F.max("final_score").alias("best"), F.count_if(F.col("grade").isin("A", "A+")).alias("top")
    )
    return by_market.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("results"),
        F.coalesce(F.max("best"), F.lit(0.0)).alias("best_score"),
        F.coalesce(F.sum("top"), F.lit(0)).alias("top_grades"),
        # Most hits; on a tie the market that holds the better-ranked result.
        F.min(F.struct((-F.col("n")).alias("k"), (-F.col("best")).alias("b"), F.col("market")))["market"].alias("busiest_market"),
    )


def verification_counts(results: DataFrame) -> DataFrame:
    """Results per verification level, zero where a level has none."""
    counts = results.groupBy(F.col("verification_level").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    levels = results.sparkSession.createDataFrame([(k,) for k in X.LEVELS], "level string")
    return levels.join(counts, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("results"))


def symbol_detail(results: DataFrame, bars: DataFrame, snapshots: DataFrame, n: int = 180) -> DataFrame:
    """The newest ``n`` bars of every result, with its scan row and snapshot beside them.

    Few symbols are results: the others' bars are dropped before any is sorted.
    """
    detail = results.select("symbol", F.struct(*[c for c in results.columns if c != "symbol"]).alias("result"))
    held = snapshots.select("symbol", F.struct(*[c for c in snapshots.columns if c != "symbol"]).alias("snapshot"))
    wanted = bars.join(results.select("symbol"), "symbol", "left_semi")
    return last_bars(wanted, n).join(detail, "symbol").join(held, "symbol", "left")
