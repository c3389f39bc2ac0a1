"""Scores, grades, decisions and the messages that explain them.

All are expressions over snapshot columns. A withheld ratio scores as zero, as
the published rules do; ``strict_nulls`` scores it as unknown instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.currency import lookup
from barloom.functions.numeric import clamp, message, tidy


def _number(name: str, strict_nulls: bool) -> Column:
    return F.col(name) if strict_nulls else F.coalesce(F.col(name), F.lit(0.0))


def _bands(value: Column, bands: list[tuple[float, float]], otherwise: float, at_most: bool = False) -> Column:
    """Points of the first band whose bound holds; an unknown value scores nothing."""
    out = F.when(value.isNull(), F.lit(0.0))
    for bound, points in bands:
        out = out.when((value <= bound) if at_most else (value >= bound), F.lit(float(points)))
    return out.otherwise(F.lit(float(otherwise)))


def average_growth(strict_nulls: bool = False) -> Column:
    return (_number("revenue_growth", strict_nulls) + _number("profit_growth", strict_nulls)) / 2


def financial_score(strict_nulls: bool = False) -> Column:
    n = lambda name: _number(name, strict_nulls)
    return clamp(
        _bands(n("roe"), [(20, 22), (12, 15)], 5)
        + _bands(n("roa"), [(8, 14), (4, 8)], 0)
        + _bands(n("debt_to_equity"), [(0.8, 16), (1.8, 9)], 2, at_most=True)
        + _bands(average_growth(strict_nulls), [(15, 20), (5, 12), (0, 6)], 0)
        + _bands(n("net_margin"), [(18, 15), (8, 9)], 0)
        + _bands(n("liquidity_score"), [(70, 13), (40, 7)], 0),
        0,
        100,
    )


def financial_bullets() -> Column:
    g = average_growth()
    n = lambda name: _number(name, False)
    return tidy(
        [
            F.when(n("roe") >= 20, message("ROE strong %.1f%%", n("roe"))).when(
                n("roe") >= 12, message("ROE acceptable %.1f%%", n("roe"))
            ),
            F.when(n("roa") >= 8, message("ROA healthy %.1f%%", n("roa"))),
            F.when(n("debt_to_equity") <= 0.8, message("debt/equity controlled %.2fx", n("debt_to_equity"))),
            F.when(g >= 15, message("growth strong %.1f%%", g)).when(
                g >= 5, message("growth positive %.1f%%", g)
            ),
            F.when(n("net_margin") >= 18, message("net margin high %.1f%%", n("net_margin"))),
            F.when(n("liquidity_score") >= 70, F.lit("liquid enough to execute")),
        ]
    )


def financial_warnings() -> Column:
    g = average_growth()
    n = lambda name: _number(name, False)
    return tidy(
        [
            F.when(n("roe") < 12, message("ROE weak %.1f%%", n("roe"))),
            F.when(n("roa") < 4, message("ROA low %.1f%%", n("roa"))),
            F.when(n("debt_to_equity") > 1.8, message("debt/equity high %.2fx", n("debt_to_equity"))),
            F.when(g < 0, message("growth negative %.1f%%", g)),
            F.when(n("net_margin") < 8, message("net margin thin %.1f%%", n("net_margin"))),
            F.when(n("liquidity_score") < 40, F.lit("liquidity low")),
        ]
    )


# Points for moat and technology trend, and sectors with a tailwind.
MOAT_POINTS = {"wide": "24", "strong": "20", "medium": "14", "niche": "12", "weak": "3"}
TREND_POINTS = {"leader": "20", "beneficiary": "15", "automation": "11", "neutral": "5", "laggard": "0"}
TAILWIND_SECTORS = ("semiconductors", "software", "digital infrastructure")


def business_score() -> Column:
    moat = F.coalesce(lookup(MOAT_POINTS, F.lower("moat")).cast("double"), F.lit(8.0))
    trend = F.coalesce(lookup(TREND_POINTS, F.lower("ai_trend")).cast("double"), F.lit(5.0))
    tailwind = F.when(F.lower("sector").isin(*TAILWIND_SECTORS), 6.0).otherwise(0.0)
    return clamp(F.lit(44.0) + moat + trend + tailwind, 0, 100)


def valuation_score() -> Column:
    """From pe, pbv, upside_pct; 0 while the multiples are unverified."""
    pe, pbv, up = F.col("pe"), F.col("pbv"), F.col("upside_pct")
    growth = F.greatest(F.lit(0.0), average_growth())
    peg = F.try_divide(pe, growth)
    score = (
        F.lit(50.0)
        + F.when(pe.isNull(), -8.0).when(pe <= 12, 18.0).when(pe <= 20, 12.0).when(pe <= 32, 5.0).otherwise(-6.0)
        + F.when(pe.isNull() | (growth <= 0), 0.0).when(peg <= 1.0, 8.0).when(peg > 2.5, -4.0).otherwise(0.0)
        + F.when(pbv.isNull(), 0.0).when(pbv <= 1.5, 12.0).when(pbv <= 3.0, 8.0).when(pbv <= 6.0, 2.0).otherwise(-6.0)
        + F.when(up.isNull(), 0.0).when(up >= 25, 20.0).when(up >= 10, 12.0).when(up < 0, -12.0).otherwise(0.0)
    )
    return F.when(F.col("valuation_verified"), clamp(score, 0, 100)).otherwise(F.lit(0.0))


def valuation_warnings() -> Column:
    pe, pbv, up = F.col("pe"), F.col("pbv"), F.col("upside_pct")
    peg = F.try_divide(pe, F.greatest(F.lit(0.0), average_growth()))
    messages = tidy(
        [
            F.when(pe.isNull(), F.lit("no P/E: EPS is not positive")).when(
                pe > 32, message("P/E %.1f needs growth behind it", pe)
            ),
            F.when(peg > 2.5, message("PEG %.2f: price runs ahead of growth", peg)),
            F.when(pbv.isNull(), F.lit("no P/BV from these statements")).when(
                pbv > 6.0, message("P/BV %.2f is expensive", pbv)
            ),
            F.when(up < 0, message("price is %.1f%% above the appraised value", F.abs(up))),
        ]
    )
    return F.when(F.col("valuation_verified"), messages).otherwise(F.array().cast("array<string>"))


# The verdict and decision texts.
VERDICTS = {"unverified": "ยังประเมินมูลค่าไม่ได้", "cheap": "ราคายังต่ำกว่าพื้นฐาน", "fair": "ราคาเหมาะสม", "dear": "ราคาแพงเทียบพื้นฐาน"}
DECISIONS = {
    "stale_price": "ข้อมูลราคาไม่สด",
    "bearish": "Reject long / watch breakdown",
    "need_statements": "รอตรวจงบการเงิน",
    "need_history": "งบยืนยันแล้ว แต่ประวัติยังไม่ครบ 5 ปี",
    "need_valuation": "รอประเมินมูลค่า",
    "need_research": "รอบทวิเคราะห์ธุรกิจ",
}


def valuation_verdict(score: Column) -> Column:
    return (
        F.when(~F.coalesce("valuation_verified", F.lit(False)), VERDICTS["unverified"])
        .when(score >= 72, VERDICTS["cheap"])
        .when(score >= 55, VERDICTS["fair"])
        .otherwise(VERDICTS["dear"])
    )


def verification_level() -> Column:
    f, h, v, r = (F.coalesce(c, F.lit(False)) for c in (
        "fundamentals_verified", "financial_history_complete", "valuation_verified", "research_verified"))
    return (
        F.when(f & h & v & r, "full")
        .when(f & h & v, "valuation")
        .when(f & h, "financial")
        .when(f, "financial_partial")
        .otherwise("technical")
    )


# Score cap and weights (technical, financial, valuation, business) per level.
LEVELS = {
    "full": (100.0, 0.38, 0.27, 0.20, 0.15),
    "valuation": (90.0, 0.46, 0.32, 0.22, 0.0),
    "financial": (82.0, 0.60, 0.40, 0.0, 0.0),
    "financial_partial": (78.0, 0.65, 0.35, 0.0, 0.0),
    "technical": (72.0, 1.0, 0.0, 0.0, 0.0),
}
BEARISH_CAP = 62.0


def _per_level(level: Column, position: int) -> Column:
    out = None
    for name, values in LEVELS.items():
        out = (F.when if out is None else out.when)(level == name, F.lit(values[position]))
    return out


def score_cap(level: Column) -> Column:
    return _per_level(level, 0)


def final_score(level: Column, technical: Column, financial: Column, valuation: Column, business: Column, bearish: Column) -> Column:
    """Weights move onto what is verified; the cap keeps unchecked charts below researched names."""
    blended = (
        technical * _per_level(level, 1)
        + financial * _per_level(level, 2)
        + valuation * _per_level(level, 3)
        + business * _per_level(level, 4)
    )
    capped = F.least(blended, score_cap(level))
    return F.when(bearish, F.least(capped, F.lit(BEARISH_CAP))).otherwise(capped)


def grade(score: Column, fully_verified: Column) -> Column:
    letter = (
        F.when(score >= 88, "A+").when(score >= 78, "A").when(score >= 68, "B").when(score >= 58, "C").otherwise("D")
    )
    return F.when(fully_verified, letter).otherwise(F.concat(F.lit("T-"), letter))


def decision(score: Column, warnings: Column, bearish: Column, fresh: Column, tradeable: Column) -> Column:
    """Ordered ladder; a candidate has no warning at all and a measured edge."""
    ok = lambda name: F.coalesce(F.col(name), F.lit(False))
    return (
        F.when(~fresh, DECISIONS["stale_price"])
        .when(bearish, DECISIONS["bearish"])
        .when(~ok("fundamentals_verified"), DECISIONS["need_statements"])
        .when(~ok("financial_history_complete"), DECISIONS["need_history"])
        .when(~ok("valuation_verified"), DECISIONS["need_valuation"])
        .when(~ok("research_verified"), DECISIONS["need_research"])
        .when((score >= 82) & (F.size(warnings) == 0) & tradeable, "Candidate")
        .when(score >= 72, "Watchlist")
        .when(score >= 60, "Needs confirmation")
        .otherwise("Reject")
    )


def scan_warnings() -> Column:
    """Everything that speaks against a result, in a fixed order."""
    ok = lambda name: F.coalesce(F.col(name), F.lit(False))
    none = F.array().cast("array<string>")
    books = F.when(ok("fundamentals_verified"), financial_warnings()).otherwise(none)
    own = tidy(
        [
            F.when(F.col("bearish"), F.lit("bearish chart structure")),
            F.when(ok("fundamentals_verified") & (F.col("fundamental_score") < 55), F.lit("books do not confirm the chart")),
            F.when(~ok("fundamentals_verified"), F.lit("statements not verified")).when(
                ~ok("financial_history_complete"), F.lit("statement history incomplete")
            ),
            F.when(~ok("valuation_verified"), F.concat(F.lit("valuation: "), F.col("valuation_note"))),
            F.when(~ok("research_verified"), F.lit("business quality not reviewed")),
            F.when(~F.col("tradeable"), F.concat(F.lit("evidence: "), F.col("evidence_verdict"))),
            F.when(~F.col("price_is_fresh"), F.concat(F.lit("price stale since "), F.col("price_as_of").cast("string"))),
            F.when(
                F.col("verification_level") != "full",
                message("score capped at %.0f (%s)", F.col("score_cap"), F.col("verification_level")),
            ),
            F.when(
                (F.col("turnover_usd") != 0) & (F.col("turnover_usd") < 1_000_000),
                message("thin turnover %.2fM USD a day", F.col("turnover_usd") / 1_000_000),
            ),
        ]
    )
    return F.concat(books, valuation_warnings(), own)


def _insight(agent: str, score: Column, label: Column, summary: Column, bullets: Column) -> Column:
    return F.struct(
        F.lit(agent).alias("agent"),
        score.alias("score"),
        label.alias("label"),
        summary.alias("summary"),
        bullets.alias("bullets"),
    )


def _label(score: Column, high: float, high_label: str, mid: float, mid_label: str, low_label: str) -> Column:
    return F.when(score >= high, high_label).when(score >= mid, mid_label).otherwise(low_label)


def technical_insight(score: Column, hits: Column) -> Column:
    names = F.concat_ws(", ", F.transform(hits, lambda h: h["name"]))
    return _insight(
        "technical", score, _label(score, 78, "A setup", 58, "Watch", "Weak"),
        F.when(F.size(hits) > 0, F.concat(F.lit("detected: "), names)).otherwise("no pattern"),
        F.transform(hits, lambda h: message("%s level %.2f", h["name"], h["level"])),
    )


def financial_insight(score: Column) -> Column:
    pending = ~F.coalesce(F.col("fundamentals_verified"), F.lit(False))
    return _insight(
        "financial", F.when(pending, 0.0).otherwise(score),
        F.when(pending, "Pending").otherwise(_label(score, 75, "Strong", 55, "Check", "Weak")),
        F.when(pending, "no verified statements").when(score >= 65, "supports the setup").otherwise("needs caution"),
        F.when(pending, F.array().cast("array<string>")).otherwise(
            F.concat(financial_bullets(), financial_warnings())
        ),
    )


def business_insight(score: Column) -> Column:
    return _insight(
        "business", score, _label(score, 75, "Quality", 55, "Neutral", "Low quality"), F.lit("moat and trend"),
        F.array(F.concat(F.lit("moat "), F.col("moat")), F.concat(F.lit("trend "), F.col("ai_trend"))),
    )


def valuation_insight(score: Column) -> Column:
    return _insight(
        "valuation", score, _label(score, 72, "Attractive", 55, "Fair", "Expensive"), F.lit("price against value"),
        valuation_warnings(),
    )


def report_insight() -> Column:
    return _insight(
        "report", F.col("final_score"), F.col("grade"),
        F.concat(F.col("symbol"), F.lit(": "), F.col("decision")),
        F.array(
            message("technical %.1f, financial %.1f", F.col("technical_score"), F.col("fundamental_score")),
            message("business %.1f, valuation %.1f", F.col("business_score"), F.col("valuation_score")),
        ),
    )


def scanner_insight(results):
    """One row about a whole scan: how many results and the best score."""
    return results.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("final_score"), F.lit(0.0)).alias("best")).select(
        _insight(
            "scanner", F.col("best"), F.when(F.col("n") > 0, "Active").otherwise("Quiet"),
            message("%d symbols above the filters", F.col("n")),
            F.array(F.lit("chart first, books second, risk last")),
        ).alias("insight")
    )
