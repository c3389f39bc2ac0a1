"""Reviewed company profiles: validation, lookup by alias, field precedence."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REVIEW_DAYS = 180
_SOURCES = "source_ids:array<string>"
PROFILE = (
    f"struct<name:string,period:string,summary:string,revenue_model:string,key_customers:string,moat_summary:string,catalysts:string,risks:string,"
    f"invalidation:string,reviewed_at:string,aliases:array<string>,sources:array<struct<id:string,url:string,title:string>>,{_SOURCES},"
    f"revenue_breakdown:struct<{_SOURCES},basis:string,currency:string,unit:string,total:double,segments:array<struct<name:string,amount:double,description:string>>>,"
    f"peers:array<struct<{_SOURCES},name:string,overlap:string,compare:string>>,"
    f"evidence:array<struct<{_SOURCES},kind:string,title:string,detail:string>>>"
)


def parse_catalog(raw: DataFrame) -> DataFrame:
    """body {"schema_version": 1, "profiles": {symbol: {...}}} -> symbol, p."""
    out = raw.select(F.from_json("body", f"struct<schema_version:int,profiles:map<string,{PROFILE}>>").alias("j"))
    return out.filter("j.schema_version = 1").select(F.explode("j.profiles").alias("symbol", "p"))


def _blank(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit("")) == ""


def _web(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/@\s?#]+([/?#].*)?$"), F.lit(False))


def validate(catalog: DataFrame) -> DataFrame:
    """Adds ``error``: the first rule a profile breaks, NULL when it is sound."""
    p = F.col("p")
    ids = F.transform(p["sources"], lambda s: s["id"])

    def unsourced(cited: Column) -> Column:
        return cited.isNull() | (F.size(cited) <= 0) | (F.size(F.array_except(cited, ids)) > 0)

    def any_of(rows: Column, test) -> Column:
        return F.exists(rows, test)

    segments, total = p["revenue_breakdown"]["segments"], p["revenue_breakdown"]["total"]
    amounts = F.aggregate(segments, F.lit(0.0), lambda t, s: t + F.coalesce(s["amount"], F.lit(0.0)))
    close = F.abs(amounts - total) <= F.greatest(F.lit(0.01), F.greatest(F.abs(amounts), F.abs(total)) * 0.0001)
    none = lambda c: c.isNull() | (F.size(c) <= 0)
    missing_text = F.lit(False)
    for field in ("name", "period", "summary", "revenue_model", "key_customers", "moat_summary"):
        missing_text = missing_text | _blank(p[field])
    error = (
        F.when(F.col("symbol") != F.upper(F.trim("symbol")), "invalid_symbol")
        .when(missing_text, "missing_text")
        .when(F.try_to_date(p["reviewed_at"], "yyyy-MM-dd").isNull(), "invalid_review_date")
        .when(none(p["sources"]) | (F.size(F.array_distinct(ids)) != F.size(ids)), "missing_or_duplicate_sources")
        .when(any_of(p["sources"], lambda s: ~_web(s["url"]) | _blank(s["title"])), "invalid_source")
        .when(unsourced(p["source_ids"]) | unsourced(p["revenue_breakdown"]["source_ids"]), "missing_source_reference")
        .when(none(segments) | _blank(p["revenue_breakdown"]["basis"]), "missing_breakdown")
        .when(total.isNotNull() & ((total <= 0) | any_of(segments, lambda s: s["amount"].isNull() | (s["amount"] < 0))), "invalid_amounts")
        .when(total.isNotNull() & ~close, "segments_do_not_reconcile")
        .when(total.isNotNull() & (_blank(p["revenue_breakdown"]["currency"]) | _blank(p["revenue_breakdown"]["unit"])), "missing_units")
        .when(total.isNull() & any_of(segments, lambda s: s["amount"].isNotNull()), "amounts_without_total")
        .when(any_of(segments, lambda s: _blank(s["name"])), "missing_segment_name")
        .when(none(p["peers"]) | none(p["evidence"]), "missing_competition")
        .when(any_of(p["peers"], lambda r: unsourced(r["source_ids"])) | any_of(p["evidence"], lambda r: unsourced(r["source_ids"])), "missing_source_reference")
        .when(any_of(p["peers"], lambda r: _blank(r["name"]) | _blank(r["overlap"]) | _blank(r["compare"])), "incomplete_peer")
        .when(any_of(p["evidence"], lambda r: ~F.coalesce(r["kind"].isin("reported", "company_claim", "analysis"), F.lit(False))), "invalid_evidence_kind")
        .when(any_of(p["evidence"], lambda r: _blank(r["title"]) | _blank(r["detail"])), "incomplete_evidence")
    )
    return catalog.withColumn("error", error)


def aliases(valid: DataFrame) -> DataFrame:
    """alias, symbol for the valid profiles, the symbol itself included. The catalog is reviewed by hand, so it is small."""
    names = F.array_union(F.array(F.col("symbol")), F.coalesce(F.col("p.aliases"), F.array().cast("array<string>")))
    return valid.select(F.explode(names).alias("alias"), "symbol")


def duplicate_aliases(valid: DataFrame) -> DataFrame:
    return aliases(valid).groupBy("alias").agg(F.count_distinct("symbol").alias("n")).filter("n > 1")


def with_segment_shares(valid: DataFrame, today: dt.date | str) -> DataFrame:
    """Segment shares in percent, review age in days and the review flag."""
    b = F.col("p.revenue_breakdown")
    share = lambda s: F.round(F.try_divide(s["amount"], F.nullif(b["total"], F.lit(0.0))) * 100, 2)
    age = F.greatest(F.lit(0), F.datediff(F.lit(today).cast("date"), F.to_date("p.reviewed_at")))
    return valid.withColumns(
        {
            "segments": F.transform(b["segments"], lambda s: F.struct(s["name"].alias("name"), s["amount"].alias("amount"), share(s).alias("share_pct"))),
            "review_age_days": age,
            "needs_review": age > REVIEW_DAYS,
        }
    )


def business_fields(symbols: DataFrame, journal: DataFrame, catalog: DataFrame, filings: DataFrame, fields: dict[str, tuple[str | None, str | None, str | None]], names: DataFrame | None = None) -> DataFrame:
    """Each field from the journal, else the catalog, else the filing, with its origin.

    ``fields``: output name -> (journal column, catalog column, filing column).
    ``names`` (alias, symbol), as ``aliases`` makes it, lets a symbol find its
    catalog entry under another name.
    """
    if names is not None:
        catalog = catalog.join(names, "symbol").drop("symbol").withColumnRenamed("alias", "symbol")
    sources = {"journal": journal, "reference": catalog, "filing": filings}
    out = symbols.select("symbol")
    for name, df in sources.items():
        out = out.join(df.select("symbol", *[F.col(c).alias(f"_{name}_{c}") for c in df.columns if c != "symbol"]), "symbol", "left")
    result = [F.col("symbol")]
    for target, columns in fields.items():
        given = [(s, F.when(~_blank(F.col(f"_{s}_{c}")), F.col(f"_{s}_{c}"))) for s, c in zip(sources, columns) if c]
        result.append(F.coalesce(*[v for _, v in given], F.lit("")).alias(target))
        origin = F.coalesce(*[F.when(v.isNotNull(), F.lit(s)) for s, v in given], F.lit("missing"))
        result.append(origin.alias(f"{target}_origin"))
    return out.select(*result)
