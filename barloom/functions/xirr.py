"""Money-weighted annual return of dated cash flows.

Bisection from a doubling bracket, NULL when the flows do not change sign. It
runs inside the JVM over one small array per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import computed_once

LOWEST_RATE = -0.9999
HIGHEST_RATES = [float(2**k) for k in range(11)]
BISECTIONS = 100  # halves a bracket of 1025 to below double precision


def timed_flows(flows: Column) -> Column:
    """Dated flows (d DATE, a DOUBLE), oldest first, as (t years since the first, a); Actual/365."""
    return F.transform(
        F.array(flows),
        lambda all_flows: F.transform(
            all_flows, lambda f: F.struct((F.datediff(f["d"], all_flows[0]["d"]) / 365.0).alias("t"), f["a"].alias("a"))
        ),
    )[0]


def net_present_value(timed: Column, rate: Column) -> Column:
    return F.aggregate(timed, F.lit(0.0), lambda total, f: total + f["a"] / F.pow(1 + rate, f["t"]))


def _xirr(timed: Column) -> Column:
    has_both = F.exists(timed, lambda f: f["a"] < 0) & F.exists(timed, lambda f: f["a"] > 0)
    tops = F.array(*[F.lit(h) for h in HIGHEST_RATES])
    top = F.coalesce(
        F.try_element_at(F.filter(tops, lambda h: net_present_value(timed, h) <= 0), F.lit(1)),
        F.lit(HIGHEST_RATES[-1]),
    )
    bracket = F.struct(F.lit(LOWEST_RATE).alias("lo"), top.alias("hi"))

    def halve(state: Column, _: Column) -> Column:
        middle = (state["lo"] + state["hi"]) / 2
        above = net_present_value(timed, middle) > 0
        return F.transform(
            F.array(above),
            lambda up: F.struct(
                F.when(up, middle).otherwise(state["lo"]).alias("lo"), F.when(up, state["hi"]).otherwise(middle).alias("hi")
            ),
        )[0]

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), bracket, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    crosses = net_present_value(timed, F.lit(LOWEST_RATE)) * net_present_value(timed, top) <= 0
    return F.when(has_both & crosses, solved)


def with_xirr(df: DataFrame, flows: Column, name: str = "xirr") -> DataFrame:
    """Add the rate. The timed flows are built once per row before the solver
    reads them; as an inline expression they would be rebuilt at every step."""
    out = computed_once(df, {"_flows": timed_flows(flows)})
    return computed_once(out, {name: _xirr(F.col("_flows"))}).drop("_flows")
