"""Stop, targets and reward-to-risk for a long or a bearish setup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINIMUM_ATR_MULTIPLE = 1.4
MAXIMUM_ATR_MULTIPLE = 3.0
WIDE_RISK_PCT = 12.0


def risk_plan(entry: Column, atr: Column, support: Column, resistance: Column, bearish: Column) -> Column:
    """Structure places the stop between 1.4 and 3.0 ATR; ATR is at least 1.5% of the price."""
    unit = F.greatest(atr, entry * 0.015)
    near, far = unit * MINIMUM_ATR_MULTIPLE, unit * MAXIMUM_ATR_MULTIPLE
    short_stop = F.least(F.greatest(resistance, entry + near), entry + far)
    short_risk = F.greatest(short_stop - entry, unit)
    cent = F.lit(0.01)
    short_targets = F.sort_array(
        F.array(
            F.greatest(cent, support), F.greatest(cent, entry - short_risk * 1.5), F.greatest(cent, entry - short_risk * 2.2)
        ),
        asc=False,
    )
    long_stop = F.least(entry - near, F.greatest(support, entry - far))
    long_risk = F.greatest(entry - long_stop, unit * 0.5)
    long_targets = F.sort_array(
        F.array(F.greatest(resistance, entry + long_risk * 1.5), entry + long_risk * 2.2, entry + long_risk * 3.0)
    )
    risk = F.when(bearish, short_risk).otherwise(long_risk)
    targets = F.when(bearish, short_targets).otherwise(long_targets)
    pct = F.coalesce(F.try_divide(risk, entry) * 100, F.lit(0.0))
    return F.struct(
        F.when(bearish, "Risk-off / avoid long").otherwise("Long candidate").alias("bias"),
        entry.alias("entry"),
        F.when(bearish, short_stop).otherwise(long_stop).alias("stop"),
        targets.alias("targets"),
        F.when(bearish, F.lit(3.0))
        .otherwise(F.coalesce(F.try_divide(F.element_at(long_targets, -1) - entry, long_risk), F.lit(0.0)))
        .alias("reward_risk"),
        pct.alias("risk_pct"),
        F.when(bearish, "invalid once price reclaims the right shoulder or resistance")
        .otherwise("exit when price breaks support on volume")
        .alias("invalidation"),
        F.when(bearish, "reject or hedge until structure improves")
        .when(pct > WIDE_RISK_PCT, "wide risk: reduce size or wait for a closer entry")
        .otherwise("paper trade first; cap size by portfolio risk")
        .alias("sizing_note"),
    )
