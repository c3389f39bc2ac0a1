"""Trading and reporting currencies and conversion through USD."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Currency an exchange suffix quotes in.
SUFFIX_CURRENCY = {
    ".BK": "THB", ".HK": "HKD", ".SS": "CNY", ".SZ": "CNY", ".T": "JPY", ".KS": "KRW", ".KQ": "KRW",
    ".TW": "TWD", ".TWO": "TWD", ".SI": "SGD", ".NS": "INR", ".BO": "INR", ".AX": "AUD", ".TO": "CAD",
    ".V": "CAD", ".L": "GBP", ".DE": "EUR", ".F": "EUR", ".PA": "EUR", ".AS": "EUR", ".MI": "EUR",
    ".MC": "EUR", ".BR": "EUR", ".LS": "EUR", ".HE": "EUR", ".VI": "EUR", ".SW": "CHF", ".ST": "SEK",
    ".OL": "NOK", ".CO": "DKK", ".SA": "BRL", ".MX": "MXN", ".JO": "ZAR",
}

# Currency of a market when the symbol has no known suffix.
MARKET_CURRENCY = {
    "US": "USD", "TH": "THB", "CN": "CNY", "HK": "HKD", "JP": "JPY", "SG": "SGD", "KR": "KRW",
    "TW": "TWD", "IN": "INR", "UK": "GBP", "GB": "GBP", "EU": "EUR", "AU": "AUD", "CA": "CAD",
}

# Thai currency names shown next to the code.
CURRENCY_NAMES = {
    "USD": "ดอลลาร์สหรัฐ", "THB": "บาท", "HKD": "ดอลลาร์ฮ่องกง", "CNY": "หยวนจีน", "JPY": "เยนญี่ปุ่น",
    "EUR": "ยูโร", "GBP": "ปอนด์สเตอร์ลิง", "SGD": "ดอลลาร์สิงคโปร์", "TWD": "ดอลลาร์ไต้หวัน",
    "KRW": "วอนเกาหลี", "INR": "รูปีอินเดีย", "AUD": "ดอลลาร์ออสเตรเลีย", "CAD": "ดอลลาร์แคนาดา",
    "CHF": "ฟรังก์สวิส", "SEK": "โครนาสวีเดน", "NOK": "โครนนอร์เวย์", "DKK": "โครนเดนมาร์ก",
    "BRL": "เรียลบราซิล", "MXN": "เปโซเม็กซิโก", "ZAR": "แรนด์แอฟริกาใต้",
}
UNKNOWN_CURRENCY = "ไม่ทราบสกุลเงิน"


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small fixed table, NULL when the key is missing."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _code(value: Column) -> Column:
    return F.upper(F.trim(F.coalesce(value, F.lit(""))))


def trading_currency(symbol: Column, market: Column) -> Column:
    """From the suffix after the last dot, else the market, else USD."""
    suffix = F.regexp_extract(_code(symbol), r"(\.[^.]*)$", 1)
    return F.coalesce(lookup(SUFFIX_CURRENCY, suffix), lookup(MARKET_CURRENCY, _code(market)), F.lit("USD"))


def price_scale(symbol: Column) -> Column:
    """London quotes are in pence, statements in pounds."""
    return F.when(_code(symbol).endswith(".L"), F.lit(0.01)).otherwise(F.lit(1.0))


def currency_name(code: Column) -> Column:
    clean = _code(code)
    return F.coalesce(lookup(CURRENCY_NAMES, clean), F.when(clean == "", "-").otherwise(clean))


def currency_label(code: Column) -> Column:
    clean = _code(code)
    name = lookup(CURRENCY_NAMES, clean)
    return (
        F.when(clean == "", F.lit(UNKNOWN_CURRENCY))
        .when(name.isNotNull(), F.concat(clean, F.lit(" ("), name, F.lit(")")))
        .otherwise(clean)
    )


def with_rate(df: DataFrame, fx: DataFrame, code: str, name: str) -> DataFrame:
    """Add units of ``code`` per USD; USD is 1, unknown or zero rates are NULL."""
    rates = fx.select(F.upper(F.trim("code")).alias("_code"), F.expr("nullif(per_usd, 0D)").alias("_per_usd"))
    joined = df.join(rates, _code(F.col(code)) == F.col("_code"), "left")
    return joined.withColumn(name, F.when(_code(F.col(code)) == "USD", 1.0).otherwise(F.col("_per_usd"))).drop(
        "_code", "_per_usd"
    )


def convert(amount: Column, source: Column, target: Column, source_rate: Column, target_rate: Column) -> Column:
    """Through USD; unchanged when the codes match, NULL when a leg has no rate."""
    return (
        F.when((_code(source) == "") | (_code(target) == ""), F.lit(None).cast("double"))
        .when(_code(source) == _code(target), amount)
        .otherwise(amount / source_rate * target_rate)
    )
