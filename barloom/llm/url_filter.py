"""Allow or block URLs: longest matching rule, else logistic regression on hashed character n-grams.

The regression learns from a small table of labelled URLs by full-batch gradient
steps. Each step is one job over that bounded table: residuals, one row per
feature, one sum per feature. The weights have a fixed number of slots, so they
travel as a literal. Scoring is one expression per row without a shuffle, so a
hot host costs nothing extra.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.staging import staged

SLOTS = 8192
SIZES = (3, 4)
STEPS = 30
RATE = 0.5
DECAY = 1e-2
#: Bound of the labelled table, for each label.
MAX_PER_LABEL = 1500
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The small labelled table that the queries learn from. Words of hosts to block and of hosts to allow, and the
#: paths that each kind has, besides paths that both have. None of the words is a host of the check data.
BLOCK_WORDS = (
    "casinos casinogames megacasino winbig bigwin gambling gamblers jackpots pokerroom roulette blackjack bingo lottery lotto slotmachine betting bettors wagers bookies sportsbook "
    "pharmacy pharmacies viagra cialis pillstore pillshop discountmeds steroids weightloss adults adultchat porno pornos erotica sexcams camgirls escorts "
    "hookups spammer spammers spamming linkfarms linkspam seoboost backlinks adserver adservers adverts adclicks bannerads popunders popups tracker trackers "
    "clicktracker retargeting clickbait paydayloan fastcash replicas cracked warez keygens torrents phishing freebies freestuff giveaways prizes winners "
    "luckydraw bonuses cheapest cheapmeds discounted cryptopump"
).split()
ALLOW_WORDS = (
    "library museum university college school hospital weather newspaper daily times journal science nature history garden kitchen recipes travel maps "
    "council river mountain music theatre football gazette archive manual wiki forum books reader letters teacher student observatory astronomy chemistry "
    "biology geology physics mathematics linguistics philosophy orchestra gallery heritage village parish harbour station railway aviation sailing cycling "
    "climbing gardening carpentry pottery knitting painting sculpture poetry novels biography dictionary encyclopedia atlas almanac statistics census "
    "parliament ministry embassy court police firebrigade ambulance charity foundation institute academy laboratory workshop bakery brewery farmers "
    "forestry fisheries meteorology volcano glacier wetland bird insects orchids zeitung bibliothek museo escuela jardin musique"
).split()
HOSTS = ("{}.example.com", "www.{}.example.net", "m.{}.example.org", "blog.{}.example.com", "{}.example.net", "www.my-{}.example.org")
BLOCK_PATHS = ("/click/{}", "/go/{}.php", "/bonus/{}", "/offer-{}.html", "/promo/{}/", "/landing/{}")
ALLOW_PATHS = ("/article/{}", "/wiki/{}", "/docs/{}.html", "/news/{}/", "/archive/{}", "/topics/{}.html")
BOTH_PATHS = ("/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}", "/", "/index.html")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``word, host, path, label`` (1.0: allow): each word with every host form, on two paths of its kind or of both."""
    rows = []
    for label, words, own in ((0.0, BLOCK_WORDS, BLOCK_PATHS), (1.0, ALLOW_WORDS, ALLOW_PATHS)):
        for k, word in enumerate(words):
            for f, form in enumerate(HOSTS):
                number = 1000 + 7919 * (k * len(HOSTS) + f) % 9000
                rows.append((word, form.format(word), BOTH_PATHS[(k + f) % len(BOTH_PATHS)].format(number), label))
                if f % 2 == k % 2:
                    rows.append((word, form.format(word), own[(k + f) % len(own)].format(number), label))
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{w}', '{h}', '{p}', {y}D)" for w, h, p, y in rows) + " AS t(word, host, path, label)")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and the path; both empty for a null URL or one without ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct of ``rule`` and ``verdict`` of the longest rule that fits, or null. Of equal lengths the first in the order of text wins."""
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        value = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def grams(host: str = "host", path: str = "path", slots: int = SLOTS) -> Column:
    """Distinct slots of the character n-grams of ``^host$`` and ``^path$``; host and path have their own grams."""
    parts = []
    for name in (host, path):
        marked = f"concat('^', {name}, '$')"
        for size in SIZES:
            count = f"greatest(char_length({marked}) - {size - 1}, 1)"
            parts.append(
                f"transform(sequence(1, {count}), i -> CAST(pmod(xxhash64('{name}', substring({marked}, i, {size})), {slots}) AS INT))"
            )
    return F.expr(f"array_distinct(concat({', '.join(parts)}))")


def logit(weights: list[float], bias: float, slots: str) -> Column:
    # A cast of one text is folded to one literal; thousands of literals would be planned each.
    values = "CAST(split('" + ",".join(f"{w:.12e}" for w in weights) + "', ',') AS ARRAY<DOUBLE>)"
    return F.expr(f"aggregate({slots}, CAST({bias:.12e}D AS DOUBLE), (a, s) -> a + {values}[s])")


class Model(NamedTuple):
    weights: list[float]
    bias: float


def train(labelled: DataFrame, steps: int = STEPS, max_per_label: int = MAX_PER_LABEL) -> Model:
    """Fit on ``labelled`` (host, path, label 0.0 or 1.0), at most ``max_per_label`` distinct rows of each label.

    Rows are chosen by a hash of host and path. Both labels weigh the same in all;
    with no row of one label, or none at all, the model decides by what there is.
    """
    small = None
    known = labelled.select("host", "path", F.col("label").cast("double").alias("label")).distinct()
    for label in (0.0, 1.0):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("host", "path"), "host", "path").limit(max_per_label)
        small = part if small is None else small.unionByName(part)
    rows = staged(small.select("label", grams().alias("slots")).coalesce(2), "url-labels")
    count = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weights, bias, squares, bias_square = [0.0] * SLOTS, 0.0, [1e-8] * SLOTS, 1e-8
    share = {label: 0.5 / max(count.get(label, 0), 1) for label in (0.0, 1.0)}
    weight = F.when(F.col("label") == 1.0, share[1.0]).otherwise(share[0.0])
    for _ in range(steps if count else 0):
        residual = weight * (F.lit(1.0) / (F.lit(1.0) + F.exp(-logit(weights, bias, "slots"))) - F.col("label"))
        sums = (
            rows.select(residual.alias("r"), F.explode(F.concat("slots", F.array(F.lit(-1)))).alias("slot"))
            .groupBy("slot")
            .agg(F.sum("r").alias("g"))
            .collect()
        )
        for slot, g in sums:
            if slot < 0:
                bias_square += g * g
                bias -= RATE * g / bias_square**0.5
                continue
            g += DECAY * weights[slot]
            squares[slot] += g * g
            weights[slot] -= RATE * 0.2 * g / squares[slot] ** 0.5
    return Model(weights, bias)


def judged(pages: DataFrame, rules: tuple[Rule, ...], url: str = "url", model: Model | None = None) -> DataFrame:
    """``page`` (the whole row), ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (probability of allow; null under a rule).

    Without ``model`` it learns from ``labelled_urls``. Null URLs have empty host and path and are judged like any other; each row of the
    input gives one row.
    """
    host, path = host_and_path(F.col(url))
    parsed = pages.select(F.struct("*").alias("page"), host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    if model is None:
        model = train(labelled_urls(pages.sparkSession))
    known = parsed.withColumn("slots", F.when(F.col("found").isNull(), grams()))
    scored = known.withColumn("z", logit(model.weights, model.bias, "slots"))
    return scored.select(
        "page",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.when(F.col("z") >= 0, "allow").otherwise("block")).alias("verdict"),
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("z")))).alias("score"),
    )
