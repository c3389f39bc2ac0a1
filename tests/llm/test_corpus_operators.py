"""Importance resampling, source mixing and the Merkle manifest against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from barloom.llm import importance, manifest, mixing
from tests.llm import cases


# --- importance resampling ---------------------------------------------------------------


def runs(text, lowest, highest):
    w = re.findall(importance.WORD, (text or "").translate(str.maketrans(importance.UPPER, importance.LOWER)))
    return w, [" ".join(w[i : i + n]) for n in range(lowest, highest + 1) for i in range(len(w) - n + 1)]


def expected_draw(texts, target, percent, least, seed, lowest, highest, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    split = [runs(t, lowest, highest) for _, t in texts]
    s = Counter(bucket(f) for _, fs in split for f in fs)
    t = Counter(bucket(f) for x in target for f in runs(x, lowest, highest)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for (key, _), (w, fs) in zip(texts, split):
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(w), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = able[: len(able) * percent // 100]
    left = Counter(rows) - Counter(drawn)
    return Counter([(*r, i + 1) for i, r in enumerate(drawn)]) + Counter({(*r, None): n for r, n in left.items()})


@pytest.mark.parametrize("lowest, highest, percent", [(1, 1, 10), (1, 2, 35), (2, 3, 100)])
def test_draw_matches_plain_python(spark, lowest, highest, percent):
    texts = [(k, cases.prose(k, 5 + 3 * k)) for k in range(60)] + cases.odd_texts() + [(70, cases.prose(9, 60))] * 3
    target = [cases.prose(900 + k, 30) for k in range(4)] + [None, ""]
    want = expected_draw(texts, target, percent, 20, 2024, lowest, highest, 500)
    aims = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = importance.resampled(cases.frame(spark, texts), aims, percent=percent, lowest=lowest, highest=highest, buckets=500, pivots=3)
    assert Counter(map(tuple, got.collect())) == want


def test_draw_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.resampled(cases.empty(spark), none).count() == 0
    few = importance.resampled(cases.frame(spark, [(1, "a b"), (2, None)]), none).collect()
    assert [(r.doc_id, r.n_features, r["rank"]) for r in sorted(few)] == [(1, 2, None), (2, 0, None)]
    assert {r.weight for r in few if r.n_features == 0} == {0}


def test_quickselect_finds_every_place_among_ties(spark):
    rows = spark.range(300).select((F.col("id") % 5).alias("a"), F.col("id").alias("b"))
    ordered = sorted((k % 5, k) for k in range(300))
    for k in (1, 2, 61, 150, 299, 300):
        found = importance.kth(rows, F.struct("a", "b"), k, pivots=2, seed=k)
        assert tuple(found) == ordered[k - 1]


# --- mixing ------------------------------------------------------------------------------


def poured(sizes, weights, passes):
    """Targets by sharing again and again what is above the stops."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in stopped]
        rest = total - sum(passes * sizes[s] for s in stopped)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > passes * sizes[s]}
        if not over:
            return {s: share.get(s, passes * sizes[s]) for s in names}
        stopped |= over


def source_texts(spark):
    rows = []
    for k in range(150):
        source = ["big", "big", "big", "Zed", "été", "small", None][k % 7]
        rows.append((k, cases.prose(k, 4 if source == "small" else 20 + k % 90), "en", source, 1, 0.5, "x", "y"))
    rows += [(1, cases.prose(1, 30), "en", "big", 1, 0.5, "x", "y")] * 3
    rows += [(None, cases.prose(2, 40), "en", "big", 1, 0.5, "x", "y"), (400, None, "en", "big", 1, 0.5, "x", "y"), (401, " \t", "en", "blank", 1, 0.5, "x", "y")]
    rows += [(500, cases.prose(3, 4000), "en", "Zed", 1, 0.5, "x", "y")]
    return rows, spark.createDataFrame(rows, cases.SCHEMA)


def test_targets_match_repeated_sharing(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 4, None: 90}, {"a": 5}, {"a": 0, "b": 7, "c": 1}, {"a": 0}, {k: ord(k) ** 3 % 97 for k in "abcdefghijk"}):
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(frame).collect()}
        assert got == pytest.approx(poured(sizes, (5, 2, 1), 3))


def test_mix_takes_whole_turns(spark):
    rows, docs = source_texts(spark)
    mix, known = mixing.mixed(docs, block_words=8, shard_slots=64)
    pieces, docs_out = mix.collect(), mixing.taken(mix, known).collect()
    size = lambda t: len(cases.WORD.findall(t or ""))
    assert Counter((r.key, r.source, r.size) for r in docs_out) == Counter((r[0], r[3], size(r[1])) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    target = poured(sizes, (5, 2, 1), 3)
    taken = Counter()
    for r in docs_out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 12 for s in sizes)
    # Every slot of every shard is filled once, with one block of whole pieces.
    slots = defaultdict(list)
    for p in pieces:
        slots[p.shard, p.slot].append(p)
    full, last = divmod(len(slots), 64)
    assert set(slots) == {(s, k) for s in range(full + 1) for k in range(64 if s < full else last)}
    streams = {(s, b, n) for s, b, n in ((ps[0].source, ps[0].block, sum(p.words for p in ps)) for ps in slots.values())}
    assert all(len({(p.source, p.block, p["pass"]) for p in ps}) == 1 for ps in slots.values())
    assert all(n == 8 or b == (sizes[s] - 1) // 8 for s, b, n in streams)
    # Passes are whole before the next begins.
    uses = Counter((ps[0].source, ps[0].block) for ps in slots.values())
    for s in sizes:
        blocks = -(-sizes[s] // 8)
        counts = [uses[s, b] for b in range(blocks)]
        assert not counts or max(counts) - min(counts) <= 1
    again = mixing.mixed(docs, block_words=8, shard_slots=64)[0]
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, pieces))


def test_shards_draw_sources_by_their_shares(spark):
    table = spark.createDataFrame([(0, 6000), (1, 3000), (2, 1000), (3, 0)], "number long, quota long")
    drawn = mixing.draws(table, 10_000, 500)
    cells = {(r.shard, r.number): r.n for r in drawn.collect()}
    shares = {0: 0.6, 1: 0.3, 2: 0.1}
    assert {n for _, n in cells} == {0, 1, 2}
    for shard in range(20):
        assert sum(cells.get((shard, n), 0) for n in shares) == 500
    # Counts of 20 shards against the multinomial: chi-squared with 40 degrees of freedom.
    chi = sum((cells.get((s, n), 0) - 500 * p) ** 2 / (500 * p) for s in range(20) for n, p in shares.items())
    assert 15 < chi < 80
    turns = mixing.settled(drawn, table).collect()
    assert sorted((r.number, r.turn) for r in turns) == [(n, t) for n, q in ((0, 6000), (1, 3000), (2, 1000)) for t in range(q)]
    assert Counter(r.shard for r in turns) == {s: 500 for s in range(20)}


@pytest.mark.parametrize("blocks", [1, 2, 7, 100, 1000])
def test_permutations_are_one_to_one_and_scattered(spark, blocks):
    laps = spark.createDataFrame([(s, blocks) for s in range(3)], "stream long, blocks long").withColumn("points", mixing.points("blocks", "stream"))
    rows = laps.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumn("to", mixing.permuted("at", "blocks", "points", "stream")).collect()
    maps = defaultdict(dict)
    for r in rows:
        maps[r.stream][r["at"]] = r.to
    for to in maps.values():
        assert sorted(to.values()) == list(range(blocks))
    if blocks >= 100:
        assert len({tuple(to[k] for k in range(blocks)) for to in maps.values()}) == 3
        for to in maps.values():
            fixed = sum(k == v for k, v in to.items())
            near = sum(abs(to[k + 1] - to[k]) == 1 for k in range(blocks - 1))
            assert fixed < 12 and near < 12


def test_mix_of_nothing(spark):
    mix, known = mixing.mixed(cases.empty(spark))
    assert mix.count() == 0 and mixing.taken(mix, known).count() == 0
    mix, known = mixing.mixed(cases.frame(spark, [(1, None), (2, " ")]))
    assert [tuple(r) for r in mixing.taken(mix, known).select("key", "size", "target", "taken").orderBy("key").collect()] == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


# --- Merkle manifest ---------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fan_out):
    """The root and, per leaf, its siblings on each level as (left, right)."""
    paths, members = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, groups = [], []
        for at in range(0, len(nodes), fan_out):
            run = nodes[at : at + fan_out]
            for k in range(len(run)):
                for m in members[at + k]:
                    paths[m].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha("".join(run)))
            groups.append([m for k in range(len(run)) for m in members[at + k]])
        nodes, members = up, groups
    return nodes[0], paths


def expected_manifest(rows, fan_out):
    groups = defaultdict(list)
    for r in rows:
        leaf = leaf_of((r[0], r[3], r[2], r[4], r[1]))
        groups[r[2]].append((r[0], leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([leaf for _, leaf in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))], fan_out) for g in order}
    root, tops = climb([trees[g][0] for g in order], fan_out)
    want = Counter()
    for g, top in zip(order, tops):
        for (key, leaf), path in zip(sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1])), trees[g][1]):
            want[key, g, leaf, trees[g][0], root, tuple(path + top)] += 1
    return want


@pytest.mark.parametrize("fan_out, levels, count", [(2, 10, 90), (2, 2, 70), (3, 2, 60), (2, 3, 8), (2, 3, 1)])
def test_manifest_matches_plain_python(spark, fan_out, levels, count):
    langs = ["en", "en", "en", "de", None, "été", "EN"]
    rows = [(k * 37 % 101, cases.prose(k, 12), langs[k % 7], "s" if k % 3 else None, None if k % 5 == 0 else k, 0.5, "x", "y") for k in range(count)]
    if count > 50:
        rows += rows[:3] * 2 + [(None, "no key", "en", "s", 1, 0.5, "x", "y"), (7, None, "en", "s", 1, 0.5, "x", "y"), (8, "", "de", "s", 1, 0.5, "x", "y")]
        rows += [(9, cases.prose(4, 30_000) + " 雪\U0001f600", "solo", "s", 1, 0.5, "x", "y")]
    got = manifest.manifest(spark.createDataFrame(rows, cases.SCHEMA), fan_out=fan_out, levels=levels)
    found = Counter((r.doc_id, r.lang, r.leaf, r.subroot, r.root, tuple((p.l, p.r) for p in r.path)) for r in got.collect())
    assert found == expected_manifest(rows, fan_out)


def test_proofs_hold_and_tampering_shows(spark):
    rows = [(k, cases.prose(k, 9), ["en", "de", "fr"][k % 3], "s", None if k == 4 else k, 0.5, "x", "y") for k in range(50)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    hit = F.col("doc_id") % 4 == 0
    altered = [F.when(hit, F.col(c) + 1).otherwise(F.col(c)) if c == "n_chars" else F.col(c) for c in columns]
    out = manifest.manifest(docs, columns, altered=altered, levels=2)
    out = out.withColumn("found", manifest.folded(F.coalesce("altered_leaf", "leaf"), F.col("path"))).withColumn("proof", manifest.proof_digest(F.col("path")))
    for r in out.collect():
        assert (r.found == r.root) == (r.doc_id % 4 != 0 or r.doc_id == 4)
        assert r.proof == sha("".join(p.l + p.r for p in r.path))


def test_manifest_of_nothing(spark):
    assert manifest.manifest(cases.empty(spark)).count() == 0


def test_manifest_proofs_need_no_join(spark):
    """Rolling up and opening a tier: one exchange each, and no join."""
    rows = [("=a", 100, k, sha(str(k)), (k,)) for k in range(100)]
    nodes = spark.createDataFrame(rows, "group string, total long, index long, digest string, held struct<id long>")
    tiers = manifest.tree(nodes, 2, 3)
    tops = spark.createDataFrame([("=a", "s", [])], f"group string, subroot string, path {manifest.PATH}")
    plans = [manifest.rolled(nodes, 2, 3), manifest.proofs(tiers[:1], tops, 2, 3)]
    for df in plans:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in text and text.count("Exchange ") == 1
