"""Jaccard join, components, decontamination, sharding, packing and the language model."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import components, decontamination, jaccard_join, packing, pitman_yor, sharding, wordhash
from barloom.llm.queries import remainder
from tests.llm import cases


def changed(text, share, rng):
    w = text.split()
    for k in rng.sample(range(len(w)), int(len(w) * share)):
        w[k] = "zz" + str(rng.randint(0, 10**6))
    return " ".join(w)


def copy_texts():
    rng = random.Random(8)
    texts = [(k, cases.prose(k, rng.randint(6, 160))) for k in range(40)]
    base = cases.prose(77, 150)
    texts += [(100 + k, changed(base, share, rng)) for k, share in enumerate([0, 0, 0.007, 0.01, 0.013, 0.02, 0.02, 0.03, 0.05, 0.2])]
    passage = cases.prose(78, 60)
    texts += [(200 + k, cases.prose(300 + k, 60) + " " + passage) for k in range(25)]
    texts += [(300 + k, base.upper() if k % 2 else base + " tail") for k in range(4)]
    texts += [(400, "one two"), (401, "ONE\ttwo"), (402, "one two three"), (403, "two one")]
    chain = cases.prose(79, 100).split()
    texts += [(500 + k, " ".join(chain[3 * k :] + [f"x{j}" for j in range(3 * k)])) for k in range(8)]
    return texts


def test_jaccard_components_match_brute_force(spark):
    texts = copy_texts() + [t for t in cases.odd_texts() if t[0] is not None]
    want, sizes = cases.jaccard_components(texts)
    least = defaultdict(lambda: 10**9)
    for (key, _), c in zip(texts, want):
        least[c] = min(least[c], key)
    got = jaccard_join.linked(cases.frame(spark, texts)).collect()
    expected = Counter((key, n, least[c] if n else key) for (key, _), c, n in zip(texts, want, sizes))
    assert Counter(map(tuple, got)) == expected


def test_jaccard_null_keys_and_empty(spark):
    base = cases.prose(1, 50)
    got = jaccard_join.linked(cases.frame(spark, [(None, base), (5, base), (None, cases.prose(2, 50)), (None, "")]))
    assert Counter(map(tuple, got.collect())) == Counter({(None, 46, 5): 1, (5, 46, 5): 1, (None, 46, None): 1, (None, 0, None): 1})
    assert jaccard_join.linked(cases.empty(spark)).count() == 0


def link_chain(seed):
    """Three texts where only the middle one is linked with both others."""
    w = cases.prose(seed, 104).split()
    a, n, b = w[:100], w[1:101] + ["n1"], w[2:102] + [f"b{k}" for k in range(9)]
    return [" ".join(x) for x in (a, n, b)]


def group_cases():
    """Documents of seven cases with texts and keys of their own: named and unnamed middles of chains, keys of two texts."""
    texts = []
    for k, keys in enumerate([(1, 2, 3), (1, None, 3), (9, None, 5), (None, None, None)]):
        chain = link_chain(21 + k)
        texts += [(None if key is None else 100 * k + key, t) for key, t in zip(keys, chain)]
        texts += [(None, chain[1])] * (k == 1) + [(209, chain[2])] * (k == 2)
    a, _, _ = link_chain(30)
    other = cases.prose(31, 60)
    texts += [(503, a), (507, a + " tail"), (507, other), (509, other + " more")]
    a, _, _ = link_chain(32)
    other = cases.prose(33, 60)
    texts += [(607, a), (607, other), (607, a), (609, other + " more"), (None, other), (608, None), (608, None), (None, ""), (None, "")]
    return texts


def test_null_and_repeated_keys_match_brute_force(spark):
    texts = group_cases()
    group, sizes = cases.jaccard_components(texts)
    least = {g: min((k for (k, _), h in zip(texts, group) if h == g and k is not None), default=None) for g in group}
    want = Counter((key, n, (least[g] if n else key)) for (key, _), g, n in zip(texts, group, sizes))
    docs = cases.frame(spark, texts)
    assert Counter(map(tuple, jaccard_join.linked(docs, max_broadcast=0).collect())) == want
    kept = [(r.doc_id, r.text) for r in jaccard_join.representatives(docs).collect()]
    of_text = {t: g for (_, t), g in zip(texts, group)}
    named = [(k, t) for k, t in kept if (t or "").strip()]
    # Every group keeps one row, that of its smallest key.
    assert sorted(of_text[t] for _, t in named) == sorted({g for g, n in zip(group, sizes) if n})
    assert all(k == least[of_text[t]] for k, t in named)
    blank = [(k, t) for k, t in texts if not (t or "").strip()]
    once = [x for x in blank if x[0] is None] + list({x for x in blank if x[0] is not None})
    assert Counter((k, t) for k, t in kept if not (t or "").strip()) == Counter(once)


def test_jaccard_without_broadcast(spark):
    docs = cases.frame(spark, copy_texts())
    assert Counter(map(tuple, jaccard_join.linked(docs, max_broadcast=0).collect())) == Counter(map(tuple, jaccard_join.linked(docs).collect()))


def test_components_of_a_long_chain(spark):
    order = list(range(60))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {k: 0 for k in range(60)} | {100: 100, 101: 100}


def test_prefix_bounds_lose_no_link(spark):
    """Over all sizes: linked sets share what the first step asks for, and both forms of the bound agree."""
    n = np.arange(1, 900)
    asked = jaccard_join.least_shared(n)
    spare = jaccard_join.prefix_size(n) - (n - jaccard_join.least_overlap(n))
    for size in n:
        for other in range(int(jaccard_join.least_overlap(size)), size + 1):
            assert min(spare[size - 1], spare[other - 1]) >= max(asked[size - 1], asked[other - 1])
    got = spark.range(1, 900).select(jaccard_join._least_shared(F.col("id")).alias("g")).toPandas()["g"]
    assert got.tolist() == asked.tolist()


def test_word_hash_blocks_do_not_depend_on_their_size():
    import pyarrow as pa

    texts = pa.array([t for _, t in cases.odd_texts()])
    small = [(w.first_row + w.row, w.hash) for w in wordhash.blocks(texts, 50)]
    large = [(w.first_row + w.row, w.hash) for w in wordhash.blocks(texts)]
    assert all(np.array_equal(np.concatenate([s[k] for s in small]), np.concatenate([b[k] for b in large])) for k in (0, 1))
    assert [len(cases.words(t)) for t in texts.to_pylist()] == np.bincount(np.concatenate([b[0] for b in large]), minlength=len(texts)).tolist()


def planted():
    rng = random.Random(2)
    items = [(k, cases.prose(1000 + k, rng.randint(15, 45), 3000)) for k in range(12)]
    docs = [(k, cases.prose(k, 120)) for k in range(30)]
    want = set()
    for k, (item, text) in enumerate(items):
        w = text.split()
        for share in (0.0, 0.1, 0.15):
            key = 1000 + 10 * k + int(share * 100) // 5
            copy = changed(" ".join(w), share, rng).split()
            docs.append((key, " ".join(cases.prose(key, 40).split() + copy + cases.prose(key + 1, 40).split())))
            equal = [a == b for a, b in zip(w, copy)]
            if max(sum(equal[i : i + 13]) for i in range(len(w) - 12)) >= 10:
                want.add((key, item))
    return docs, items, want


def test_leaks_with_substitutions(spark):
    docs, items, want = planted()
    more = docs + [(5000, None), (5001, ""), (None, items[0][1]), (1000, cases.prose(1, 30)), (5002, items[1][1]), (5003, "Intro " + items[2][1].upper())]
    bench = spark.createDataFrame([*items, (50, None), (51, "too short"), (None, items[3][1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(cases.frame(spark, more), bench).collect()}
    assert got <= want | {(5002, 1), (5003, 2)}
    assert {(5002, 1), (5003, 2)} <= got
    assert len(got & want) >= 0.97 * len(want)
    far = {(r.doc_id, r.item_id) for r in decontamination.leaks(cases.frame(spark, more), bench, max_broadcast=0).collect()}
    assert far == got


def test_leaks_of_every_length_and_place_match_brute_force(spark):
    """Items of 1 to 14 words with every set of substitutions, inside a document and cut off at its edges."""
    rng = random.Random(12)
    items = [(n, [f"i{n}w{k}" for k in range(n)]) for n in range(1, 15)]
    docs = []
    for n, w in items:
        allowed = n - -(-min(n, 13) * 10 // 13)
        for places in (p for size in range(min(allowed + 1, n) + 1) for p in combinations(range(n), size)):
            if len(places) > 2 and n > 7 and places != (4, 5, 6) and rng.random() < 0.7:
                continue
            copy = [f"x{k}" if k in places else v for k, v in enumerate(w)]
            docs += [["p", *copy, "q"], copy]
        for cut in range(1, min(allowed + 2, n)):
            docs += [w[cut:], w[:-cut], [*w[cut:], "q", "r"], ["p", "q", *w[:-cut]]]
    want = set()
    for key, doc in enumerate(docs):
        for n, w in items:
            for diagonal in range(1 - n, len(doc)):
                equal = [0 <= k + diagonal < len(doc) and doc[k + diagonal] == v for k, v in enumerate(w)]
                if max(sum(equal[i : i + 13]) for i in range(n)) >= -(-min(n, 13) * 10 // 13):
                    want.add((key, n))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items] + [(99, " ")], "item_id long, text string")
    found = decontamination.leaks(cases.frame(spark, [(k, " ".join(d)) for k, d in enumerate(docs)]), bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_clean_keeps_whole_rows_and_unnamed_ones(spark):
    docs, items, want = planted()
    frame = cases.frame(spark, [*docs, (None, items[0][1]), (6000, None)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    left = decontamination.clean(frame, bench)
    assert left.columns == frame.columns
    kept = {r.doc_id for r in left.collect()}
    assert {None, 6000, *range(30)} <= kept and not {1000 + 10 * k for k in range(12)} & kept
    assert decontamination.clean(frame, bench.limit(0)).count() == frame.count()
    assert decontamination.leaks(cases.empty(spark), bench).count() == 0


def test_sharding_is_even_gapless_and_keeps_groups(spark):
    texts = [(k, cases.prose(k, 12)) for k in range(300)] + [(1000 + k, "big group") for k in range(160)]
    texts += [(2000 + k, f"pair {k // 4}") for k in range(120)] + cases.odd_texts() + [(1, None)]
    docs = cases.frame(spark, texts)
    placed = sharding.sharded(docs, shards=7)
    rows = placed.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 8, cases.zlib.crc32((t or "").encode())) for i, t in texts)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(7):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    # 160 equal texts do not fit a shard of about 85; the small groups stay whole.
    small = placed.where("doc_id BETWEEN 2000 AND 2119")
    assert sharding.cut_links(small, F.col("text_crc32")).first().cut <= 6
    big = Counter(r.shard for r in rows if 1000 <= (r.doc_id or 0) < 1160)
    assert max(big.values()) >= 60


def test_sharding_of_rows_that_are_equal_in_everything(spark):
    docs = cases.frame(spark, [(None, "same")] * 4000 + [(7, "other")] * 1500 + [(k, f"t{k}") for k in range(500)])
    rows = sharding.sharded(docs, shards=5).collect()
    counts = Counter(r.shard for r in rows)
    assert counts == {s: 1200 for s in range(5)}
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(1200)) for s in range(5))


def test_running_sums_and_walk(spark):
    row = spark.sql("SELECT array(3L, 0L, 5L, 2L) AS held").select(sharding.running("held").alias("ends")).first()
    assert row.ends == [3, 3, 8, 10]


def least_cut(groups, rows, shards):
    """By trying every way to give each group a home shard: members that do not fit at home, at best."""
    from itertools import product

    quota = [rows // shards + (s < rows % shards) for s in range(shards)]
    best = rows
    for homes in product(range(shards), repeat=len(groups)):
        room, cut = quota[:], 0
        for size, s in sorted(zip(groups, homes), reverse=True):
            at_home = min(size, room[s])
            room[s] -= at_home
            cut += size - at_home
        best = min(best, cut)
    return best


def test_cut_links_against_brute_force_on_small_graphs(spark):
    found = best = 0
    for seed, sizes in enumerate([(5, 4, 3, 3), (9, 2, 2, 2), (4, 4, 4, 4), (6, 5, 1), (12, 3, 3, 2)]):
        texts = [(100 * seed + 10 * g + k, f"group {seed} {g}") for g, n in enumerate(sizes) for k in range(n)]
        texts += [(5000 + 100 * seed + k, f"alone {seed} {k}") for k in range(12)]
        placed = sharding.sharded(cases.frame(spark, texts), shards=3)
        linked = placed.where(F.col("doc_id") < 5000)
        found += sharding.cut_links(linked, F.col("text_crc32")).first().cut
        best += least_cut(sizes, len(texts), 3)
    assert best <= found <= best + 4


def test_sharding_of_few_rows(spark):
    assert sharding.sharded(cases.empty(spark)).count() == 0
    rows = sharding.sharded(cases.frame(spark, [(1, "a"), (2, "a"), (3, None)])).collect()
    assert all(n == 1 for n in Counter(r.shard for r in rows).values()) and all(r.slot == 0 for r in rows)


def test_tokenizer_gives_the_ids_of_the_file():
    from tokenizers import Tokenizer

    held = Tokenizer.from_file(packing.default_tokenizer())
    own = packing.Tokenizer(packing.default_tokenizer())
    for text in ["", " ", "a<|endoftext|>b  c", "naïve 雪\u200b\n\n\t x  ", "\x00\x01 é́ \U0001f600", *(t or "" for _, t in cases.odd_texts())]:
        assert own.ids(text).tolist() == held.encode(text, add_special_tokens=False).ids


def brute_cost(positions, penalty, window):
    best = [0.0] + [math.inf] * (len(positions) - 1)
    for j in range(1, len(positions)):
        for i in range(j):
            size = positions[j] - positions[i]
            if size <= window:
                pad = 0 if size & (size - 1) == 0 else window - size
                best[j] = min(best[j], best[i] + pad + packing.PRICE + penalty[j])
    return best[-1]


def test_monotone_queue_finds_the_least_cost():
    rng = np.random.default_rng(5)
    for _ in range(40):
        total = int(rng.integers(1, 900))
        ends = np.unique(rng.integers(1, total + 1, rng.integers(1, 40)))
        positions, penalty = packing.cut_points(ends, np.unique([*rng.choice(ends, min(5, len(ends))), total]), total, 64)
        cuts = packing.best_cuts(positions, penalty, 64)
        assert cuts[0] == 0 and cuts[-1] == total and max(np.diff(cuts)) <= 64
        cost = 0.0
        for a, b in zip(cuts, cuts[1:]):
            cost += (0 if (b - a) & (b - a - 1) == 0 else 64 - (b - a)) + packing.PRICE + penalty[np.searchsorted(positions, b)]
        assert cost == pytest.approx(brute_cost(positions.tolist(), penalty.tolist(), 64))


def test_text_without_sentence_ends_is_packed_as_tightly():
    for size in (600, 700, 1100, 2100):
        ends = np.arange(size, 60 * size + 1, size)
        positions, penalty = packing.cut_points(np.zeros(0, dtype=np.int64), ends, int(ends[-1]), packing.WINDOW)
        cuts = packing.best_cuts(positions, penalty)
        lengths = np.diff(cuts)
        assert max(lengths) <= packing.WINDOW
        padding = sum(0 if n & (n - 1) == 0 else packing.WINDOW - n for n in lengths.tolist())
        assert padding < 0.05 * ends[-1]


def test_sentence_marks_of_other_scripts():
    own = packing.Tokenizer(packing.default_tokenizer())
    for text in ("\u5929\u5730\u7384\u9ec4\u3002\u5b87\u5b99", "\u0645\u0631\u062d\u0628\u0627\u061f \u0646\u0639\u0645", "\u0928\u092e\u0938\u094d\u0924\u0947\u0964 \u0915"):
        ids = own.ids(text)
        ends = own.sentence_ends(ids).tolist()
        assert len(ends) == 1 and own.core.decode(ids[: ends[0]].tolist())[-1] in packing.MARKS
    assert own.sentence_ends(own.ids("\u5929\u5730 plain")).tolist() == []


def test_packing_round_trip(spark):
    import zlib

    texts = cases.odd_texts() + [(50 + k, cases.prose(k, 300)) for k in range(60)] + [(999, "x" * 9000)]
    own = packing.Tokenizer(packing.default_tokenizer())
    pieces = packing.packed(cases.frame(spark, texts).repartition(3), packing.default_tokenizer()).collect()
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    padding = total = 0
    for held in sequences.values():
        held.sort(key=lambda p: p.offset)
        size = sum(p.length for p in held)
        assert [p.offset for p in held] == [sum(q.length for q in held[:k]) for k in range(len(held))] and size <= 1024
        padding += 0 if size & (size - 1) == 0 else 1024 - size
        total += size
    assert padding < 0.05 * total
    unique = {i: t for i, t in texts if i not in (None, 7)}
    for key, text in unique.items():
        ids = np.append(own.ids(text or ""), np.uint32(0)).astype("<u4")
        held = sorted((p for p in pieces if p.doc_id == key), key=lambda p: p.start)
        assert [p.start for p in held] == [sum(q.length for q in held[:k]) for k in range(len(held))]
        assert sum(p.length for p in held) == len(ids) == held[0].doc_tokens
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in held)
    assert packing.packed(cases.empty(spark), packing.default_tokenizer()).count() == 0


@pytest.fixture(scope="module")
def lm_texts():
    return [(k, cases.prose(k % 37, 60 + k % 50)) for k in range(160)] + cases.odd_texts()


def test_language_model_figures(spark, lm_texts):
    docs = cases.frame(spark, lm_texts)
    learns = F.coalesce(remainder("doc_id", 5) != 1, F.lit(True))
    model = pitman_yor.train(docs, learns)
    got = pitman_yor.scored(docs, model, learns).collect()
    train = [t for i, t in lm_texts if i is None or cases.crc(i) % 5 != 1]
    counts = Counter(w for t in train for w in [*cases.words(t), None])
    n, v = sum(counts.values()), len(counts)
    assert (model.fixed.tokens, model.fixed.words) == (n, v)

    def figures(i, t):
        tokens = [*cases.words(t), None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        return (i is None, i or 0, i is not None and cases.crc(i) % 5 == 1, len(tokens), sum(counts[w] > 0 for w in tokens), round(base, 6))

    have = sorted((r.doc_id is None, r.doc_id or 0, not r.learned, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got)
    assert have == sorted(figures(i, t) for i, t in lm_texts)
    held = [r for r in got if not r.learned]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    again = pitman_yor.scored(docs.repartition(5), model, learns).collect()
    assert sorted((r.doc_id or -1, round(r.score, 6)) for r in again) == sorted((r.doc_id or -1, round(r.score, 6)) for r in got)


def test_language_model_probabilities_sum_to_one(spark, lm_texts):
    """Every known word and one unknown, as the first word of a text: the end's share is taken from an empty text."""
    docs = cases.frame(spark, lm_texts)
    model = pitman_yor.train(docs, F.lit(True))
    words = sorted({w for _, t in lm_texts for w in cases.words(t)}) + ["never-seen"]
    asked = cases.frame(spark, [(k, w) for k, w in enumerate(words)] + [(10**6, "")])
    scores = [r.score for r in pitman_yor.scored(asked, model, F.lit(False)).collect()]
    first = pitman_yor_first_token(docs, model)
    assert sum(first.values()) == pytest.approx(1.0, abs=1e-6)
    assert all(s < 0 for s in scores)


def test_language_model_scores_a_table_of_its_own(spark, lm_texts, monkeypatch):
    """A text has the same scores beside the texts that the model learned from, alone, and in more buckets."""
    docs = cases.frame(spark, lm_texts + [(2000 + k, "the same sentence again and again") for k in range(40)])
    model = pitman_yor.train(docs, F.lit(True))
    asked = [(10**6, "the same sentence again and again"), (10**6 + 1, cases.prose(3, 70)), (10**6 + 2, "never seen words"), (10**6 + 3, None)]
    alone = cases.frame(spark, asked)

    def scores(df):
        rows = pitman_yor.scored(df, model, F.col("doc_id") < 10**6).where("doc_id >= 1000000").collect()
        return {r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in rows}

    beside, own = scores(docs.unionByName(alone)), scores(alone)
    assert beside == own and len(own) == 4
    assert own[10**6][3] > own[10**6][2] + 2  # learned forty times
    monkeypatch.setattr(pitman_yor, "BUCKET_CHARS", 2)
    assert scores(alone) == own


def pitman_yor_first_token(both, model):
    """Probability of each token of the vocabulary, and of one unknown, at the start of a text, from the model's own tables."""
    fixed, history, buckets, seats = model
    import pyarrow as pa

    held = seats.toArrow()
    every = set()
    for r in both.select("text").collect():
        for block in wordhash.blocks(pa.array([r.text])):
            every.update(pitman_yor.tokens_of(block).word.tolist())
    word, context = np.array(sorted(every), dtype=np.uint64), np.zeros(len(every), dtype=np.int64)
    bucket = pitman_yor.bucket_of(word, context, fixed.hot, buckets)
    out = {}
    for b in np.unique(bucket):
        own = bucket == b
        of_bucket = pitman_yor._held_seats(held.filter(pa.compute.equal(held.column("bucket"), pa.scalar(int(b), pa.int32()))))
        logs, _, _ = pitman_yor._pair_scores(word[own], context[own], of_bucket, fixed, history)
        out.update(zip(word[own].tolist(), 10**logs))
    unknown = np.array([np.uint64(12345)])
    nothing = pitman_yor._held_seats(held.slice(0, 0))
    out["unknown"] = 10 ** pitman_yor._pair_scores(unknown, np.zeros(1, dtype=int), nothing, fixed, history)[0][0]
    return out


def test_language_model_tells_words_of_one_ending_apart(spark):
    """The context is the whole word before, also where its last letters are those of another."""
    docs = cases.frame(spark, [(k, "creation follows" if k % 2 else "relation precedes") for k in range(60)])
    model = pitman_yor.train(docs, F.lit(True))
    asked = ["creation follows", "creation precedes", "relation precedes", "relation follows"]
    rows = pitman_yor.scored(cases.frame(spark, list(enumerate(asked))), model, F.lit(False)).collect()
    score = {asked[r.doc_id]: r.score for r in rows}
    assert score["creation follows"] > score["creation precedes"] + 1 and score["relation precedes"] > score["relation follows"] + 1


def test_language_model_probabilities_after_a_word_sum_to_one(spark, lm_texts, monkeypatch):
    """p(w | u) from the scores of the texts "u w", "w" and "u"; with words in the short list and with none."""
    docs = cases.frame(spark, lm_texts)
    words = sorted({w for _, t in lm_texts for w in cases.words(t)}) + ["never-seen"]
    for share in (pitman_yor.HOT_SHARE, 2.0):
        monkeypatch.setattr(pitman_yor.hot_words, "__defaults__", ("text", share, pitman_yor.HOT_SAMPLE))
        model = pitman_yor.train(docs, F.lit(True))
        assert (len(model.fixed.hot) == 0) == (share > 1)
        first = pitman_yor_first_token(docs, model)

        def at_start(word):
            import pyarrow as pa

            return math.log10(first.get(int(next(iter(wordhash.blocks(pa.array([word])))).hash[0]), first["unknown"]))

        for u in (words[0], words[len(words) // 2], "never-seen"):
            asked = [*words, *(f"{u} {w}" for w in words)]
            rows = pitman_yor.scored(cases.frame(spark, list(enumerate(asked))), model, F.lit(False)).collect()
            score = {asked[r.doc_id]: r.score for r in rows}
            after = [10 ** (score[f"{u} {w}"] - score[w] + at_start(w) - at_start(u)) for w in words]
            assert sum(after) + 10 ** (score[u] - at_start(u)) == pytest.approx(1.0, abs=1e-5)


def test_seating_of_few_customers_has_the_right_mean():
    """Two customers share a table unless the second opens one."""
    rng = np.random.default_rng(0)
    t = pitman_yor.seated(np.full(200_000, 2), np.full(200_000, 0.3), 0.4, rng)
    assert t.mean() == pytest.approx(1 + 0.3 / (0.3 + 1 - 0.4), abs=0.01)
    many = pitman_yor.seated(np.full(50, 100_000), np.full(50, 2.0), 0.5, rng)
    assert ((many >= 1) & (many <= 100_000)).all()


def tables_by_dynamic_programming(customers, new_table, discount):
    """The exact distribution of tables: customers sit down one after another."""
    p = np.zeros(customers + 1)
    p[1] = 1.0
    t = np.arange(customers + 1)
    for n in range(1, customers):
        opens = new_table / (new_table + n - discount * np.minimum(t, n))
        p, moved = p * (1 - opens), p * opens
        p[1:] += moved[:-1]
    return (p * t).sum(), math.sqrt((p * t**2).sum() - (p * t).sum() ** 2)


@pytest.mark.parametrize("customers, new_table, discount", [(3, 0.5, 0.3), (20, 2.0, 0.7), (150, 30.0, 0.5), (255, 0.01, 0.9), (1500, 5.0, 0.6), (6000, 100.0, 0.4)])
def test_seating_matches_the_exact_distribution(customers, new_table, discount):
    """One by one up to 256 customers; the steps beyond stay within one part in fifty of the exact mean."""
    mean, spread = tables_by_dynamic_programming(customers, new_table, discount)
    drawn = pitman_yor.seated(np.full(4000, customers), np.full(4000, new_table), discount, np.random.default_rng(7))
    assert drawn.mean() == pytest.approx(mean, abs=5 * spread / math.sqrt(4000) + (0.02 * mean if customers > pitman_yor.ONE_BY_ONE else 0))
    assert drawn.std() == pytest.approx(spread, rel=0.1 if customers <= pitman_yor.ONE_BY_ONE else 0.3)


def test_packed_arrays_come_back():
    arrays = [
        np.array([0, 3, 255], dtype=np.int64), np.array([70_000, 1]), np.array([2**64 - 1, 0], dtype=np.uint64),
        np.zeros(0, dtype=np.int32), np.array([-1.5, np.inf, 0.1]), np.array([2.5], dtype=np.float32),
    ]
    back = pitman_yor.unpacked(pitman_yor.packed(*arrays))
    assert [a.tolist() for a in back] == [a.tolist() for a in arrays]
    assert [a.itemsize for a in back] == [1, 4, 8, 1, 8, 4]


def test_language_model_takes_few_bytes_a_pair(spark, monkeypatch):
    """Names once by their hash, pairs by their places."""
    monkeypatch.setattr(pitman_yor, "LEAST_BUCKETS", 4)
    words = [f"w{k}" for k in range(300)]
    docs = cases.frame(spark, [(k, " ".join(words[(k * i) % 300] for i in range(1, 200))) for k in range(1, 300)])
    model = pitman_yor.train(docs, F.lit(True))
    texts = [r.text.split() for r in docs.collect()]
    pairs = {p for t in texts for p in zip(["", *t], [*t, None])}
    assert model.seats.toArrow().nbytes < 8 * len(pairs)


def test_language_model_scores_alike_whatever_is_sent_together(spark, lm_texts, monkeypatch):
    docs = cases.frame(spark, lm_texts).coalesce(1)
    model = pitman_yor.train(docs, F.lit(True))

    def scores():
        return sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in pitman_yor.scored(docs, model, F.lit(True)).collect())

    together = scores()
    monkeypatch.setattr(pitman_yor, "SENT_TOKENS", 1)
    monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", 200)
    assert scores() == together


def test_language_model_of_nothing(spark):
    docs = cases.empty(spark)
    assert pitman_yor.scored(docs, pitman_yor.train(docs, F.lit(True)), F.lit(True)).count() == 0
