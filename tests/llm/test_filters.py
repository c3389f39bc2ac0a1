"""Rules, classifier, URL filter, licences and toxicity."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import licences, quality_qda, quality_rules, toxicity, url_filter
from barloom.llm.queries import URL_RULES
from tests.llm import cases


def test_rule_statistics_match_plain_python(spark):
    texts = cases.odd_texts() + [(20, "a b c a b c"), (21, "x\nx\n\ny\nx"), (22, "Ä# $|<>&%* 雪 雪 雪 雪"), (23, "go go go go")]
    got = quality_rules.judged(cases.frame(spark, texts)).collect()
    assert len(got) == len(texts)
    want = sorted(((t[0] is None, t[0] or 0, *cases.rule_statistics(t[1])) for t in texts))
    have = sorted((r.doc.doc_id is None, r.doc.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert have == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_a_filter_on_the_verdict_stays_above_the_statistics(spark):
    kept = quality_rules.judged(cases.frame(spark, [(1, cases.prose(1, 80))])).where("kept").select("doc.*")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "Python" not in plan


def test_rules_reject_junk_and_keep_prose(spark):
    prose = cases.prose(1, 120)
    junk = {
        "symbols": " ".join(w + "&&&" for w in prose.split()),
        "capitals": prose.upper(),
        "shouting": " ".join(w + "!!" for w in prose.split()),
        "stutter": " ".join(w for w in prose.split()[:12] for _ in range(9)),
    }
    got = {r.doc.doc_id: r.kept for r in quality_rules.judged(cases.frame(spark, [(0, prose), *enumerate(junk.values(), 1)])).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: False}


def test_cascade_order_is_rejection_per_cost_and_never_changes_the_verdict(spark):
    rules = quality_rules.RULES
    seconds = {r.name: 1.0 + k for k, r in enumerate(rules)} | {rules[-1].name: 2.0}
    alone = [(frozenset([r.name]), 10) for r in rules[:-1]] + [(frozenset([rules[-1].name]), 90)]
    ordered = quality_rules.cascade(quality_rules.Figures(seconds, alone))
    assert [r.name for r in ordered] == [rules[-1].name, *(r.name for r in rules[:-1])]
    # What the first rule rejects does not reach the second: its own rejections are few, so it comes last.
    shadowed = [(frozenset([rules[-1].name, rules[0].name]), 90), *((frozenset([r.name]), 10) for r in rules[1:-1]), (frozenset(), 500)]
    ordered = quality_rules.cascade(quality_rules.Figures(seconds | {rules[-1].name: 0.5}, shadowed))
    assert [r.name for r in ordered] == [rules[-1].name, *(r.name for r in rules[1:-1]), rules[0].name]
    docs = cases.frame(spark, [(k, cases.prose(k, 60)) for k in range(5)] + [(9, "A!! " * 70)])
    one = quality_rules.judged(docs, rules=rules).select("doc.doc_id", "kept")
    two = quality_rules.judged(docs, rules=tuple(reversed(rules))).select("doc.doc_id", "kept")
    assert sorted(one.collect()) == sorted(two.collect())


def test_rules_are_measured_on_a_sample_of_the_whole_table(spark):
    docs = cases.frame(spark, [(k, "!!! short") for k in range(3000)] + [(5000 + k, cases.prose(k, 60).upper()) for k in range(3000)])
    figures = quality_rules.measured(docs)
    reached = sum(n for _, n in figures.rejected)
    assert 60 <= reached <= 150  # about half of 200 rows, though the first half of the table never reaches a rule
    assert all("capitals" in names for names, _ in figures.rejected)


def test_repeated_ids_do_not_multiply_labelled_rows(spark):
    docs = cases.frame(spark, [(k % 3, cases.prose(k % 6, 60)) for k in range(600)])
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    held = {}
    for name, module in (("quality", quality_qda), ("toxic", toxicity)):
        one = module.scored(docs, module.train(docs.dropDuplicates(["doc_id", "text"]), labels))
        all_rows = module.scored(docs, module.train(docs, labels))
        held[name] = [{r.doc.text: round(r.score, 9) for r in df.collect()} for df in (one, all_rows)]
    assert held["quality"][0] == held["quality"][1]


def test_staging_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from barloom.llm import staging

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://somewhere:7077"
            getConf = staticmethod(Conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_folder(Session())


def test_empty_tables(spark):
    docs = cases.empty(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.judged(docs).count() == 0
    assert quality_qda.scored(docs, quality_qda.train(docs, labels)).count() == 0
    assert toxicity.scored(docs, toxicity.train(docs, labels)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, host string, path string, text string")
    assert url_filter.judged(pages, URL_RULES, model=url_filter.Model([0.0] * url_filter.SLOTS, 0.0)).count() == 0
    assert licences.licences(pages).count() == 0


def test_qda_matches_the_density_formula():
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 1, (300, 4)), rng.normal([1, 0, 2, 0], [1, 2, 1, 1], (200, 4))
    x, y = np.vstack([a, b]), np.repeat([0, 1], [300, 200])
    model = quality_qda.fit(x, y, 0.0, 0.0)
    z = (x - x.mean(0)) / x.std(0)
    logs = []
    for k in (0, 1):
        g = z[y == k]
        cov = np.cov(g.T, bias=True)
        d = z - g.mean(0)
        logs.append(math.log((len(g) + 1) / (len(z) + 2)) - 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)))
    assert np.allclose(quality_qda.posterior(model, x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_qda_on_held_out_rows_and_odd_texts(spark):
    rng = random.Random(0)
    texts = [(k, cases.prose(k, rng.randint(60, 200))) for k in range(120)]
    texts += [(200 + k, " ".join(w + "###" for w in cases.prose(k, 80).split())) for k in range(60)]
    docs = cases.frame(spark, texts + [(900, None), (901, ""), (None, "x")])
    labels = spark.createDataFrame([(k, int(k < 200), 0) for k, _ in texts if k % 3] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_qda.train(docs, labels)
    got = {r.doc.doc_id: r.score for r in quality_qda.scored(docs, model).collect()}
    assert len(got) == len(texts) + 3 and all(0 <= s <= 1 for s in got.values())
    assert all((got[k] >= 0.7) == (k < 200) for k, _ in texts if k % 3 == 0)


def test_one_class_decides_nothing_badly():
    x = np.random.default_rng(1).normal(size=(50, len(quality_qda.FEATURES)))
    assert (quality_qda.posterior(quality_qda.fit(x, np.ones(50)), x) > 0.9).all()


URLS = [
    ("https://a.example.org/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("http://EXAMPLE.ORG/en/12?x=/y", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2#f", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ("http://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"),
    ("http://com/de/1", "com", "/de/1", "com/de/", "block"),
    ("http://xcom/de/1", "xcom", "/de/1", None, None),
    ("http://host.org", "host.org", "", None, None),
    ("http://h.org?q=://z/", "h.org", "", None, None),
    ("no scheme", "", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(k, u[0], "clash", "clash") for k, u in enumerate(URLS)] + [(0, URLS[0][0], "c", "c")], "page_id long, url string, host string, rule string")
    got = url_filter.judged(pages, URL_RULES, model=url_filter.Model([0.0] * url_filter.SLOTS, 1.0)).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        _, host, path, rule, verdict = URLS[r.page.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or "allow") and (r.score is None) == (rule is not None)


@pytest.fixture(scope="module")
def url_model(spark):
    return url_filter.train(url_filter.labelled_urls(spark))


def test_url_regression(spark, url_model):
    assert len(url_model.weights) == url_filter.SLOTS
    held = [("https://casino-royal.example.net/en/7", "block"), ("http://www.cheap-pills.example.net/es/1", "block"), ("https://gardening.example.net/en/9", "allow"), ("http://blog.museums.example.net/en/8.html", "allow")]
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(held)], "page_id long, url string")
    got = {r.page.page_id: r.verdict for r in url_filter.judged(pages, (), model=url_model).collect()}
    assert got == {k: v for k, (_, v) in enumerate(held)}


def test_labelled_urls_hold_no_host_of_the_pages(spark):
    names = {r.host for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select(url_filter.host_and_path(F.col("url"))[0].alias("host")).distinct().collect()}
    parts = {p for n in names for p in re.split("[.-]", n)} - {"example", "com", "net", "org", "www", "m", "blog"}
    assert not parts & {*url_filter.BLOCK_WORDS, *url_filter.ALLOW_WORDS}


def test_urls_of_unseen_hosts(spark):
    """Words are held out with all their hosts: one in five."""
    table = url_filter.labelled_urls(spark)
    held = F.pmod(F.xxhash64("word"), F.lit(5)) == 0
    model = url_filter.train(table.where(~held))
    pages = table.where(held).select(F.concat(F.lit("http://"), "host", "path").alias("url"), "label")
    judged = url_filter.judged(pages, (), model=model).select((F.col("verdict") == "allow").cast("double").alias("said"), F.col("page.label").alias("label")).collect()
    right = sum(r.said == r.label for r in judged) / len(judged)
    print(f"unseen hosts: {right:.3f} of {len(judged)} right")
    assert right >= 0.72
    # The path alone moves the score of a host that says nothing.
    asked = spark.createDataFrame([("http://zzyzx.example.com/click/4242",), ("http://zzyzx.example.com/wiki/4242",)], "url string")
    bad, good = (r.score for r in url_filter.judged(asked, (), model=model).orderBy("page.url").collect())
    assert bad < good - 0.1


def test_url_training_matches_plain_python(spark):
    rows = [("poker.example.com", "/click/1", 0.0), ("lotto.example.net", "/go/2.php", 0.0), ("museum.example.org", "/wiki/3", 1.0), ("river.example.com", "/news/4/", 1.0), ("wiki.example.com", "/en/5", 1.0)]
    table = spark.createDataFrame(rows, "host string, path string, label double")
    model = url_filter.train(table, steps=6)
    slots = [(r.label, r.slots) for r in table.select("label", url_filter.grams().alias("slots")).collect()]
    weight = {0.0: 0.5 / 2, 1.0: 0.5 / 3}
    w, bias, squares, bias_square = [0.0] * url_filter.SLOTS, 0.0, [1e-8] * url_filter.SLOTS, 1e-8
    for _ in range(6):
        g, g_bias = Counter(), 0.0
        for label, held in slots:
            r = weight[label] * (1 / (1 + math.exp(-(bias + sum(w[s] for s in held)))) - label)
            g_bias += r
            for s in held:
                g[s] += r
        bias_square += g_bias**2
        bias -= url_filter.RATE * g_bias / bias_square**0.5
        for s, v in g.items():
            v += url_filter.DECAY * w[s]
            squares[s] += v * v
            w[s] -= url_filter.RATE * 0.2 * v / squares[s] ** 0.5
    assert model.bias == pytest.approx(bias) and model.weights == pytest.approx(w)


def test_urls_of_odd_kinds(spark):
    nothing = url_filter.train(spark.createDataFrame([], "host string, path string, label double"))
    assert nothing.weights == [0.0] * url_filter.SLOTS and nothing.bias == 0.0
    pages = spark.createDataFrame([(1, "http://h.example.com/" + "a/" * 50_000), (2, None), (3, "http://" + "x" * 20_000)], "page_id long, url string")
    got = url_filter.judged(pages, (), model=nothing).collect()
    assert len(got) == 3 and all(r.verdict == "allow" and r.score == 0.5 for r in got)


def test_licences_and_inheritance(spark):
    files = [
        (1, "h/a/x.py", "Licensed under the Apache License, Version 2.0.\ncode"),
        (2, "h/a/b/y.py", "nothing here"),
        (3, "h/a/b/c/z.py", None),
        (4, "h/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (5, "h/q.py", "plain"),
        (6, "h/a/w.py", "<p>This work is licensed under the GNU General Public License, version 3.</p>"),
        (7, "h/a/v.py", "Licensed under the Apache License, Version 2.0."),
        (8, "other/n.py", ""),
        (9, None, "Licensed under CC BY-NC 4.0."),
        (10, "top.py", "x"),
        (2, "h/a/b/y.py", "nothing here"),
    ]
    df = spark.createDataFrame([(*f, "clash") for f in files], "page_id long, path string, text string, licence string")
    got = sorted((r.file.page_id, r.licence, r.origin, r.source_folder) for r in licences.licences(df).collect())
    assert got == [
        (1, "Apache-2.0", "own", None),
        (2, "Apache-2.0", "inherited", "h/a"),
        (2, "Apache-2.0", "inherited", "h/a"),
        (3, "Apache-2.0", "inherited", "h/a"),
        (4, "MIT", "own", None),
        (5, "MIT", "inherited", "h"),
        (6, "GPL-3.0", "own", None),
        (7, "Apache-2.0", "own", None),
        (8, None, "none", None),
        (9, "CC-BY-NC-4.0", "own", None),
        (10, None, "none", None),
    ]


def test_cosine_matches_plain_python(spark):
    text = "This file is licensed under the MIT License"
    df = spark.createDataFrame([(1, "f", text)], "id long, path string, text string")
    score = licences.licences(df).first().score
    templates = [licences.terms_of(t) for _, t in licences.TEMPLATES]
    total, terms = 1 + len(templates), licences.terms_of(text)
    inside = {w for t in templates for w in t}
    idf = lambda w: math.log((1 + total) / (1 + (w in terms) + sum(w in t for t in templates))) + 1 if w in inside else math.log(1 + total) + 1
    vector = lambda ts: {w: (1 + math.log(ts.count(w))) * idf(w) for w in set(ts)}
    a = vector(terms)
    best = 0
    for t in templates:
        b = vector(t)
        best = max(best, sum(a.get(w, 0) * v for w, v in b.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())))
    assert abs(score - best) < 1e-9


MIT = licences.TEMPLATES[[k for k, (n, t) in enumerate(licences.TEMPLATES) if n == "MIT" and "sublicense" in t][0]][1]
TEXTS = {n: max((t for m, t in licences.TEMPLATES if m == n), key=len) for n in ("BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")}
TITLES = {
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "GPL-3.0": "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "Apache-2.0": "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/",
}
PREAMBLE = (
    "Copyright (C) Free Software Foundation, Inc.\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.\n\n"
    "Preamble\n\nThe licenses for most software are designed to take away your freedom to share and change it. By contrast, this License is intended to guarantee your "
    "freedom to share and change free software.\n\nWhen we speak of free software, we are referring to freedom, not price.\n\n"
)
WARRANTY = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
    "PURPOSE. See the License for more details."
)


def wrapped(text, sign, width=70):
    import textwrap

    return "\n".join(sign + line for part in text.split("\n\n") for line in [*textwrap.wrap(part, width), ""])


def licence_files():
    year = "Copyright (c) 2021 Somebody\n\n"
    full = {"MIT": "MIT License\n\n" + year + MIT, **{n: year + t for n, t in TEXTS.items() if n in ("BSD-2-Clause", "BSD-3-Clause", "ISC")}}
    full |= {n: title + "\n\n" + PREAMBLE + cases.prose(3, 2000) for n, title in TITLES.items()}
    rows = [(n, f"{n}/LICENSE", t) for n, t in full.items()] + [(n, f"{n}/other-name.txt", t) for n, t in full.items()]
    notices = {n: year + t + "\n\n" + WARRANTY for n, t in TEXTS.items()} | {"MIT": year + MIT}
    for n, t in notices.items():
        code = "\n\nint main() { return 0; }\n" + cases.prose(9, 300)
        rows += [(n, f"{n}-c/a.c", "/*\n" + wrapped(t, " * ") + "\n */" + code), (n, f"{n}-sh/a.sh", "#!/bin/sh\n" + wrapped(t, "# ") + code), (n, f"{n}-cpp/a.cc", wrapped(t, "// ", 60) + code)]
        html = "<html><body><div class='x'>" + "".join(f"<p>{p}</p>" for p in t.replace("License", "<b>License</b>").split("\n\n")) + "</div><p>" + cases.prose(8, 200) + "</p></body></html>"
        rows.append((n, f"{n}-html/page", html))
    return rows


def test_licences_in_files_comments_and_pages(spark):
    rows = licence_files()
    df = spark.createDataFrame(rows, "want string, path string, text string")
    wrong = [(r.file.path, r.file.want, r.licence, round(r.score, 2)) for r in licences.licences(df).collect() if r.licence != r.file.want or r.origin != "own"]
    assert wrong == []


def test_licence_terms_are_counted_in_one_pass(spark):
    words = [f"w{k % 30_000}" for k in range(100_000)]
    df = spark.createDataFrame([(1, "a/LICENSE", " ".join(words) + ". Licensed under the MIT License"), (2, "b/x", "Licensed under the MIT License")], "id long, path string, text string")
    began = time.perf_counter()
    got = {r.file.id: (r.licence, r.origin) for r in licences.licences(df).collect()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "own")} and time.perf_counter() - began < 120
    counted = spark.sql(f"SELECT {licences.counted_terms('h')} AS c FROM (SELECT split('b a b c a b', ' ') AS h)").first().c
    assert [tuple(x) for x in counted] == [("a", 2), ("b", 3), ("c", 1)]


def test_a_named_version_settles_near_ties(spark):
    df = spark.createDataFrame([(2, "x/a", "licensed under the GNU General Public License 2"), (3, "y/a", "licensed under the GNU General Public License 3")], "id long, path string, text string")
    assert {r.file.id: r.licence for r in licences.licences(df).collect()} == {2: "GPL-2.0", 3: "GPL-3.0"}


TOXIC = ["idiot", "moron", "pathetic", "worthless"]


@pytest.fixture(scope="module")
def toxic_model(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for k in range(240):
        w = cases.prose(k, 60).split()
        if k % 4 == 0:
            w[10] = w[30] = rng.choice(TOXIC)
        texts.append((k, " ".join(w)))
        labels.append((k, 1, int(k % 4 == 0)))
    labels += [(3, 1, None), (None, 1, 1)]
    docs = cases.frame(spark, texts)
    return toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_deobfuscation(spark, toxic_model):
    hidden = ["you 1d10t", "such a m0r0n !", "i d i o t", "w.o.r.t.h.l.e.s.s", "p4th3t1c", "idiiiiot", "m-o-r-o-n,"]
    docs = cases.frame(spark, list(enumerate(hidden)) + [(90, cases.prose(900, 200)), (91, None), (92, ""), (93, "a"), (None, "x y"), (94, cases.prose(5, 20_000))])
    got = {r.doc.doc_id: r for r in toxicity.scored(docs, toxic_model).collect()}
    assert all(got[k].score >= 0.5 and got[k].n_restored >= 1 for k in range(len(hidden)))
    assert all(got[k].score < 0.5 for k in (90, 91, 92, 93, 94, None))
    text = {r.doc.doc_id: r.restored for r in toxicity.restored(docs, toxic_model).collect()}
    assert text[0] == "you idiot" and text[2] == "idiot" and text[4] == "pathetic" and text[91] == ""
    assert text[90] == cases.prose(900, 200)


def test_weak_signs_are_decoded_and_plain_words_stay(spark, toxic_model):
    hidden = {0: "you iddiioot", 1: "such an id-iot !", 2: "1d107", 3: "mor-on", 4: "mmoron", 5: "p47h371c", 6: "moorron"}
    plain = [(50, "10 2024 100 so-so"), (51, "\u96ea\u96ea ana-logo abba " + "\u30c3" * 5000), (52, "x" * 200 + "-" + "ab" * 3000)]
    docs = cases.frame(spark, [*hidden.items(), *plain])
    got = {r.doc.doc_id: r for r in toxicity.scored(docs, toxic_model).collect()}
    assert [k for k in hidden if got[k].score < 0.5 or got[k].n_restored < 1] == []
    assert all(got[k].score < 0.5 for k, _ in plain)
    text = {r.doc.doc_id: r.restored for r in toxicity.restored(docs, toxic_model).collect()}
    assert text[0] == "you idiot" and text[1] == "such an idiot !" and text[2] == "idiot"
    assert text[50] == plain[0][1]


def test_viterbi_finds_the_best_path(toxic_model):
    """Against every path of a short lattice."""
    log_p, decoder = toxic_model.log_probability, toxicity.Decoder(toxic_model.log_probability)
    symbol = lambda c: int(toxicity._SYMBOL[ord(c)])

    def best(unit):
        found = []

        def walk(i, a, b, score, text):
            if i == len(unit):
                found.append((score + log_p[a][b][0], text))
                return
            c = unit[i]
            if c in toxicity.SEPARATORS:
                walk(i + 1, b, 0, score + log_p[a][b][0], text + c)
                walk(i + 1, a, b, score + toxicity.DROP, text)
                return
            walk(i + 1, b, symbol(c), score + log_p[a][b][symbol(c)], text + c)
            for x in toxicity.LOOKS_LIKE.get(c, ""):
                walk(i + 1, b, symbol(x), score + toxicity.LOOK + log_p[a][b][symbol(x)], text + x)
            if i and unit[i - 1] == c:
                walk(i + 1, a, b, score + toxicity.REPEAT, text)

        walk(0, 0, 0, 0.0, "")
        return max(found)[1]

    for unit in ("1d10t", "m0r0nn", "a.b.c", "s$!1", "hello", "ii i"):
        assert decoder.read(unit) == best(unit)
