import re

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import license_scan, url_filter
from tessera.llm.queries import URL_RULES, op2_license_scan


def base_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_matches_a_plain_scan(spark, small, odd):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    more = ["CC BY cc-by CC BY", "cc by", "xcc by y", "All\nrights--RESERVED all rights reserved all rights", "general public license cc bye", "General Public LİCENSE", "cc by cc by cc by"]
    rows = [*((r.doc_id, r.text) for r in docs.collect()), *((-i, t) for i, t in enumerate(more, 1)), *((r.doc_id, r.text) for r in odd.collect())]
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(r.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_rules(spark):
    text = "Licensed under the Apache License, Version 2.0. See GPL v3 and the GNU Lesser General Public License, version 2.1 or later; MIT License."
    r = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert {"apache-2.0", "gpl-3", "lgpl-2.1", "mit"} <= set(r.labels.split(","))
    assert "apache" not in r.labels.split(",")  # inside a longer detection
    assert all(a.end <= b.start or not (a.start <= b.start and b.end <= a.end and a.priority > b.priority) for a in r.detections for b in r.detections if a is not b)
    assert len(license_scan.default_rules()) >= 200


def plain_scan(text, rules):
    """Every rule by itself, then each detection against all others."""
    flat = "".join(" " + w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
    found = []
    for rank, r in enumerate(rules):
        if " " + r.keyword in flat:
            for m in re.finditer(f" (?:{r.regex})(?= |$)", flat):
                start = flat[: m.start()].count(" ")
                found.append((start, start + m[0].count(" "), r.priority, rank, r.label))

    def inside(d, other):
        better = (other[2], other[1] - other[0], -other[3]) > (d[2], d[1] - d[0], -d[3])
        return other[0] <= d[0] and d[1] <= other[1] and other[2] >= d[2] and better

    return sorted(d for d in found if not any(inside(d, o) for o in found if o is not d))


def test_detections_match_a_plain_scan(spark, small):
    rules = license_scan.default_rules()
    words = [r.regex for r in rules if not re.search(r"[\\[(?]", r.regex)]
    rng = np.random.default_rng(5)
    more = [" ".join(rng.choice(words, 6)) for _ in range(60)] + [" of the ".join(words), "Copyright (c) 2020. GNU GPL v2, GPLv3; CC BY-SA 4.0 / CC-BY 4.0", "mit license " * 3000]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + [(-i, t) for i, t in enumerate(more, 1)]
    got = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "detections", "labels", "base_labels").collect()
    texts = dict(docs)
    for r in got:
        want = plain_scan(texts[r.doc_id], rules)
        assert sorted(tuple(d) for d in r.detections) == want
        assert r.labels == ",".join(sorted({d[4] for d in want} | set(filter(None, r.base_labels.split(",")))))


def test_rules_hold_their_keywords():
    rules = license_scan.default_rules()
    assert len(rules) >= 400 and len({(r.regex, r.label) for r in rules}) >= 400
    for r in rules:
        assert re.search(r"(^|[ |?])" + re.escape(r.keyword), re.sub(r"\(\?:", "", r.regex).replace(")", "")), r
    found = license_scan.any_of(["cc by", "cc0", "gpl", "c", "gnu"])
    assert all(re.search(" " + found, f" {w}") for w in ("cc by x", "cc0", "gplv2", "cz", "gnu")) and not re.search(" " + found, " agpl lgnu g x")


def test_scan_is_native_and_takes_empty_tables(spark, small, empty):
    plan = op2_license_scan(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert license_scan.scan(empty).count() == 0


def test_url_rules(spark):
    cases = [
        ("http://a.org/x", "a.org", "/x", "org/", "allow"), ("http://a.EXAMPLE.org/es/1?q#f", "a.example.org", "/es/1", "example.org/es/", "block"), ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), ("http://x.com/de/a", "x.com", "/de/a", "com/de/", "block"), ("http://myexample.org/es/", "myexample.org", "/es/", "org/", "allow"),
        ("http://a.org?x", "a.org", "", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None), ("x://Y://z/p", "y:", "//z/p", None, None), ("", "", "", None, None),
    ]
    weights = url_filter.fit(url_filter.labelled(spark))
    df = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases)], "page_id long, url string, host string")
    for r in url_filter.judge(df, URL_RULES, weights).collect():
        _, host, path, rule, verdict = cases[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict or r.verdict) == r.verdict and r.verdict in ("allow", "block")
    assert url_filter.judge(df.where("1 = 0"), URL_RULES, weights).count() == 0


def test_url_rules_match_a_plain_reading(spark, small):
    def judged(url):
        _, sep, rest = (url or "").partition("://")
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest)) if sep else 0
        host = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:cut]) if sep else ""
        path = re.split(r"[?#]", rest[cut:])[0] if sep else ""
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None

    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = url_filter.judge(pages, URL_RULES, [0.0] * 9).collect()
    assert len(rows) == pages.count()
    for r in rows:
        host, path, rule, said = judged(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (said or "block") and r.score == 0.5
    long = spark.createDataFrame([(1, "http://a.com/" + "x/" * 500_000), (2, "http://" + "b" * 300_000 + ".com/fr/")], "page_id long, url string")
    assert {r.page_id: r.rule for r in url_filter.judge(long, URL_RULES, [0.0] * 9).collect()} == {1: None, 2: "com/fr/"}


def test_url_model_matches_plain_gradient_descent(spark):
    rows = url_filter.labelled(spark).where("pmod(xxhash64(url), 5) = 0")
    w = np.array(url_filter.fit(rows, decay=1e-2, iterations=200, buckets=256, sizes=(3,)))
    found = rows.select(url_filter.features(F.col("url"), (3,), 256).alias("x"), "label").collect()
    x = np.array([np.bincount(r.x, minlength=257)[1:] for r in found], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x, y, own = np.hstack([x, np.ones((len(x), 1))]), np.array([r.label for r in found], float), np.zeros(257)
    for _ in range(40_000):
        own -= 2.0 * (x.T @ (1 / (1 + np.exp(-x @ own)) - y) / len(y) + 1e-2 * np.append(own[:-1], 0))
    assert np.abs(own - w).max() < 1e-2
    got = url_filter.judge(rows, [], w.tolist(), sizes=(3,)).select("score").collect()
    assert np.allclose(sorted(r.score for r in got), sorted(1 / (1 + np.exp(-x @ w))), atol=1e-9)


def test_url_model_on_held_out_hosts(spark):
    rows = url_filter.labelled(spark)
    fold, right = F.pmod(F.xxhash64(url_filter.host(F.col("url"))), F.lit(4)), 0
    for k in range(4):
        weights = url_filter.fit(rows.where(fold != k))
        right += url_filter.judge(rows.where(fold == k), [], weights).where((F.col("verdict") == "block") == (F.col("label") == 1)).count()
    assert rows.select(url_filter.host(F.col("url"))).distinct().count() == rows.count() and right / rows.count() >= 0.9


def test_url_model_without_examples(spark):
    one = url_filter.labelled(spark).where("label = 0")
    assert url_filter.judge(one, [], url_filter.fit(one)).where("verdict = 'allow'").count() == one.count()
    assert url_filter.fit(one.where("1 = 0"))[-1] == 0.0
