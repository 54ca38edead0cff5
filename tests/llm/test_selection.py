"""Importance resampling, URL filter and lexical search against brute force, on rows with every odd case."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from lobbyforge.llm import registry, resampling, search, url_filter
from lobbyforge.llm.url_filter import Settings

SCHEMA = "doc_id long, text string, _doc string, _score int, rank string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "the of Reading nation über there ÉTÉ 42 blend x1 ha".split()


def rows():
    r = random.Random(3)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randrange(1, 70))) for _ in range(120)]
    texts += [None, "", " \n", "-", "One", "one!ONE,one", texts[0], texts[1], "the " * 3000 + "blend", "a\u00a0b \U0001f600\U0001f600 c"]
    out = [(i, t, "d", 1, "r") for i, t in enumerate(texts)]
    return [*out, out[5], out[5], (None, "the nation of reading " * 8, "d", 1, "r"), (None, None, None, None, None)]


GOAL = [(1, "nation reading Über the the"), (2, None), (3, ""), (4, "ONE one"), (4, "ONE one"), (None, "x1 42 x1 unknownword"), (6, "unknownword")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def goal(spark):
    return spark.createDataFrame(GOAL, "item_id long, text string")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(FOLD))


def features(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute_weights(documents, target, longest, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for d in documents for f in features(d, longest))
    t = Counter(bucket(f) for d in target for f in features(d, longest))
    s_all, t_all = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for d in documents:
        found = [gain(bucket(f)) for f in features(d, longest)]
        out.append((len(found), sum(found) // len(found) if found else 0))
    return out


@pytest.mark.parametrize(("longest", "window", "nodes"), [(1, 1 << 20, 300_000), (2, 50, 20), (3, 7, 1)])
def test_resampling(docs, goal, longest, window, nodes):
    settings = resampling.Settings(longest=longest, percent=30, window=window, most_nodes=nodes)
    data = rows()
    want, able = Counter(), []
    for (doc_id, text, *_), (n, weight) in zip(data, brute_weights([d[1] for d in data], [g[1] for g in GOAL], longest)):
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        want[doc_id, n, weight, score] += 1
        if len(words(text)) >= 20:
            able.append((-score, doc_id is None, doc_id or 0))
    drawn = [(d if not none else None, -s) for s, none, d in sorted(able)][: len(able) * 30 // 100]
    got = resampling.ranked(docs, goal, settings).collect()
    assert Counter((r._doc.doc_id, r._features, r._weight, r._score) for r in got) == want
    top = sorted((r for r in got if r._rank is not None), key=lambda r: r._rank)
    assert [r._rank for r in top] == list(range(1, len(drawn) + 1)) and [(r._doc.doc_id, r._score) for r in top] == drawn
    again = resampling.resampled(docs, goal, settings)
    assert again.columns == docs.columns and Counter(r.doc_id for r in again.collect()) == Counter(d for d, _ in drawn)


def test_resampling_of_nothing(docs, goal, spark):
    none = spark.createDataFrame([], SCHEMA)
    assert resampling.ranked(none, goal).count() == 0 and resampling.resampled(none, goal).count() == 0
    got = resampling.ranked(docs, goal.limit(0)).collect()
    assert len(got) == len(rows()) and all(r._weight <= 0 or r._features for r in got)
    few = resampling.ranked(docs, goal, resampling.Settings(least_words=10**6)).collect()
    assert len(few) == len(rows()) and all(r._rank is None for r in few)


# ---------------------------------------------------------------- 12

URLS = [
    None, "", "no scheme here", "://", "http://", "http://net", "http://net/", "HTTP://Example.NET/en/1?x=1&y", "https://a.example.net/EN/1", "http://example.network/en/", "http://notnet/en/", "http://x.org/fr/",
    "http://org/fr", "http://x.org?u=/fr/", "http://m.example.com/de/#a", "http://example.com/de", "ftp://a.b.c/d/e?f#g", "http://a://b/c", "http://exämple.com/dé/ü?q=ß", "http://h.com/" + "a/" * 3000,
]


def brute_parts(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    return host.translate(FOLD), re.match("[^?#]*", rest[len(host) :])[0]


def brute_rule(host, path):
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "x", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, _url string, _host int")


def many():
    r = random.Random(9)
    return [*URLS, *(f"http{r.choice(['', 's'])}://{r.choice(['www.', 'm.', ''])}{r.choice(['one', 'two-x', 'th3'])}.{r.choice(['example.net', 'example.com', 'example.org', 'x.io'])}/{r.choice(['en', 'de', 'fr'])}/{r.randrange(9999)}{r.choice(['', '?a=1&b=2', '#t', '.html'])}" for _ in range(600)), URLS[7], URLS[7]]


def test_rules_and_parts(spark):
    got = url_filter.judge(pages(spark, many())).collect()
    assert len(got) == len(many())
    verdicts = {}
    for r in got:
        url = many()[r._page.page_id]
        host, path = brute_parts(url)
        rule, verdict = brute_rule(host, path)
        assert (r._host, r._path, r._rule) == (host, path, rule)
        assert r._verdict in ("allow", "block") and verdict in (None, r._verdict)
        assert verdicts.setdefault(url, r._verdict) == r._verdict  # repeated rows alike


def brute_features(url, stats, rate, label=None):
    """The features of a URL by name; ``stats``: suffix -> [(fold, label or none)] of all its pages."""
    host, path = brute_parts(url)
    rest = url.split("://", 1)[1] if "://" in url else ""
    query = re.match("[^/?#]*[^?#]*(?:\\?([^#]*))?", rest)[1] or ""
    bits = lambda t: -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(c if ord(c) < 128 else "\x80" for c in t).values()) if t else 0.0
    out = {
        "length": len(url), "host_length": len(host), "path_length": len(path), "depth": path.count("/"), "digit_ratio": sum(c in "0123456789" for c in url) / len(url) if url else 0.0,
        "host_digits": sum(c in "0123456789" for c in host), "entropy": bits(url), "host_entropy": bits(host), "parameters": len(query.split("&")) if query else 0, "query_length": len(query),
        "marks": sum(c in "-_%@~=" for c in url), "hyphens": host.count("-"), "labels": len(host.split(".")), "longest_label": max(map(len, host.split("."))), "secure": int(url.startswith("https:")),
    }
    mine = zlib.crc32(url.encode()) % 5
    for d in (1, 2):
        met = stats["%d:%s" % (d, ".".join(host.split(".")[-d:]))]
        known = [x for f, x in met if x is not None and (label is None or f != mine)]
        out[f"pages{d}"], out[f"share{d}"] = math.log2(len(met) + 1), (sum(known) + 20 * rate) / (len(known) + 20)
    return out


def statistics_of(urls):
    stats, labels = {}, []
    for u in urls:
        host, path = brute_parts(u)
        verdict = brute_rule(host, path)[1]
        label = None if verdict is None else int(verdict == "block")
        labels.append(label)
        for d in (1, 2):
            stats.setdefault("%d:%s" % (d, ".".join(host.split(".")[-d:])), []).append((zlib.crc32((u or "").encode()) % 5, label))
    known = [x for x in labels if x is not None]
    return stats, labels, sum(known) / len(known)


@pytest.mark.parametrize("hot", [1, 40])
def test_features_and_trees(spark, monkeypatch, hot):
    """Features as restated above, and verdicts as the fitted trees give them for those."""
    urls = many()
    stats, labels, rate = statistics_of(urls)
    held = {}
    fit, featured = url_filter.fit, url_filter.featured
    monkeypatch.setattr(url_filter, "HOT", hot)
    monkeypatch.setattr(url_filter, "fit", lambda sample, settings: held.setdefault("model", fit(sample, settings)))
    monkeypatch.setattr(url_filter, "featured", lambda rows, *a: held.setdefault(len(held), featured(rows, *a)))
    got = {r._page.page_id: r._verdict for r in url_filter.judge(pages(spark, urls)).collect()}
    frames = [v for v in held.values() if hasattr(v, "columns")]
    assert len(frames) == 2
    names = [f[1:] for f in url_filter.FEATURES]
    for frame, labelled in zip(frames, (True, False)):
        found = frame.collect()
        assert found and len(found) == (len({u or "" for u, x in zip(urls, labels) if x is not None}) if labelled else sum(x is None for x in labels))
        for r in found:
            want = brute_features(r._url, stats, rate, r._blocked)
            assert all(abs(r["_" + k] - want[k]) < 1e-9 for k in names), (r, want)
    model = held["model"]
    for i, (u, label) in enumerate(zip(urls, labels)):
        if label is None:
            want = brute_features(u or "", stats, rate)
            assert got[i] == ("block" if model.predict(_vector([want[k] for k in names])) > 0.5 else "allow")


def _vector(values):
    from pyspark.ml.linalg import Vectors

    return Vectors.dense(values)


def test_held_out_labels(spark):
    """Trees learnt from four fifths of labelled URLs know the others: long hosts with digits are blocked."""
    r = random.Random(4)
    bad = [f"http://{''.join(r.choice('abc0123456789-') for _ in range(25))}.top/{r.randrange(99)}?a=1&b=2&c=3" for _ in range(300)]
    good = [f"https://{''.join(r.choice('abcdefgh') for _ in range(7))}.example.com/{r.choice(['news', 'about'])}/{r.randrange(99)}" for _ in range(300)]
    labelled = spark.createDataFrame([(u, int(u in set(bad))) for u in bad[:240] + good[:240]], "url string, blocked int")
    got = {r._page.url: r._verdict for r in url_filter.judge(pages(spark, bad[240:] + good[240:]), Settings(rules=()), labelled).collect()}
    right = sum(got[u] == "block" for u in bad[240:]) + sum(got[u] == "allow" for u in good[240:])
    assert right >= 117
    kept = url_filter.kept_pages(pages(spark, bad[240:] + good[240:]), Settings(rules=()), labelled)
    assert kept.columns == pages(spark, []).columns and kept.count() == sum(v == "allow" for v in got.values())


def test_url_filter_of_nothing_and_of_one_kind(spark):
    assert url_filter.judge(pages(spark, [])).count() == 0
    got = url_filter.judge(pages(spark, ["http://a.net/", "http://b.io/", None])).collect()
    assert sorted((r._page.page_id, r._verdict) for r in got) == [(0, "block"), (1, "block"), (2, "block")]
    assert {r._verdict for r in url_filter.judge(pages(spark, ["http://b.io/", None])).collect()} == {"allow"}


# ---------------------------------------------------------------- 13


def brute_search(documents, queries, top):
    texts = [(i, Counter(words(t))) for i, t, *_ in documents]
    texts = [(i, c) for i, c in texts if c]
    n_docs, n_words = len(texts), sum(c.total() for _, c in texts)
    holding = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in queries:
        found = []
        for doc_id, c in texts:
            norm = 75 + (25 * c.total() * n_docs) // n_words
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * norm)) for t, n in Counter(words(text)).items() if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(found)[:top], 1)]
    return Counter(out)


@pytest.mark.parametrize(("shard", "block", "top"), [(1 << 20, 500, 20), (300, 2, 3), (1, 1, 1)])
def test_search(docs, goal, monkeypatch, shard, block, top):
    monkeypatch.setattr(search, "BLOCK_QUERIES", block)
    index = search.build(docs, shard)
    got = search.search(index, goal, top)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert Counter(map(tuple, got.collect())) == brute_search(rows(), GOAL, top)
    assert index.shards.count() >= (20 if shard == 300 else 1)


def test_terms_of_long_texts(monkeypatch):
    want = [search.counted(t or "") for _, t, *_ in rows()]
    monkeypatch.setattr(search, "WINDOW", 5)
    assert [search.counted(t or "") for _, t, *_ in rows()] == want


def test_best_is_safe_with_ties():
    import numpy as np

    r = random.Random(8)
    for _ in range(300):
        score = np.array([r.randrange(4) for _ in range(r.randrange(1, 40))])
        ids = np.array(r.sample(range(100), len(score)))
        want = sorted((i for i in range(len(score)) if score[i] > 0), key=lambda i: (-score[i], ids[i]))[:5]
        assert search.best(score, ids, 5).tolist() == want


def test_search_of_nothing(docs, goal, spark):
    none = spark.createDataFrame([], SCHEMA)
    assert search.search(search.build(none), goal).count() == 0
    assert search.search(search.build(docs), goal.limit(0)).count() == 0


def test_queries_return_the_columns_named(spark, data):
    want = {
        "op11_word_tries": ["doc_id", "n_features", "weight", "score", "rank"],
        "op12_url_trees": ["page_id", "host", "path", "rule", "verdict"],
        "op13_impact_search": ["item_id", "rank", "doc_id", "score"],
    }
    for name, columns in want.items():
        assert registry.QUERIES[name](spark, data).columns == columns
