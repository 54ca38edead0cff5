"""The stages of the pipeline, each held against what it says of its own input."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from test_operators import FOLD, RANKS, brute_base, brute_groups, brute_references, brute_toxicity, brute_verdict

import corpus_pipeline
from lobbyforge.llm import byte_bpe, mixing
from lobbyforge.llm.common import documents, written


@pytest.fixture(scope="module")
def stages(spark, data):
    docs = documents(spark, data)
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, data), name)
        seen.append(docs)
    return seen


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def rows(df):
    return [(r.doc_id, r.text, r.lang) for r in df.collect()]


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert "ids_sha256" in stages[-1].columns


def test_quality_stage(stages):
    """By brute force: base rule, references, distances and verdict of every document."""
    docs = rows(stages[0])
    refs = brute_references(docs)
    want = []
    for i, text, lang in docs:
        n, *_, again = brute_base(text or "")
        if n >= 10 and 100 * again <= 20 * n and brute_verdict(text, lang, refs)[2]:
            want.append(i)
    assert ids(stages[1]) == sorted(want) and 0 < len(want) < len(docs)


def test_toxicity_stage(spark, data, stages):
    """By brute force: learning and scores over what the stage before kept, and over a table with more labels."""
    larger = data.replace("sf0.001", "sf0.01")
    for where, given, kept in ((data, stages[1], stages[2]), (larger, documents(spark, larger), None)):
        docs = [(i, t) for i, t, _ in rows(given)]
        labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{where}/labels.parquet").collect()]
        want = [i for (i, _), score in zip(docs, brute_toxicity(docs, labels)) if score < 0.5]
        assert ids(corpus_pipeline.keep_clean(spark, given, where) if kept is None else kept) == sorted(want)
    assert 0 < len(want) < len(docs)


def test_near_dedup_stage(stages):
    """By brute force over all pairs: one document of each group stays, that of the least id."""
    docs = [(i, t) for i, t, _ in rows(stages[2])]
    groups = {(i, c) for i, _, c in brute_groups(docs, 5, 80)}
    assert ids(stages[3]) == sorted(i for i, c in groups if i == c)


def test_mix_stage(stages):
    """Every leaf gives the longest prefix of its order that its budget allows."""
    docs = {r.doc_id: r for r in stages[3].collect()}
    tokens = {i: max(1, (len((r.text or "").encode()) + 3) // 4) for i, r in docs.items()}
    leaf = {i: (f"d{ord(r.source[-1]) % 4}", r.lang or "none", r.source) for i, r in docs.items()}
    sums = Counter()
    for i, key in leaf.items():
        sums[key] += tokens[i]
    table = stages[3].sparkSession.createDataFrame([(*k, n) for k, n in sums.items()], "_domain string, _lang string, _source string, tokens long")
    want = []
    for b in mixing.leaf_budgets(table, corpus_pipeline.MIX).collect():
        mine = sorted((hashlib.md5(f"17:0:{i}".encode()).hexdigest(), i) for i, k in leaf.items() if k == (b._domain, b._lang, b._source))
        left = b.budget
        for _, i in mine:
            left -= tokens[i]
            if left < 0:
                break
            want.append(i)
    assert ids(stages[4]) == sorted(want) and 0 < len(want) < len(docs)


def test_encode_stage(stages):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    want = {i: hashlib.sha256(" ".join(map(str, library.encode_ordinary(t or ""))).encode()).hexdigest() for i, t, _ in rows(stages[4])}
    assert {r.doc_id: r.ids_sha256 for r in stages[5].collect()} == want


def test_run(spark, data, stages):
    assert ids(corpus_pipeline.run(spark, data)) == ids(stages[-1])


def folder(spark, tmp_path, docs, schema, labels=()):
    spark.createDataFrame(docs, schema).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [], SCHEMA)).count() == 0


def test_nulls_repeats_and_clashing_columns(spark, tmp_path, data):
    """Nulls in every column, rows that repeat, a very long text and columns of the stages' own names."""
    some = documents(spark, data).limit(60).collect()
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "x", 1, None) for r in some]
    docs += docs[:5] + [(None, docs[7][1], None, None, None, None, None, None)] * 3 + [(900, None, None, None, None, None, None, None), (901, "", "en", "s", 0, "", 0, ""), (902, " ".join(r.text or "" for r in some) * 3, "en", "src1", 1, "y", 2, "z")]
    where = folder(spark, tmp_path, docs, SCHEMA + ", kept string, _tokens int, root string", [(None, 1, 1), (3, None, None)])
    stage = documents(spark, where)
    for name, run in corpus_pipeline.STAGES[:-1]:
        stage = written(run(spark, stage, where), name)
        assert stage.columns == documents(spark, where).columns
    got = corpus_pipeline.run(spark, where).collect()
    assert len(got) == stage.count() > 0
    texts = Counter((r.text or "").translate(FOLD) for r in stage.collect())
    assert max(texts.values()) == 1 and "" not in texts
