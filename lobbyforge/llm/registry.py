"""Queries over ``documents`` that apply each operator with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, licenses, mixing, near_dedup, ppm, quality, resampling, search, sharding, simple8b, toxicity, url_filter, winnowing
from .common import crc_mod5, discard, documents, new_path

RANKS, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


def op3_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its licence sentences and licences, each joined by a bar."""
    found = licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.array_join("license_ids", "|").alias("license_ids"), F.array_join("licenses", "|").alias("licenses"), F.size("licenses").cast("long").alias("n_licenses"))


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scores(documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(documents(spark, sf_dir), public_tokenizers.path(RANKS))


OLD_SHARDS, NEW_SHARDS = 16, 24


def op1_min_cost_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 16 shards by source, which are uneven, to 24 even ones; told from the files as they were rewritten."""
    old = F.pmod(F.xxhash64("source"), F.lit(OLD_SHARDS))
    return sharding.digest(sharding.rewrite(documents(spark, sf_dir), old, NEW_SHARDS, new_path(spark, "shards")))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.digest(documents(spark, sf_dir))


def op6_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = toxicity.judge(docs, labels)
    return judged.select("doc_id", (crc_mod5(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", "toxic_words")


def op7_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op8_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows taken: one for each document and epoch."""
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", mixing.token_estimate().cast("long").alias("n_tokens"))
    taken = mixing.mix_documents(docs, tokens=F.col("n_tokens"))
    return taken.select("_doc.doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("leaf_lang"), F.col("_source").alias("leaf_source"), F.col("_tokens").alias("n_tokens"), F.col("_epoch").alias("epoch"), F.col("_order").alias("epoch_order"))


def op9_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.read_files(simple8b.write_files(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER)))


def op10_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(documents(spark, sf_dir))


def op11_word_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards ``benchmark``, its score and, if drawn, its rank."""
    found = resampling.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return found.select("_doc.doc_id", F.col("_features").alias("n_features"), F.col("_weight").alias("weight"), F.col("_score").alias("score"), F.col("_rank").alias("rank"))


def op12_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id"])
    return judged.select("_page.page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


def op13_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each ``benchmark`` item, from an index of all documents."""
    index = search.build(documents(spark, sf_dir))
    found = search.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    discard(index.shards)
    return found


def _filled(name: str, nodes: str, parent: str, key: str) -> str:
    """CTEs that share each parent's budget among its children by weight, with limits."""
    own = f"PARTITION BY {parent}" if parent else ""
    order = f"{own} ORDER BY supply::DOUBLE / weight::DOUBLE, {key}"
    return f"""
{name}_s AS (SELECT *, coalesce(sum(supply) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used,
    (sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest FROM ({nodes})),
{name}_f AS (SELECT *, supply * rest <= (given - used) * weight AS is_full FROM {name}_s),
{name}_w AS (SELECT *, coalesce(sum(CASE WHEN is_full THEN supply END) OVER ({own}), 0)::BIGINT AS spent,
    coalesce(sum(CASE WHEN NOT is_full THEN weight END) OVER ({own}), 1)::BIGINT AS open_weight FROM {name}_f),
{name} AS (SELECT *, CASE WHEN is_full THEN supply ELSE (given - spent) * weight // open_weight END AS budget FROM {name}_w)"""


MIX_SQL = (
    """WITH d AS (SELECT doc_id, coalesce('d' || CAST(ascii(right(source, 1)) % 4 AS VARCHAR), 'none') AS domain, coalesce(lang, 'none') AS leaf_lang,
    coalesce(source, 'none') AS leaf_source, greatest(1, (strlen(coalesce(text, '')) + 3) // 4)::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, leaf_lang, leaf_source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),"""
    + _filled("a", """SELECT domain, sum(tokens)::BIGINT * 2 AS supply, CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END::BIGINT AS weight,
    (SELECT sum(tokens)::BIGINT * 60 // 100 FROM leaf) AS given FROM leaf GROUP BY domain""", "", "domain")
    + ","
    + _filled("b", """SELECT l.domain, l.leaf_lang, sum(l.tokens)::BIGINT * 2 AS supply, CASE l.leaf_lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END::BIGINT AS weight,
    max(a.budget)::BIGINT AS given FROM leaf l JOIN a ON a.domain = l.domain GROUP BY l.domain, l.leaf_lang""", "domain", "leaf_lang")
    + ","
    + _filled("c", """SELECT l.domain, l.leaf_lang, l.leaf_source, l.tokens, l.tokens * 2 AS supply, 1::BIGINT AS weight, b.budget AS given
    FROM leaf l JOIN b ON b.domain = l.domain AND b.leaf_lang = l.leaf_lang""", "domain, leaf_lang", "leaf_source")
    + """,
e AS (SELECT d.*, n.epoch, c.budget // c.tokens AS whole, c.budget % c.tokens AS part, md5('17:' || CAST(n.epoch AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'none')) AS epoch_order
    FROM d JOIN c USING (domain, leaf_lang, leaf_source) CROSS JOIN (VALUES (0), (1)) AS n(epoch)),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, leaf_lang, leaf_source, epoch ORDER BY epoch_order, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM e)
SELECT doc_id, domain, leaf_lang, leaf_source, n_tokens, epoch, epoch_order FROM r WHERE epoch < whole OR (epoch = whole AND upto <= part)"""
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _slotted(sql: str) -> str:
    for slot, reads in licenses.SLOTS:
        sql = f"regexp_replace({sql}, {_quoted(slot)}, {_quoted(reads)}, 'g')"
    return sql


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(str, row)) + ")" for row in rows)


#: Pieces by position; spans of pieces without a blank one between that are a known sentence; of
#: those the first, then the first behind it, and so on; then a fold over the rules.
LICENSE_SQL = f"""WITH known(sentence, ids) AS (VALUES {_values((_quoted(s), _quoted('|'.join(ids))) for s, ids in licenses.KNOWN.items())}),
rules(n, name, ids) AS (VALUES {_values((n, _quoted(name), _quoted('|' + '||'.join(ids) + '|')) for n, (name, ids) in enumerate(licenses.RULES))}),
numbered AS (SELECT row_number() OVER () AS row_id, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
spdx AS (SELECT row_id, low, CASE WHEN contains(low, 'spdx-license-identifier:') THEN list_reduce(list_prepend(regexp_replace(low, {_quoted(licenses.SPDX_EXCEPTION)}, '\\1', 'g'),
        list_transform(range(greatest(1, coalesce(list_max(list_transform(regexp_extract_all(low, {_quoted(licenses.SPDX_LINE)}), lambda x: len(regexp_extract_all(x, '[ )](?:or|and)[ (]')))), 0))), lambda i: '')),
        lambda t, i: regexp_replace(t, {_quoted(licenses.SPDX_JOIN)}, {_quoted(licenses.SPDX_NEXT)}, 'g')) ELSE low END AS spread FROM numbered WHERE regexp_matches(low, {_quoted(licenses.HINTS)})),
cut AS (SELECT row_id, string_split(trim({_slotted(f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(spread, {_quoted(licenses.CUT)}, '\\1\n', 'g'), {_quoted(licenses.BETWEEN)}, ' ', 'g'), {_quoted(licenses.CLAUSE)}, '\n', 'g'), ' ?\n ?', '\n', 'g')""")}, ' '), chr(10)) AS s
    FROM spdx),
one AS (SELECT row_id, unnest(s) AS piece, generate_subscripts(s, 1) AS pos FROM cut),
run AS (SELECT *, sum(CASE WHEN piece = '' THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY pos) AS blanks FROM one),
begins AS (SELECT * FROM run WHERE piece <> '' AND split_part(piece, ' ', 1) IN (SELECT split_part(sentence, ' ', 1) FROM known)),
span AS (SELECT b.row_id, b.pos, r.pos AS upto, string_agg(r.piece, ' ') OVER (PARTITION BY b.row_id, b.pos ORDER BY r.pos) AS sentence FROM begins b
    JOIN run r ON r.row_id = b.row_id AND r.blanks = b.blanks AND r.piece <> '' AND r.pos BETWEEN b.pos AND b.pos + {max(len(s.split()) for s in licenses.KNOWN)}),
hit AS (SELECT row_id, pos, max(upto) AS upto, max_by(ids, upto) AS ids FROM span JOIN known USING (sentence) GROUP BY row_id, pos),
taken AS (SELECT row_id, list_reduce(list_prepend({{'pos': 0, 'upto': 0, 'ids': ''}}, list({{'pos': pos, 'upto': upto, 'ids': ids}} ORDER BY pos)),
    lambda a, b: {{'pos': b.pos, 'upto': CASE WHEN b.pos > a.upto THEN b.upto ELSE a.upto END, 'ids': CASE WHEN b.pos > a.upto THEN a.ids || '|' || b.ids ELSE a.ids END}}).ids[2:] AS license_ids FROM hit GROUP BY row_id),
fold AS (SELECT row_id, license_ids, list_reduce(list_prepend({{'n': -1, 'name': '', 'ids': '', 'rest': '|' || replace(license_ids, '|', '||') || '|', 'found': ['']}}, (SELECT list({{'n': n, 'name': name, 'ids': ids, 'rest': '', 'found': ['']}} ORDER BY n) FROM rules)),
    lambda a, b: {{'n': b.n, 'name': b.name, 'ids': b.ids, 'rest': replace(a.rest, b.ids, '{licenses.USED}'), 'found': CASE WHEN contains(a.rest, b.ids) AND NOT list_contains(a.found, b.name) THEN list_append(a.found, b.name) ELSE a.found END}}) AS f FROM taken)
SELECT d.doc_id, coalesce(license_ids, '') AS license_ids, coalesce(array_to_string(named, '|'), '') AS licenses, coalesce(len(named), 0)::BIGINT AS n_licenses FROM numbered d
LEFT JOIN (SELECT row_id, license_ids, CASE WHEN len(f.found) > 2 THEN list_filter(f.found[2:], lambda x: x <> '{licenses.RESERVED}') ELSE f.found[2:] END AS named FROM fold) USING (row_id)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_min_cost_flow": op1_min_cost_flow,
    "op2_winnowing": op2_winnowing,
    "op3_sentence_rules": op3_sentence_rules,
    "op4_ppm": op4_ppm,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_deobfuscation": op6_deobfuscation,
    "op7_divergence": op7_divergence,
    "op8_hierarchical_mix": op8_hierarchical_mix,
    "op9_simple8b": op9_simple8b,
    "op10_chosen_path": op10_chosen_path,
    "op11_word_tries": op11_word_tries,
    "op12_url_trees": op12_url_trees,
    "op13_impact_search": op13_impact_search,
}

#: Terms of whole texts, for operators 11 and 13: letters and digits of ASCII and all other characters.
_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: The CRC of a word is a fold over its bytes with the table of the polynomial 0xEDB88320.
RESAMPLING_SQL = f"""WITH bits AS (SELECT i, list_reduce(list_prepend(i, range(1, 9)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256)) AS i)),
crcs AS (SELECT list(v ORDER BY i) AS t FROM bits),
doc AS (SELECT row_number() OVER () AS row_id, doc_id, {_TERMS} AS terms FROM documents),
words AS (SELECT row_id, unnest(terms) AS word FROM doc),
goal AS (SELECT unnest({_TERMS}) AS word FROM benchmark),
vocabulary AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM words UNION SELECT word FROM goal)),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket FROM vocabulary, crcs),
source AS (SELECT bucket, count(*) AS s FROM words JOIN hashed USING (word) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM goal JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM source)::DOUBLE AS sa, (SELECT coalesce(sum(t), 0) FROM target)::DOUBLE AS ta),
gains AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (sa + 10000)) / ((s + 1)::DOUBLE * (ta + 10000))))::BIGINT AS gain FROM source LEFT JOIN target USING (bucket), sums),
weights AS (SELECT row_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM words JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY row_id),
lucky AS (SELECT row_id, doc_id, len(terms)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM doc LEFT JOIN weights USING (row_id)),
placed AS (SELECT row_id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM lucky WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM placed) * 10 // 100 THEN rank END::BIGINT AS rank FROM lucky LEFT JOIN placed USING (row_id)"""

SEARCH_SQL = f"""WITH doc AS (SELECT row_number() OVER () AS row_id, doc_id, {_TERMS} AS terms FROM documents),
held AS (SELECT row_id, len(terms)::BIGINT AS n FROM doc WHERE len(terms) > 0),
sums AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM held),
asked AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS terms FROM benchmark),
wanted AS (SELECT q, term, count(*)::BIGINT AS times FROM (SELECT q, unnest(terms) AS term FROM asked) GROUP BY ALL),
posting AS (SELECT row_id, term, count(*)::BIGINT AS tf FROM (SELECT row_id, unnest(terms) AS term FROM doc) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM posting, sums GROUP BY term, docs),
impact AS (SELECT row_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)) AS worth FROM posting JOIN held USING (row_id), sums),
scored AS (SELECT q, row_id, sum(times * w * worth)::BIGINT AS score FROM wanted JOIN weight USING (term) JOIN impact USING (term) GROUP BY q, row_id HAVING sum(times * w * worth) > 0),
placed AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored JOIN doc USING (row_id))
SELECT item_id, rank::INT AS rank, doc_id, score FROM placed JOIN asked USING (q) WHERE rank <= 20"""

#: SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {"op3_sentence_rules": LICENSE_SQL, "op8_hierarchical_mix": MIX_SQL, "op11_word_tries": RESAMPLING_SQL, "op13_impact_search": SEARCH_SQL}
