"""Operator 12: URL filter of rules and gradient-boosted trees on lexical features.

A rule names a host and the beginning of a path; it holds for the host, its subdomains, and paths
that begin so; the longest that fits decides (ties by text).  URLs that no rule decides are judged by
trees learnt from the URLs that the rules do decide, or from ``labelled`` rows (url, blocked).  The features
are lengths, depth, share of digits, entropy of characters, numbers of parameters, marks and labels,
and statistics of the host's suffixes of one and two labels over all pages: how many pages
they have, and the share of labelled ones that is blocked, drawn towards the share of all.  A
training row sees that share without the rows of its own fold, so it does not meet its own label.

Suffixes held by a ``HOT``-th of all pages or more, of which there are at most 2 * HOT, reach the pages as
a broadcast; all others by a shuffle, in which a key is a small part of the rows.

The trees are Spark's own, learnt from a bounded sample: distinct labelled URLs in the order of a hash, about
``max_labelled`` at most (a documented bound; statistics count all rows).

A null URL is empty text; it and URLs without ``://`` have an empty host and path, no rule,
and a verdict like any other.  Repeated rows get equal verdicts.  An empty table gives an empty
result.  Without labels of both kinds all undecided URLs get the one that there is, or are allowed.
Other columns, whatever their names, travel in a struct.  Very long URLs are taken whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, written

#: (host, path, verdict) (fixed values of the contract).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
FOLDS, DEPTHS, HOT = 5, (1, 2), 4096


@dataclass(frozen=True)
class Settings:
    rules: tuple[tuple[str, str, str], ...] = RULES
    max_labelled: int = 20_000
    trees: int = 20
    depth: int = 4
    step: float = 0.2
    prior: float = 20.0
    seed: int = 11


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return fold(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def decided(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does."""
    by_length = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    none = F.lit(None).cast("string")

    def pick(value) -> Column:
        fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in by_length]
        return reduce(lambda rest, x: F.when(x[0], F.lit(value(x[1]))).otherwise(rest), list(zip(fits, by_length))[::-1], none)

    return pick(lambda r: r[0] + r[1]), pick(lambda r: r[2])


def entropy(url: Column) -> Column:
    """Bits a character, of ASCII characters and one class of all others."""
    plain = F.regexp_replace(url, "[^\\x00-\\x7F]", "\u0080")
    n = F.length(plain)
    kinds = F.filter(F.array_distinct(F.split(plain, "")), lambda c: c != "")
    shares = F.transform(kinds, lambda c: (n - F.length(F.replace(plain, c, F.lit("")))) / n)
    return F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p))


def suffix(host: Column, depth: int) -> Column:
    labels = F.split(host, "\\.")
    return F.concat(F.lit(f"{depth}:"), F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - depth + 1), depth), "."))


def lexical() -> dict[str, Column]:
    """Features that a URL has by itself."""
    url, host, path = F.col("_url"), F.col("_host"), F.col("_path")
    query = F.regexp_extract(after_scheme(url), "^[^/?#]*[^?#]*\\?([^#]*)", 1)
    n = F.length(url)
    labels = F.split(host, "\\.")
    return {
        "length": n,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))),
        "digit_ratio": F.when(n > 0, F.regexp_count(url, F.lit("[0-9]")) / n).otherwise(0.0),
        "host_digits": F.regexp_count(host, F.lit("[0-9]")),
        "entropy": entropy(url),
        "host_entropy": entropy(host),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "query_length": F.length(query),
        "marks": F.regexp_count(url, F.lit("[-_%@~=]")),
        "hyphens": F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))),
        "labels": F.size(labels),
        "longest_label": F.array_max(F.transform(labels, F.length)),
        "secure": url.startswith("https:").cast("int"),
    }


def fold_of(url: Column) -> Column:
    return (F.crc32(url.cast("binary")) % FOLDS).cast("int")


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """(suffix, pages, labelled and blocked by fold) over all rows; repeats are summed before the shuffle."""
    keys = F.explode(F.array(*(suffix(F.col("_host"), d) for d in DEPTHS))).alias("suffix")
    known = F.col("_blocked").isNotNull()
    by_fold = []
    for f in range(FOLDS):
        mine = known & (F.col("_fold") == f)
        by_fold += [F.count_if(mine).alias(f"labelled{f}"), F.count_if(mine & F.col("_blocked")).alias(f"blocked{f}")]
    found = rows.select(keys, "_blocked", "_fold").groupBy("suffix").agg(F.count(F.lit(1)).alias("pages"), *by_fold)
    arrays = (F.array(*(F.col(f"{k}{f}") for f in range(FOLDS))).alias(k) for k in ("labelled", "blocked"))
    return found.select("suffix", "pages", *arrays)


def looked_up(rows: DataFrame, statistics: DataFrame, key: Column, least: int) -> DataFrame:
    """Adds ``_s``, the statistics of a suffix: frequent ones by broadcast, others by a shuffle without hot keys."""
    value = F.struct("pages", "labelled", "blocked")
    hot = statistics.filter(F.col("pages") >= least).select(F.col("suffix").alias("_hot"), value.alias("_h"))
    cold = statistics.filter(F.col("pages") < least).select(F.col("suffix").alias("_cold"), value.alias("_c"))
    met = rows.withColumn("_key", key).join(F.broadcast(hot), F.col("_key") == F.col("_hot"), "left")
    apart = F.concat(F.lit("\0"), F.pmod(F.xxhash64("_url", "_host", "_path", F.monotonically_increasing_id()), F.lit(HOT)))  # is no suffix
    met = met.withColumn("_key", F.when(F.col("_h").isNull(), F.col("_key")).otherwise(apart))
    return met.join(cold, F.col("_key") == F.col("_cold"), "left").withColumn("_s", F.coalesce("_h", "_c")).drop("_key", "_hot", "_cold", "_h", "_c")


def featured(rows: DataFrame, statistics: DataFrame, least: int, rate: float, settings: Settings) -> DataFrame:
    """Rows with all features; rows with a label see the shares of other folds only."""
    out = rows
    names = []
    for d in DEPTHS:
        out = looked_up(out, statistics, suffix(F.col("_host"), d), least)
        # zero for a row without label: nothing of its own to leave out
        own = [F.when(F.col("_blocked").isNotNull(), F.get(F.col(f"_s.{k}"), F.col("_fold"))).otherwise(0) for k in ("labelled", "blocked")]
        labelled, blocked = (F.aggregate(F.col(f"_s.{k}"), F.lit(0).cast("long"), lambda a, b: a + b) - o for k, o in zip(("labelled", "blocked"), own))
        share = (blocked + settings.prior * rate) / (labelled + settings.prior)
        names += [(f"pages{d}", F.log2(F.col("_s.pages") + 1)), (f"share{d}", share)]
        out = out.withColumns({f"_pages{d}": names[-2][1], f"_share{d}": names[-1][1]}).drop("_s")
    mine = {f"_{name}": value.cast("double") for name, value in lexical().items()}
    return out.withColumns(mine)


FEATURES = [*(f"_{name}" for name in ("length", "host_length", "path_length", "depth", "digit_ratio", "host_digits", "entropy", "host_entropy", "parameters", "query_length", "marks", "hyphens", "labels", "longest_label", "secure")), *(f"_{k}{d}" for d in DEPTHS for k in ("pages", "share"))]


def vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(rows)


def fit(sample: DataFrame, settings: Settings) -> GBTClassificationModel:
    """Trees from the bounded sample of featured rows."""
    rows = vectors(sample).select("_features", F.col("_blocked").cast("double").alias("_label"))
    trees = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=settings.trees, maxDepth=settings.depth, stepSize=settings.step, seed=settings.seed)
    return trees.fit(rows)


def judge(pages: DataFrame, settings: Settings = Settings(), labelled: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rows (_page, _host, _path, _rule, _verdict); ``_page`` holds the columns ``keep``, or all.

    ``labelled`` (url, blocked) are learnt from in place of the URLs that rules decide.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in (keep or pages.columns))).alias("_page"), url.alias("_url"))
    rows = rows.withColumns({"_host": host_of(F.col("_url")), "_path": path_of(F.col("_url")), "_fold": fold_of(F.col("_url"))})
    rule, verdict = decided(F.col("_host"), F.col("_path"), settings.rules)
    rows = rows.withColumns({"_rule": rule, "_verdict": verdict})
    parts = ["_url", "_host", "_path", "_fold", "_blocked"]
    if labelled is None:
        known = rows.withColumn("_blocked", F.col("_verdict") == "block")
        counted = known.select(parts)
    else:
        known = labelled.select(F.coalesce(F.col("url"), F.lit("")).alias("_url"), F.col("blocked").cast("boolean").alias("_blocked"))
        known = known.withColumns({"_host": host_of(F.col("_url")), "_path": path_of(F.col("_url")), "_fold": fold_of(F.col("_url"))})
        counted = rows.withColumn("_blocked", F.lit(None).cast("boolean")).select(parts).unionByName(known.select(parts))
    known = known.filter("_blocked IS NOT NULL")
    n = counted.agg(F.count(F.lit(1)).alias("pages"), F.count("_blocked").alias("labelled"), F.coalesce(F.count_if("_blocked"), F.lit(0)).alias("blocked"), F.approx_count_distinct(F.when(F.col("_blocked").isNotNull(), F.col("_url"))).alias("urls")).first()
    done = rows.filter("_verdict IS NOT NULL")
    out = ["_page", "_host", "_path", "_rule", "_verdict"]
    if n["blocked"] in (0, n["labelled"]):
        only = "block" if n["blocked"] else "allow"
        return rows.withColumn("_verdict", F.coalesce("_verdict", F.lit(only))).select(out)
    statistics = written(suffix_statistics(counted), "suffixes")
    least, rate = max(1, n["pages"] // HOT), n["blocked"] / n["labelled"]
    part = F.pmod(F.xxhash64("_url"), F.lit(1 << 20))
    sample = known.filter(part < int((1 << 20) * settings.max_labelled / max(n["urls"], 1)) + 1).groupBy("_url", "_host", "_path", "_fold").agg(F.max("_blocked").alias("_blocked"))
    # bounded, so a few partitions hold it however many the pages have
    model = fit(written(featured(sample, statistics, least, rate, settings).select("_blocked", *FEATURES).coalesce(4), "labelled").coalesce(4), settings)
    open_rows = rows.filter("_verdict IS NULL").withColumn("_blocked", F.lit(None).cast("boolean"))
    judged = model.transform(vectors(featured(open_rows, statistics, least, rate, settings)))
    judged = judged.withColumn("_verdict", F.when(F.col("prediction") > 0.5, "block").otherwise("allow"))
    return done.select(out).unionByName(judged.select(out))


def kept_pages(pages: DataFrame, settings: Settings = Settings(), labelled: DataFrame | None = None) -> DataFrame:
    """The allowed pages, all their columns and no others."""
    return judge(pages, settings, labelled).filter("_verdict = 'allow'").select("_page.*")
