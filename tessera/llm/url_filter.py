"""URL filter: rules first, then gradient-boosted trees on lexical features.

Features of a URL: lengths, path depth, digit and hyphen shares, character entropy,
labels, parameters, and statistics of its host's suffix over the labelled URLs
(how common it is, and how its labels lean, smoothed). The trees are trained from
labelled URLs; the labels may come from a table or, where there is none, from
``seed_labels``: hosts that hold a listed term are to be blocked, and of the other
hosts those without a rule are taken as allowed. The suffix statistics count all
labelled URLs, by the suffix itself; at most ``MOST_LABELLED`` rows, chosen by the hash
of the URL, are given to the trees (a documented bound); every URL is judged.

Only SQL functions and Spark ML. Defined cases: a null URL or one without ``://``
has empty host and path and is judged by its features like any other; a block score of exactly
0.5 allows; a very long URL is a row like any other; repeated
rows come out each; with no labelled URL of either kind every verdict is allow
unless a rule says otherwise; an empty table gives an empty result; extra columns
pass through, but for those named like a result column (host, path, rule, verdict,
block_score), which give way to it."""
from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (rule, verdict): host, then the start of the path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Terms of hosts taken as labelled ``block``.
SEED_TERMS = ("casino", "poker", "bets", "pills", "pharma", "viagra", "spam", "ads-", "track", "lottery", "loan", "porn")
MOST_LABELLED = 40_000
ALPHABET = LOWER + "0123456789-._~/?#=&%:+"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.coalesce(after_scheme(url), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    rest = F.coalesce(after_scheme(url), F.lit(""))
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule fits its
    host and all subdomains if the path starts with the rule's."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):  # the longest comes last and wins
        name, start = text[:text.index("/")], text[text.index("/"):]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _share(count: Column, total: Column) -> Column:
    return F.when(total > 0, count / total).otherwise(F.lit(0.0))


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    low = F.lower(url)
    n, hn = F.char_length(url), F.char_length(host)

    def count(text, chars):  # how many of these characters
        return F.char_length(text) - F.char_length(F.translate(text, chars, ""))

    counts = F.transform(F.array(*map(F.lit, ALPHABET)), lambda c: F.char_length(low) - F.char_length(F.replace(low, c, F.lit(""))))
    entropy = F.aggregate(counts, F.lit(0.0), lambda h, k: h - F.when(k > 0, (k / n) * F.log2(k / n)).otherwise(F.lit(0.0)))
    labels = F.split(host, "\\.")
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    return {
        "url_length": n, "host_length": hn, "path_length": F.char_length(path),
        "depth": count(path, "/"), "labels": F.size(labels), "longest_label": F.array_max(F.transform(labels, F.char_length)),
        "digit_share": _share(count(url, "0123456789"), n), "host_digits": count(host, "0123456789"),
        "host_hyphens": count(host, "-"), "vowel_share": _share(count(host, "aeiou"), hn),
        "entropy": F.when(n > 0, entropy).otherwise(F.lit(0.0)),
        "parameters": F.when(query == "", 0).otherwise(count(query, "&") + 1), "query_length": F.char_length(query),
        "odd_signs": count(url, "%@~+_"), "fragment": F.contains(url, F.lit("#")).cast("int"),
    }


def with_features(urls: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add host, path and the features; the suffix is kept."""
    df = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    feats = lexical_features(F.col("url"), F.col("host"), F.col("path"))
    df = df.select("*", *(c.cast("double").alias(k) for k, c in feats.items()), F.substring_index("host", ".", -1).alias("suffix"))
    return df, list(feats)


def seed_labels(featured: DataFrame, terms=SEED_TERMS, rules=RULES) -> DataFrame:
    """Add label: 1.0 (block) where the host holds a term, 0.0 (allow) for other
    hosts; rows that a rule decides or that have no host get none."""
    rule, _ = matching_rule(F.col("host"), F.col("path"), rules)
    held = reduce(lambda a, b: a | b, (F.contains(F.col("host"), F.lit(t)) for t in terms))
    return featured.withColumn("label", F.when(rule.isNull() & (F.col("host") != ""), held.cast("double")))


def train(labelled: DataFrame, names: list[str], most: int = MOST_LABELLED, trees: int = 12, depth: int = 4):
    """(model, suffix statistics, assembler) from rows with features, suffix and label 0.0
    or 1.0; None if only one label occurs. The statistics count all labelled rows, the
    trees see a bounded sample of them, chosen by the hash of the URL."""
    total = labelled.filter("label is not null").count()
    cut = min(1.0, most / max(total, 1))
    share = F.pmod(F.xxhash64("url", F.lit(7)), F.lit(1 << 20)) < int(cut * (1 << 20))
    sample = stage(labelled.filter("label is not null").filter(share).select("url", "suffix", "label", *names), "urls")
    found = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        return None
    stats = suffix_statistics(labelled.filter("label is not null"))
    weight = F.when(F.col("label") == 1.0, sum(found.values()) / (2 * found[1.0])).otherwise(sum(found.values()) / (2 * found[0.0]))
    assembler = VectorAssembler(inputCols=[*names, "suffix_share", "suffix_lean"], outputCol="features")
    ready = assembler.transform(_with_suffix(sample, stats).withColumn("weight", weight)).select("features", "label", "weight")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=11, weightCol="weight").fit(ready)
    return model, stats, assembler


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """For each suffix of the labelled URLs its share of them and its smoothed log-odds of block, as rates."""
    counted = stage(labelled.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("label").alias("bad")), "suffixes")
    total = counted.agg(F.sum("n")).first()[0]
    return counted.select("suffix", (F.col("n") / F.lit(total)).alias("suffix_share"),
                          F.log((F.col("bad") + 1) / (F.col("n") - F.col("bad") + 1)).alias("suffix_lean"))


def _with_suffix(df: DataFrame, stats: DataFrame) -> DataFrame:
    # one row a suffix: Spark broadcasts them where the stored table is small, and splits hot suffixes where not
    return df.join(stats, "suffix", "left").fillna(0.0, ["suffix_share", "suffix_lean"])


def judge_urls(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, most: int = MOST_LABELLED) -> DataFrame:
    """All rows of pages(url, ...) with host, path, rule, verdict and block_score
    (the trees' probability). labels(url, label) replaces the seed labels."""
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "block_score")]
    renamed = free_name(pages.select("url"), *(f"in_{i}" for i in range(len(keep))))
    slim = pages.select("url", *(F.col(f"`{c}`").alias(r) for c, r in zip(keep, renamed, strict=True)))
    featured, names = with_features(slim)
    if labels is None:
        labelled = seed_labels(featured, rules=rules)
    else:
        labelled = with_features(labels.select("url", F.col("label").cast("double").alias("label")))[0]
    fitted = train(labelled, names, most)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    if fitted is None:
        scored = featured.withColumn("block_score", F.lit(0.0))
    else:
        model, stats, assembler = fitted
        scored = model.transform(assembler.transform(_with_suffix(featured, stats))).withColumn(
            "block_score", vector_to_array("probability")[1])
    return scored.select(*(F.col(r).alias(c) for c, r in zip(keep, renamed, strict=True)), "host", "path", rule.alias("rule"),
                         F.coalesce(verdict, F.when(F.col("block_score") > 0.5, "block").otherwise("allow")).alias("verdict"), "block_score")
