"""URL filters: fixed host rules first, mined association rules for the rest.

Labelled URLs become transactions of tokens and their label.  FP-growth mines the
frequent combinations, and the rules that lead to a label are pruned by support and
confidence.  A rule goes if one without one of its tokens leads to the same verdict
at least as surely: that one fires whenever it does.  An inverted index lists every
rule under its rarest token; a URL is met with the rules of its tokens, and a rule
fires if the URL has all its tokens.  The surest rule decides (then support, then
"block"), so dropped rules change no verdict.

The number of mined rules does not depend on that of the rows, but doubles with
every token that frequent URLs share: at most (subsets of a URL's tokens) / support.
The index is broadcast where it is counted to hold at most ``BROADCAST_RULES``
rules, and joined by token otherwise.

Null URLs and those without ``://`` have an empty host and path and no tokens;
URLs on which no rule fires get the default verdict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from measurelens.llm.texts import name_of
from measurelens.operators.common import settle

# fixed values: rule, verdict
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
LABEL = "\x00label:"  # no URL token starts with this
DEFAULT = "allow"
BROADCAST_RULES = 50_000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """Distinct tokens: scheme, host labels by side, path words, query names; digits read as 0."""
    host = host_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    last = F.transform(F.slice(labels, -1, 1), lambda x: F.concat(F.lit("tld:"), x))
    parts = [
        F.array(F.concat(F.lit("scheme:"), F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER))),
        F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
        F.when(F.size(labels) > 0, last).otherwise(F.slice(last, 1, 0)),
        F.transform(F.filter(F.split(F.translate(path_of(url), UPPER, LOWER), r"[/._-]"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "0"))),
        F.transform(F.regexp_extract_all(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1)), lambda x: F.concat(F.lit("query:"), x)),
    ]
    found = F.array_distinct(F.concat(*[p for p in parts]))
    return F.when(url.contains("://"), found).otherwise(F.slice(found, 1, 0))


def mine(labelled: DataFrame, *, url: str = "url", label: str = "label", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens, key, verdict, confidence, support) per rule; ``key`` is its rarest token."""
    named = labelled.where(name_of(label).isNotNull() & name_of(url).isNotNull())
    items = F.concat(tokens_of(name_of(url)), F.array(F.concat(F.lit(LABEL), name_of(label).cast("string"))))
    baskets = named.select(items.alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith(LABEL)).select(
        F.array_sort("antecedent").alias("tokens"), F.substring(F.element_at("consequent", 1), len(LABEL) + 1, 1 << 20).alias("verdict"), "confidence", "support"
    )
    rules = settle(pruned(settle(rules.where(F.size("tokens") > 0))))
    # how rare a token is among the rules' own single-token sets
    single = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), "freq")
    keyed = rules.select("*", F.explode("tokens").alias("token")).join(single, "token")
    key = keyed.groupBy("tokens", "verdict", "confidence", "support").agg(F.min(F.struct("freq", "token")).alias("k"))
    return key.select("tokens", F.col("k.token").alias("key"), "verdict", "confidence", "support")


def pruned(rules: DataFrame) -> DataFrame:
    """The rules (tokens, verdict, confidence, support) that no rule with one token less makes redundant.

    A dropped rule's better one may be dropped in turn, for one that is better still; the last of such a row stays.
    """
    less = rules.where(F.size("tokens") > 1).select("tokens", "verdict", "confidence", F.explode("tokens").alias("out"))
    less = less.select("tokens", "verdict", "confidence", F.array_except("tokens", F.array("out")).alias("fewer"))
    short = rules.select(F.col("tokens").alias("fewer"), "verdict", F.col("confidence").alias("sure"))
    redundant = less.join(short, ["fewer", "verdict"]).where("sure >= confidence").select("tokens", "verdict").distinct()
    return rules.join(redundant, ["tokens", "verdict"], "left_anti").select("tokens", "verdict", "confidence", "support")


def match(urls: DataFrame, rules: DataFrame, *, url: str = "url", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """(url, verdict, confidence) for the distinct URLs on which a rule fires."""
    rules = settle(rules)
    index = rules.groupBy("key").agg(F.collect_list(F.struct("tokens", "verdict", "confidence", "support")).alias("rules"))
    if rules.count() <= broadcast_rules:
        index = F.broadcast(index)
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a stated number of partitions: URLs are short, but every one is met with many rules
    seen = urls.select(name_of(url).alias("url")).where(F.col("url").isNotNull()).repartition(parts, "url").distinct().withColumn("have", tokens_of(F.col("url")))
    met = seen.select("url", "have", F.explode("have").alias("key")).join(index, "key")
    fired = F.filter("rules", lambda r: F.size(F.array_except(r["tokens"], F.col("have"))) == 0)
    best = F.array_max(F.transform(fired, lambda r: F.struct(r["confidence"].alias("confidence"), r["support"].alias("support"), r["verdict"].alias("verdict"))))
    return met.select("url", best.alias("best")).where("best is not null").groupBy("url").agg(F.max("best").alias("best")).select("url", F.col("best.verdict").alias("verdict"), F.col("best.confidence").alias("confidence"))


def judge(pages: DataFrame, labelled: DataFrame | None = None, *, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, **mining) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``labelled`` (url, label) teaches the association rules; without it the URLs
    that a fixed rule judges are the labelled ones.
    """
    added = ("host", "path", "rule", "verdict")
    address = F.coalesce(name_of(url).cast("string"), F.lit(""))
    rows = pages.select(*[name_of(c) for c in pages.columns if c.lower() not in added], host_of(address).alias("host"), path_of(address).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("_fixed", verdict_of(F.col("rule"), rules))
    if labelled is None:
        labelled = rows.where("_fixed is not null").select(name_of(url).alias("url"), F.col("_fixed").alias("label"))
    # written, so that the join below deals both sides anew and Spark can split a URL with very many pages
    verdicts = settle(match(rows.where("_fixed is null"), mine(labelled, **mining), url=url).select(F.col("url").alias("_url"), F.col("verdict").alias("_mined")))
    out = rows.join(verdicts, name_of(url) == F.col("_url"), "left")
    return out.withColumn("verdict", F.coalesce("_fixed", "_mined", F.lit(DEFAULT))).drop("_fixed", "_mined", "_url")


def op4(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
