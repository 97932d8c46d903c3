"""Secret scans over an incremental ledger of blobs.

A blob is a text, addressed by its SHA-256.  Every historical version of every
path points at a blob; a ledger keeps (blob, rule, rule version, spans).  A scan
looks only at pairs of blob and rule version that the ledger lacks, and findings
are joined back to all versions that point at the blob.  So copies are scanned
once, unchanged files never again, and a new rule version only by that rule.

Positions are in code points, end exclusive.  They follow from the lengths of the
pieces around the matches, so everything stays in built-in SQL functions.  Null
and empty texts have no findings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from measurelens.llm.texts import documents, name_of
from measurelens.operators.common import settle


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` are leftmost and do not overlap; those that ``keep`` refuses are dropped after matching."""

    name: str
    version: int
    pattern: str
    keep: str | None = None
    hint: str | None = None


# fixed values: the base rules
BASE = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}$"),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"^.{20,}$"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
# what the scan adds: private key blocks, signed tokens, tokens with a vendor's prefix, passwords in addresses
EXTRA = (
    Rule("key_block", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", hint="-----BEGIN "),
    Rule("signed", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Rule("prefixed", 1, r"(?:ghp|gho|ghs|ghu|ghr|xoxb|xoxp|sk_live|rk_live)[_-][A-Za-z0-9_-]{16,}", hint="_|-"),
    Rule("address", 1, r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@", hint="://"),
)
RULES = BASE + EXTRA


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def spans(text: Column, rule: Rule) -> Column:
    """Array of struct<kind, start, end> of one rule in one text."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    # (end so far, spans so far): the i-th match follows the i-th piece between matches
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int,hit:string>>").alias("out"))

    def step(acc, pair):
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        found = F.struct(F.lit(rule.name).alias("kind"), start.alias("start"), end.alias("end"), pair["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"))
    found = F.aggregate(pairs, begin, step, lambda acc: acc["out"])
    if rule.keep:
        found = F.filter(found, lambda s: s["hit"].rlike(rule.keep))
    found = F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    seen = text.rlike(rule.pattern)
    if rule.hint:
        parts = [text.contains(h) for h in rule.hint.split("|")]
        may = parts[0]
        for p in parts[1:]:
            may = may | p
        seen = may & seen
    return F.when(seen, found).otherwise(none)


def blobs(versions: DataFrame, text: str) -> DataFrame:
    """(blob, text): one row per distinct content, however many versions hold it."""
    body = F.coalesce(name_of(text).cast("string"), F.lit(""))
    return versions.select(blob_of(body).alias("blob"), body.alias("body")).groupBy("blob").agg(F.first("body").alias("body"))


def scan(versions: DataFrame, *, text: str = "text", rules=RULES, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger rows (blob, rule, version, spans) that ``ledger`` lacks for these versions.

    Blobs without a finding of a rule have a row too: they need no second look.
    """
    open_ = blobs(versions, text)
    todo = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is not None:
        done = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("done"))  # one entry per rule version at most
        open_ = open_.join(done, "blob", "left").withColumn("todo", F.array_except(todo, F.coalesce("done", F.slice(todo, 1, 0)))).where(F.size("todo") > 0)
    else:
        open_ = open_.withColumn("todo", todo)
    body = F.col("body")
    found = [
        F.when(F.array_contains("todo", F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"))), F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), spans(body, r).alias("spans")))
        for r in rules
    ]
    return open_.select("blob", F.explode(F.filter(F.array(*found), lambda f: f.isNotNull())).alias("f")).select("blob", "f.*")


def history(versions: DataFrame, earlier: Column, *, text: str = "text", first_rules=BASE, rules=RULES) -> DataFrame:
    """The ledger after two scans: ``first_rules`` over the ``earlier`` versions, then ``rules`` over all of them.

    The second scan meets the first one's ledger, so it looks at new blobs with
    all rules and at known blobs only with rules that are new.
    """
    ledger = settle(scan(versions.where(F.coalesce(earlier, F.lit(False))), text=text, rules=first_rules))
    return ledger.unionByName(scan(versions, text=text, rules=rules, ledger=ledger))


def findings(versions: DataFrame, ledger: DataFrame, *, text: str = "text", rules=RULES) -> DataFrame:
    """Every version with ``spans``: all current findings in its blob, in order of start, then rule."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    current = F.concat_ws(":", "rule", F.col("version").cast("string")).isin(*[f"{r.name}:{r.version}" for r in rules])
    hits = (
        ledger.where((F.size("spans") > 0) & current)
        .groupBy("blob")
        .agg(F.flatten(F.collect_list("spans")).alias("spans"))  # one text's findings
    )
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    # a computed key: both sides of the join are dealt anew, so that Spark can split a blob with very many versions
    hits = hits.select(F.substring("blob", 1, 64).alias("blob"), F.transform(order, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    keyed = versions.select(*[name_of(c) for c in versions.columns if c.lower() not in ("blob", "spans")], blob_of(name_of(text).cast("string")).alias("blob"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return keyed.join(hits, "blob", "left").withColumn("spans", F.coalesce("spans", none))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    # the documents as a history: the lower half of the ids was there, and scanned by the base rules, before the rest came
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    found = findings(docs, history(docs, F.col("doc_id") <= F.lit(middle)))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.name for r in BASE]))
    return found.select(
        "doc_id",
        *[of(r.name).alias(f"n_{r.name}") for r in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def masked(text: Column, found: Column) -> Column:
    """The text with every finding replaced by its kind in angle brackets; of overlapping findings the first masks them all."""
    body = F.coalesce(text, F.lit(""))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        start, end = F.greatest(s["start"], acc["at"]), F.greatest(s["end"], acc["at"])
        fresh = s["start"] >= acc["at"]
        gap = F.when(fresh, F.concat(F.substring(body, acc["at"] + 1, start - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))).otherwise(F.lit(""))
        return F.struct(end.alias("at"), F.concat(acc["out"], gap).alias("out"))

    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, begin, step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body)))))


def _sql() -> str:
    """The same spans from the pieces between matches, one rule at a time."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for rank, rule in enumerate(RULES):
        pattern = quote(rule.pattern.replace("(?i:password|passwd|secret|token|api_?key)", "(?:(?i)password|passwd|secret|token|api_?key(?-i))"))
        keep = f" WHERE regexp_matches(hit, {quote(rule.keep)})" if rule.keep else ""
        parts.append(
            f"SELECT doc_id, {rank} AS rank, '{rule.name}' AS kind, pos AS first, pos + length(hit) AS past FROM ("
            f"SELECT doc_id, hits[i] AS hit, list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)::BIGINT AS pos FROM ("
            f"SELECT doc_id, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM ("
            f"SELECT doc_id, string_split_regex(body, {pattern}) AS gaps, regexp_extract_all(body, {pattern}) AS hits FROM t))){keep}"
        )
    base = ", ".join(quote(r.name) for r in BASE)
    listing = "string_agg(kind || ':' || first || ':' || past, ',' ORDER BY first, rank, past)"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.name}') AS n_{r.name}" for r in BASE)
    return (
        "WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), s AS (" + " UNION ALL ".join(parts) + f"), g AS (SELECT doc_id, {counts}, "
        f"{listing} FILTER (kind IN ({base})) AS base, {listing} AS spans FROM s GROUP BY doc_id) "
        f"SELECT t.doc_id, {', '.join(f'coalesce(n_{r.name}, 0) AS n_{r.name}' for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (doc_id)"
    )


SQL = _sql()
