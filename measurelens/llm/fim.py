"""Fill-in-middle transformation by regular expressions with counted quantifiers.

A text is a run of units (white space with the word after it, or white space at the
end).  ``regexp_count`` gives their number n; two hash draws choose how many units
the prefix and the middle take; and one match of a pattern made for the row,
``(unit{a}+)(unit{b-a}+)(rest)``, captures all three pieces.  Its replacement string
is made for the row as well and puts the pieces into the order of the form.  The
quantifiers are possessive: a repeated group then runs as a loop, without the
recursion and the saved states of a greedy one, so texts of millions of units work.
Everything stays in built-in functions; nothing is shuffled.

Defined results: a null or empty text is plain, with n = 0.  A text that holds one of
the marks is plain, so that a mark in an output always is a border.  A null id is
hashed as an empty string.  Repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from measurelens.llm.texts import documents, name_of

# fixed values: the unit pattern and the marks
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# the same units for a pattern that never gives back what it took
_OWN = r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"


def draws(doc_id: Column, seed: int = 42) -> list[Column]:
    """Four unsigned 32-bit draws from the SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``docs`` with n, form, output, prefix_chars and middle_chars.

    ``rate`` percent of the texts are transformed, ``spm`` percent of these with the
    suffix first.  Input columns with the name of a result give way to it.
    """
    made = ["n", "form", "output", "prefix_chars", "middle_chars"]
    carry = [c for c in docs.columns if c.lower() not in made]
    rows = docs.select(F.coalesce(name_of(text).cast("string"), F.lit("")).alias("_t"), F.array(*draws(name_of(doc_id), seed)).alias("_h"), *[name_of(c).alias(f"_k{i}") for i, c in enumerate(carry)])
    rows = rows.withColumn("_n", F.regexp_count("_t", F.lit(UNIT)).cast("long"))
    t, n, h = F.col("_t"), F.col("_n"), lambda i: F.get("_h", F.lit(i))
    marked = t.contains(PREFIX) | t.contains(SUFFIX) | t.contains(MIDDLE)
    plain = (n == 0) | marked | (F.pmod(h(2), F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod(h(3), F.lit(100)) < spm, "spm").otherwise("psm")
    ends = [F.pmod(h(i), n + 1) for i in (0, 1)]
    rows = rows.withColumns({"_form": form, "_a": F.least(*ends), "_b": F.greatest(*ends)})
    taken = lambda k: F.concat(F.lit(f"({_OWN}{{"), k.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"(?s)\A"), taken(F.col("_a")), taken(F.col("_b") - F.col("_a")), F.lit(r"(.*+)\z"))
    order = F.when(F.col("_form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    rows = rows.withColumn("_out", F.when(F.col("_form") == "plain", t).otherwise(F.regexp_replace(t, pattern, order)))
    pieces = parts(F.col("_out"), F.col("_form"))
    chars = [F.when(F.col("_form") != "plain", F.length(pieces[k]).cast("long")) for k in (0, 1)]
    back = [F.col(f"_k{i}").alias(c) for i, c in enumerate(carry)]
    return rows.select(*back, n.alias("n"), F.col("_form").alias("form"), F.col("_out").alias("output"), chars[0].alias("prefix_chars"), chars[1].alias("middle_chars"))


def parts(output: Column, form: Column) -> tuple[Column, Column, Column]:
    """(prefix, middle, suffix) of an output that is not plain, cut at its marks."""
    last = F.substring_index(output, MIDDLE, -1)
    head = F.substring_index(output, MIDDLE, 1)
    after = lambda mark: F.substring_index(head, mark, -1)
    first = lambda skip, mark: F.substring_index(F.substr(head, F.lit(1 + len(skip))), mark, 1)
    psm = form == "psm"
    return F.when(psm, first(PREFIX, SUFFIX)).otherwise(after(PREFIX)), last, F.when(psm, after(SUFFIX)).otherwise(first(SUFFIX, PREFIX))


def restore(output: Column, form: Column) -> Column:
    """The text again, from output and form alone."""
    prefix, middle, suffix = parts(output, form)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))


def op12(spark, sf_dir: str) -> DataFrame:
    out = transform(documents(spark, sf_dir).select("doc_id", "text"))
    restored = restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


SQL = rf"""WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS units, sha256('42:' || doc_id) AS h FROM documents),
 d AS (SELECT doc_id, t, units, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM u),
 f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM d),
 p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(prefix || middle || suffix) AS restored_sha256 FROM p"""
