"""Normalise free-text variant annotations with column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from measurelens.functions.scalar import as_col, lookup

# One-letter and three-letter residue codes; "*" is a stop.
RESIDUES: dict[str, str] = {
    "A": "Ala",
    "C": "Cys",
    "D": "Asp",
    "E": "Glu",
    "F": "Phe",
    "G": "Gly",
    "H": "His",
    "I": "Ile",
    "K": "Lys",
    "L": "Leu",
    "M": "Met",
    "N": "Asn",
    "P": "Pro",
    "Q": "Gln",
    "R": "Arg",
    "S": "Ser",
    "T": "Thr",
    "V": "Val",
    "W": "Trp",
    "Y": "Tyr",
    "*": "Ter",
}

_LETTERS = "".join(code for code in RESIDUES if code != "*")
_NAMES = "|".join(name.upper() for code, name in RESIDUES.items() if code != "*")
_SHORT = rf"(?<![A-Z0-9])[{_LETTERS}]\d{{1,5}}[{_LETTERS}*](?![A-Z0-9])"
_LONG = rf"(?<![A-Z0-9])(?:P\.)?(?:{_NAMES})\d{{1,5}}(?:{_NAMES}|TER)(?![A-Z0-9])"
# Fixed patterns: words that state a wild type or an unparsed change.
_WILD_TYPE = r"(?i)\b(?:wild[ -]?type|wt)\b"
_CHANGE_WORD = (
    r"(?i)\b(?:mutant|mutation|variant|delet(?:ion|ed)|insert(?:ion|ed)|fusion|"
    r"frameshift|truncat(?:ed|ion)|duplication)\b"
)
# fixed value
UNPARSED_WARNING = "Mutation-related text could not be normalized; inspect the raw annotation."


def _clean(raw: Column) -> Column:
    return F.nullif(F.regexp_replace(raw, r"^\s+|\s+$", ""), F.lit(""))


def _parsed(text: Column) -> Column:
    """Distinct (position, text) structs, ordered by position then text."""
    to_letter = {name.upper(): code for code, name in RESIDUES.items()}
    upper = F.upper(text)

    def short(hit: Column) -> Column:
        position = F.regexp_extract(hit, r"(\d+)", 1).cast("int")
        return F.struct(
            position.alias("position"),
            F.concat(F.substring(hit, 1, 1), position.cast("string"), F.substring(hit, -1, 1)).alias("text"),
        )

    def long(hit: Column) -> Column:
        body = F.regexp_replace(hit, r"^P\.", "")
        position = F.regexp_extract(body, r"(\d+)", 1).cast("int")
        return F.struct(
            position.alias("position"),
            F.concat(
                lookup(to_letter, F.substring(body, 1, 3)), position.cast("string"), lookup(to_letter, F.substring(body, -3, 3))
            ).alias("text"),
        )

    found = F.concat(
        F.transform(F.regexp_extract_all(upper, F.lit(_SHORT), 0), short),
        F.transform(F.regexp_extract_all(upper, F.lit(_LONG), 0), long),
    )
    return F.array_sort(F.array_distinct(found))


def mutations(raw: Column | str) -> Column:
    """Normalised substitutions of an annotation, as an ordered array of text."""
    return F.transform(_parsed(F.coalesce(as_col(raw), F.lit(""))), lambda m: m["text"])


def hgvs(mutation: Column) -> Column:
    position = F.regexp_extract(mutation, r"(\d+)", 1)
    return F.concat(
        F.lit("p."), lookup(RESIDUES, F.substring(mutation, 1, 1)), position, lookup(RESIDUES, F.substring(mutation, -1, 1))
    )


def annotate(raw: Column | str, *, source: str = "unknown", sequence: Column | None = None) -> dict[str, Column]:
    """The columns that describe one annotation; the raw text is kept."""
    text = _clean(as_col(raw))
    found = mutations(text)
    parsed, wild, word = F.size(found) > 0, text.rlike(_WILD_TYPE), text.rlike(_CHANGE_WORD)
    confidence = "structured" if source.startswith("chembl") else "text_derived"
    checks = sequence_warnings(found, sequence) if sequence is not None else F.array().cast("array<string>")
    unchecked = F.lit("not_checked")
    if sequence is not None:
        validation = (
            F.when(parsed & (F.length(sequence) > 0), F.when(F.size(checks) > 0, "warning").otherwise("consistent")).otherwise(unchecked)
        )
        checks = F.when(parsed & (F.length(sequence) > 0), checks).otherwise(F.array().cast("array<string>"))
    else:
        validation = unchecked
    unparsed = ~parsed & ~wild & word
    return {
        "raw_annotation": text,
        "status": F.when(text.isNull(), "unannotated")
        .when(parsed, "normalized_variant")
        .when(wild, "explicit_wild_type")
        .when(word, "variant_unparsed")
        .otherwise("unannotated"),
        "normalized": F.array_join(found, ";"),
        "display": F.array_join(F.transform(found, hgvs), ";"),
        "variant_class": F.when(text.isNull(), "none")
        .when(F.size(found) > 1, "multiple_substitutions")
        .when(parsed, "substitution")
        .when(wild, "wild_type")
        .when(word, "other")
        .otherwise("none"),
        "confidence": F.when(parsed | wild | word, F.lit(confidence)).otherwise("unknown"),
        "validation": validation,
        "warnings": F.when(F.coalesce(unparsed, F.lit(False)), F.lit(UNPARSED_WARNING)).otherwise(F.array_join(checks, "; ")),
    }


def sequence_warnings(found: Column, sequence: Column) -> Column:
    """Positions past the end of the sequence, or residues that disagree with it."""
    clean = F.upper(F.regexp_replace(sequence, r"\s+", ""))

    def check(m: Column) -> Column:
        position = F.regexp_extract(m, r"(\d+)", 1).cast("int")
        # positions start at one: position 0 reads the last residue, as Python's index -1 does
        residue = F.when(position == 0, F.substring(clean, -1, 1)).otherwise(clean.substr(position, F.lit(1)))
        return (
            F.when(
                position > F.length(clean),
                F.concat(m, F.lit(": position "), position.cast("string"), F.lit(" exceeds reference length "), F.length(clean).cast("string")),
            )
            .when(
                residue != F.substring(m, 1, 1),
                F.concat(m, F.lit(": reference has "), residue, F.lit(" at position "), position.cast("string"), F.lit(", not "), F.substring(m, 1, 1)),
            )
        )

    return F.filter(F.transform(found, check), lambda w: w.isNotNull())


def scope(raw: Column | str) -> Column:
    """The variant part of a measurement context: parsed, raw, or "Unreported"."""
    text = _clean(as_col(raw))
    # every substitution has a position, so a text without digits is not parsed
    parsed = F.when(text.rlike("[0-9]"), F.nullif(F.array_join(mutations(text), ";"), F.lit("")))
    return F.coalesce(parsed, text, F.lit("Unreported"))


def matches(query: str | None, raw: Column | str) -> Column:
    """Whether an annotation is the wanted variant; absence is never wild type."""
    if query == "any":
        return F.lit(True)
    text = _clean(as_col(raw))
    if query is None:
        return text.isNull()
    found, wanted = mutations(text), mutations(F.lit(query.strip()))
    collapse = lambda c: F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), r"\s+", " "))
    wild_query = F.lit(query).rlike(_WILD_TYPE)
    verdict = (
        F.when(F.size(wanted) > 0, found == wanted)
        .when(wild_query, (F.size(found) == 0) & text.rlike(_WILD_TYPE))
        .otherwise(collapse(F.lit(query)) == collapse(text))
    )
    return F.coalesce(verdict, F.lit(False))
