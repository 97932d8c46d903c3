"""Row-level expressions: unit conversion, parsing, binning, flags, labels."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Powers of ten between a concentration unit and one molar.
# The micro prefix has two Unicode spellings (U+00B5 and U+03BC).
MOLAR_OFFSETS: dict[str, int] = {
    "M": 0,
    "mM": 3,
    "uM": 6,
    "µM": 6,
    "μM": 6,
    "nM": 9,
    "pM": 12,
}

# Names of the known record origins.
ORIGIN_NAMES: dict[int, str] = {
    1: "ChEMBL literature",
    7: "PubChem BioAssay (integrated)",
    37: "BindingDB (integrated)",
    38: "Patent bioactivity",
}

# Default value bins, best first; a value takes the first bound it meets.
DEFAULT_BINS: tuple[tuple[str, float], ...] = (("potent", 8.0), ("active", 7.0), ("intermediate", 5.0))
DEFAULT_FLOOR = "inactive"
DEFAULT_GROUP1: tuple[str, ...] = ("potent", "active")

THREE_FOLD = math.log10(3.0)


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def lookup(mapping: Mapping, key: Column) -> Column:
    """Literal map lookup; absent keys give null (never an error)."""
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def log_molar(value: Column | str, unit: Column | str, *, strict: bool = True) -> Column:
    """-log10 of a concentration in molar.

    ``strict`` raises on an unknown unit or a value that has no logarithm;
    otherwise those rows become null.
    """
    value, unit = as_col(value).cast("double"), as_col(unit)
    offset = lookup(MOLAR_OFFSETS, unit).cast("double")
    valid = F.coalesce(offset.isNotNull() & (value > 0) & ~F.isnan(value), F.lit(False))
    result = offset - F.log10(value)
    if not strict:
        return F.when(valid, result)
    message = F.concat(
        F.lit("cannot convert value "),
        F.coalesce(value.cast("string"), F.lit("null")),
        F.lit(" with unit "),
        F.coalesce(unit, F.lit("null")),
    )
    return F.when(valid, result).otherwise(F.raise_error(message).cast("double"))


def finite_number(raw: Column | str) -> Column:
    """Parse text or number to double; null for missing, unparseable or non-finite."""
    parsed = as_col(raw).try_cast("double")
    return F.when(~F.isnan(parsed) & (F.abs(parsed) < F.lit(float("inf"))), parsed)


def effective_id(parent: Column | str, own: Column | str) -> Column:
    """Parent id when present and non-empty, else the row's own id."""
    return F.coalesce(F.nullif(as_col(parent), F.lit("")), as_col(own))


def id_order(identifier: Column | str) -> Column:
    """Sort key that puts X9 before X10."""
    identifier = as_col(identifier)
    return F.struct(F.length(identifier).alias("len"), identifier.alias("id"))


def value_class(
    value: Column | str,
    bins: Sequence[tuple[str, float]] = DEFAULT_BINS,
    floor: str = DEFAULT_FLOOR,
    *,
    strict: bool = True,
) -> Column:
    """First label whose inclusive lower bound the value meets, else ``floor``."""
    value = as_col(value)
    missing = value.isNull() | F.isnan(value)
    if strict:
        chain = F.when(missing, F.raise_error(F.lit("a value to classify is missing")).cast("string"))
    else:
        chain = F.when(missing, F.lit(None).cast("string"))
    for label, bound in bins:
        chain = chain.when(value >= F.lit(bound), F.lit(label))
    return chain.otherwise(F.lit(floor))


def class_group(label: Column | str, group1: Sequence[str] = DEFAULT_GROUP1) -> Column:
    """1 when the class belongs to group one, else 2."""
    return F.when(as_col(label).isin(list(group1)), F.lit(1)).otherwise(F.lit(2))


def origin_id(raw: Column | str) -> Column:
    return as_col(raw).try_cast("int")


def origin_name(raw: Column | str) -> Column:
    origin = origin_id(raw)
    return F.coalesce(
        lookup(ORIGIN_NAMES, origin),
        F.concat(F.lit("ChEMBL source "), origin.cast("string")),
        F.lit("Unknown ChEMBL source"),
    )


# Fixed value: address prefix of public record pages.
RECORD_PAGES = "https://www.ebi.ac.uk/chembl/api/data/"


def record_url(kind: str, identifier: Column | str, *, digits_only: bool = False) -> Column:
    """Address of one record page; null when there is no usable identifier."""
    identifier = as_col(identifier)
    usable = identifier.rlike("^[0-9]+$") if digits_only else F.length(identifier) > 0
    return F.when(usable, F.concat(F.lit(f"{RECORD_PAGES}{kind}/"), identifier, F.lit(".json")))


def facet_filter(filters: Mapping[str, Sequence | None]) -> Column:
    """IN-list per field.  Nulls count as "Unreported"; an empty list keeps nothing."""
    keep = F.lit(True)
    for field, allowed in filters.items():
        if allowed is None:
            continue
        shown = F.coalesce(F.col(field).cast("string"), F.lit("Unreported"))
        keep = keep & (shown.isin([str(a) for a in allowed]) if allowed else F.lit(False))
    return keep


def contains_text(needle: str, *columns: str) -> Column:
    """Case-insensitive literal search in any of the columns."""
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.contains(F.lower(F.col(name).cast("string")), F.lit(needle.lower()))
    return F.coalesce(hit, F.lit(False))


def error_columns(truth: str, prediction: str, half_width: Column | float | None = None) -> dict[str, Column]:
    """Residual, absolute error, fold flags and (optionally) the empirical band."""
    residual = F.col(truth) - F.col(prediction)
    out = {
        "residual": residual,
        "absolute_error": F.abs(residual),
        "within_3_fold": F.abs(residual) <= F.lit(THREE_FOLD),
        "within_10_fold": F.abs(residual) <= F.lit(1.0),
    }
    if half_width is not None:
        width = half_width if isinstance(half_width, Column) else F.lit(float(half_width))
        out["empirical_lower"] = F.col(prediction) - width
        out["empirical_upper"] = F.col(prediction) + width
        out["inside_band"] = F.abs(residual) <= width
    return out


def selectivity_columns(a: Column | str, b: Column | str) -> dict[str, Column]:
    delta = as_col(a) - as_col(b)
    return {
        "delta": delta,
        "ratio": F.pow(F.lit(10.0), delta),
        "preferred": F.when(delta > 0, "A").when(delta < 0, "B").when(delta == 0, "tie"),
    }


def enriched_side(a: Column, b: Column) -> Column:
    """Which of two enrichment factors is above one."""
    return (
        F.when((a > 1) & (b <= 1), "A").when((b > 1) & (a <= 1), "B").when((a > 1) & (b > 1), "both").otherwise("neither")
    )


def within_caps(caps: Mapping[str, float]) -> Column:
    """All properties are numeric and at most their cap."""
    ok = F.lit(True)
    for name, cap in caps.items():
        ok = ok & F.coalesce(finite_number(name) <= F.lit(float(cap)), F.lit(False))
    return ok


def strict_flag(name: Column | str) -> Column:
    """True only for a boolean true: null never passes, and text is refused by type."""
    return F.coalesce(as_col(name), F.lit(False)) == F.lit(True)


def similarity_bin(similarity: Column | str) -> Column:
    """Novelty bins, right-closed, lowest one including zero."""
    s = as_col(similarity)
    return (
        F.when((s > -0.001) & (s <= 0.3), "≤0.3")
        .when((s > 0.3) & (s <= 0.5), "0.3–0.5")
        .when((s > 0.5) & (s <= 0.7), "0.5–0.7")
        .when((s > 0.7) & (s <= 1.0), ">0.7")
    )


def hash_unit(*parts: Column | str | int) -> Column:
    """A reproducible draw in [0, 1) from the md5 of the joined parts (52 bits)."""
    return hash_long(*parts).cast("double") / F.lit(float(2**52))


def hash_long(*parts: Column | str | int) -> Column:
    """The first 52 bits of the md5 of the joined parts, as a long."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
