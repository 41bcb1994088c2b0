"""Labels, identifiers, sizes and hashes as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from surveykit.functions.geometry import all_finite

# Label tables (label, phrases). A leading underscore marks a distractor class.
HOUSEHOLD = [
    ("chair", ["chair"]),
    ("table", ["table", "dining table"]),
    ("door", ["closed door"]),
]
DOOR = [("door", ["door", "closed door"])]
DOOR_V2 = [
    ("door", ["door", "closed door", "wooden door", "open doorway"]),
    ("_window", ["window"]),
    ("_switch", ["light switch", "wall socket", "doorbell", "thermostat", "intercom", "control panel"]),
    ("_flat", ["picture frame", "poster", "television", "photo frame", "wall hanging", "wall decoration"]),
    ("_furniture", ["wardrobe", "cabinet", "curtain"]),
    ("_wall", ["wall", "blank wall", "white wall"]),
]
HALL_V1 = [
    ("door", ["door", "closed door", "wooden door", "open doorway"]),
    ("sofa", ["sofa", "couch", "daybed"]),
    ("cabinet", ["blue cabinet", "sideboard", "cabinet", "cabinet door", "cupboard"]),
    ("spray", ["spray can", "aerosol can", "spray bottle", "insecticide spray"]),
    ("_window", ["window"]),
    ("_switch", ["light switch", "wall socket", "doorbell", "thermostat", "intercom", "control panel"]),
    ("_flat", ["picture frame", "poster", "television", "photo frame", "wall hanging", "wall decoration"]),
    ("_furniture", ["wardrobe", "curtain"]),
    ("_wall", ["wall", "blank wall", "white wall"]),
]
LABEL_SETS = {"household": HOUSEHOLD, "door": DOOR, "door_v2": DOOR_V2, "hall_v1": HALL_V1}


def strip(c: Column) -> Column:
    """Remove all kinds of white space at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normal_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def canonical_label(c: Column, table: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Label of the longest phrase contained in the text, else null.

    An exact hit is always the longest phrase contained, so it needs no branch of its own. The table
    is a literal of a few dozen phrases; equal lengths keep table order.
    """
    phrases = [(p.lower(), label) for label, group in table for p in group]
    phrases = sorted(phrases, key=lambda item: -len(item[0]))
    text = normal_text(c)
    hits = F.array(*[F.when(F.contains(text, F.lit(p)), F.lit(label)) for p, label in phrases])
    return F.try_element_at(F.filter(hits, lambda h: h.isNotNull()), F.lit(1))


def canonical_frame(c: Column) -> Column:
    return F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"^/+", "")


def csv_labels(c: Column) -> Column:
    parts = F.transform(F.split(c, ","), strip)
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def parse_space(c: Column) -> Column:
    """``700M`` to bytes; null for anything but a positive integer with an optional K, M or G."""
    text = strip(F.coalesce(c, F.lit("")))
    digits = F.regexp_extract(text, r"^\+?([0-9]+)\s*([KkMmGg]?)$", 1)
    unit = F.lower(F.regexp_extract(text, r"^\+?([0-9]+)\s*([KkMmGg]?)$", 2))
    amount = digits.try_cast("bigint")
    factor = F.when(unit == "k", 1024).when(unit == "m", 1024**2).when(unit == "g", 1024**3).otherwise(1)
    return F.when(amount > 0, amount * factor.cast("bigint"))


def camera_mount(c: Column) -> Column:
    """Text of six numbers to ``ARRAY<DOUBLE>``; null when not exactly six finite numbers."""
    parts = F.filter(F.split(F.regexp_replace(c, ",", " "), r"\s+"), lambda p: p != "")
    values = F.transform(parts, lambda p: p.try_cast("double"))
    return F.when((F.size(values) == 6) & all_finite(values), values)


def mount_equal(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return (F.size(a) == 6) & (F.size(b) == 6) & F.forall(gaps, lambda g: g <= tolerance)


def is_sha256(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_token32(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).rlike("^[0-9a-f]{32}$"), F.lit(False))


def is_token(c: Column) -> Column:
    """1 to 256 characters, none of them blank or a control character."""
    return F.coalesce(strip(c).rlike(r"^[^\x00-\x20]{1,256}$"), F.lit(False))


def content_sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


@F.pandas_udf(T.StringType())
def text17(v: pd.Series) -> pd.Series:
    """17 significant digits, trailing zeros removed; Java's %g keeps them, so this runs in Arrow."""
    return v.map(lambda x: None if pd.isna(x) else format(x, ".17g"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def texts17(v: pd.Series) -> pd.Series:
    return v.map(lambda xs: None if xs is None else [format(x, ".17g") for x in xs])


def map_number(c: Column) -> Column:
    """Canonical number of a map manifest: minus zero is written as zero."""
    return text17(F.when(c == 0, F.lit(0.0)).otherwise(c))


def canonical_sha(fields: dict[str, Column]) -> Column:
    """SHA-256 of compact JSON with sorted keys. Numbers must already be text or integers."""
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}).cast("binary"), 256)


def best_text_of(text: Column, confidence: Column, order: Column) -> Column:
    """The same choice as an aggregate over candidate rows, for any number of them."""
    clean = strip(text)
    usable = clean.rlike(r"[\p{L}\p{N}]") & (confidence > 0)
    return F.min_by(clean, F.when(usable, F.struct((-confidence).alias("c"), order.alias("o"))))


def best_text(candidates: Column) -> Column:
    """Most confident ``STRUCT<text, confidence>`` whose text has a letter or digit; null if none."""
    named = F.transform(candidates, lambda c: F.struct(strip(c["text"]).alias("text"), c["confidence"].alias("confidence")))
    usable = F.filter(named, lambda c: c["text"].rlike(r"[\p{L}\p{N}]") & (c["confidence"] > 0))

    def better(acc: Column, c: Column) -> Column:
        return F.when(acc["confidence"].isNull() | (c["confidence"] > acc["confidence"]), c).otherwise(acc)

    nothing = F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("confidence"))
    return F.aggregate(usable, nothing, better)["text"]
