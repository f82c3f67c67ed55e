"""Column expressions on claim and log text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAK = r"[^\p{L}\p{N}_]+"


def known_words(text: Column, keywords: Iterable[str]) -> Column:
    """Those single-word keywords that occur as whole words: one pass, however many there are."""
    single = sorted({k for k in keywords if " " not in k})
    return F.array_intersect(F.split(text, WORD_BREAK), F.array(*[F.lit(k) for k in single]))


def first_mention(text: Column, found: Column, keywords: Iterable[str]) -> Column:
    """The first keyword, in alphabetical order, that the text mentions.

    A single word counts when it is among ``found``, a phrase when it occurs anywhere."""
    return F.coalesce(*[
        F.when(text.contains(k) if " " in k else F.array_contains(found, k), F.lit(k)) for k in sorted(keywords)
    ])


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def citation_ids(text: Column) -> Column:
    """IDs inside the first ``[evidence: A, B]`` of a text."""
    inner = F.regexp_extract(text, r"\[evidence:([^\]]*)", 1)
    ids = F.transform(F.split(inner, ","), strip)
    return F.when(text.contains("[evidence:"), ids).otherwise(F.array().cast("array<string>"))


def strip_citations(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s*\[evidence:[^\]]+\]", ""))


def names_firmware(text: Column) -> Column:
    return text.contains("ArduPilot") | text.contains("Copter") | text.contains("Plane")


def vehicle_class_in(text: Column) -> Column:
    """Vehicle class named in a firmware line; NULL when the line names none."""
    return (
        F.when(text.contains("Copter") | text.contains("Quad") | text.contains("Hexa"), "multirotor")
        .when(text.contains("Plane"), "fixed_wing")
        .when(text.contains("Rover"), "rover")
    )
