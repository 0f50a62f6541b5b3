"""Findings, attention, limits and invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.schema import FINDINGS, LIMITS


def findings(triggers: dict[str, Column]) -> Column:
    """Codes whose trigger holds, in report order; a null trigger doesn't hold."""
    codes = F.array(*(F.when(triggers[c], c) for c, _, _ in FINDINGS if c in triggers))
    return F.filter(codes, lambda c: c.isNotNull())


def triggers(c: dict[str, Column]) -> dict[str, Column]:
    """Triggers of all findings, from the counters of a page: those that c has."""
    positive = {
        "MISSING_UNICODE": "missing", "REPLACEMENT_CHARACTERS": "replacement", "TINY_TEXT": "tiny", "MALFORMED_TOUNICODE_CMAP": "malformed", "INVALID_TOUNICODE_CMAP": "invalid", "IMPLICIT_COMPOSITE_UNICODE_MAPPING": "implicit",
        "RTL_TEXT_REQUIRES_EXTRACTION_PROFILE": "rtl", "ANNOTATION_MISSING_UNICODE": "annotation_missing", "ANNOTATION_REPLACEMENT_CHARACTERS": "annotation_replacement",
    }
    out = {code: c[k] > 0 for code, k in positive.items() if k in c}
    if "glyphs" in c:
        out["NO_TEXT_LAYER"] = c["glyphs"] == 0
    if "diverges" in c:
        out["READING_ORDER_DIVERGENCE"] = c["diverges"]
    if "classification" in c:
        out["SPARSE_TEXT_OVER_FULL_PAGE_IMAGE"] = c["classification"] == "SPARSE_OCR"
        out["PARTIAL_TEXT_OVER_FULL_PAGE_IMAGE"] = c["classification"] == "PARTIAL_OCR"
    return out


def finding_table(spark) -> DataFrame:
    """The dimension (ordinal, code, description, located): a fixed small table."""
    return spark.createDataFrame([(i, *f) for i, f in enumerate(FINDINGS)], "ordinal int, code string, description string, located boolean")


def report_attention(recovered: Column, complete: Column, profile: Column, any_page: Column) -> Column:
    return recovered | ~complete | profile | any_page


def direct_routing(flags: list[Column]) -> Column:
    out = F.lit(True)
    for f in flags:
        out = out & f
    return out


def limit_code(counts: dict[str, Column], limits: dict[str, int] | None = None) -> Column:
    """The first limit, in working order, that a count exceeds; null if none."""
    limits = {c: d for c, _, d in LIMITS} | (limits or {})
    out = F.lit(None).cast("string")
    for code, _, _ in reversed(LIMITS):
        if code in counts:
            out = F.when(counts[code] > limits[code], code).otherwise(out)
    return out


def limit_message(code: Column, limits: dict[str, int] | None = None) -> Column:
    limits = {c: d for c, _, d in LIMITS} | (limits or {})
    out = None
    for c, label, _ in LIMITS:
        said = F.lit(f"PDF exceeds the configured {label} limit of {limits[c]}")
        out = F.when(code == c, said) if out is None else out.when(code == c, said)
    return out


def invariants(c: dict[str, Column]) -> dict[str, Column]:
    """Checks that must hold for each row, of the columns that c has; null columns mean not assessed and hold."""
    rules = {
        "signatures_within_fields": (("signatures", "fields"), lambda a, b: a <= b),
        "shares_in_order": (("max_share", "combined_share"), lambda a, b: (a >= 0) & (a <= b) & (b <= 1)),
        "cells_within_grid": (("image_cells", "text_cells"), lambda a, b: (a <= 64) & (b <= 64)),
        "overlap_within_cells": (("overlap_cells", "image_cells"), lambda a, b: a <= b),
        "resolved_within_unmapped": (("resolved", "unmapped"), lambda a, b: a <= b),
        "missing_within_glyphs": (("missing", "glyphs"), lambda a, b: a <= b),
        "hidden_within_references": (("hidden", "references"), lambda a, b: a <= b),
        "regions_add_up": (("regions", "regions_by_type"), lambda a, b: a == b),
    }
    return {k: F.coalesce(f(*(c[x] for x in need)), F.lit(True)) for k, (need, f) in rules.items() if all(x in c for x in need)}
