"""Messages as flattened parts: an array of structs (content_type, body, filename, disposition), depth first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = "array<struct<content_type: string, body: string, filename: string, disposition: string>>"


def _first(parts: Column, kind: str) -> Column:
    hit = F.filter(parts, lambda p: (F.lower(p["content_type"]) == kind) & (F.length(F.trim(p["body"])) > 0))
    return F.try_element_at(F.transform(hit, lambda p: p["body"]), F.lit(1))


def body_text(parts: Column) -> Column:
    """The first text/plain part that isn't blank, else the first such text/html part; null without either."""
    return F.coalesce(_first(parts, "text/plain"), _first(parts, "text/html"))


def body_format(parts: Column) -> Column:
    """text or html, as body_text() takes it; null without a body."""
    return F.when(_first(parts, "text/plain").isNotNull(), "text").when(_first(parts, "text/html").isNotNull(), "html")


def has_attachments(parts: Column) -> Column:
    """Whether a part is sent as an attachment, or has a name and is neither a body nor inline; false for null."""
    body = lambda p: F.lower(p["content_type"]).isin("text/plain", "text/html")
    named = lambda p: (F.length(p["filename"]) > 0) & ~F.coalesce(body(p), F.lit(False)) & (F.coalesce(F.lower(p["disposition"]), F.lit("")) != "inline")
    return F.coalesce(F.exists(parts, lambda p: (F.coalesce(F.lower(p["disposition"]), F.lit("")) == "attachment") | F.coalesce(named(p), F.lit(False))), F.lit(False))
