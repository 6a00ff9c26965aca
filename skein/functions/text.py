"""Text functions: native expressions where Spark has them, Arrow-batched functions for the rest."""


import html
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_space(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_html(c: Column) -> Column:
    """Text without style and script blocks, tags as blanks; entities stay (see decode_entities)."""
    return F.regexp_replace(F.regexp_replace(c, r"(?is)<(?:style|script)[^>]*>.*?</(?:style|script)>", " "), r"<[^>]+>", " ")


def strip_quotes(c: Column) -> Column:
    """Text up to the first signature delimiter, without lines that begin with '>'."""
    text = F.regexp_replace(c, "\r\n", "\n")
    text = F.regexp_replace(text, r"(?s)(?:^|\n)-- ?(?:\n.*)?$", "")
    return F.regexp_replace(text, r"(?m)^>[^\n]*\n?", "")


def model_key(c: Column) -> Column:
    """A model id without blanks around it and without the suffix ':latest'."""
    return F.regexp_replace(F.trim(c), "(?i):latest$", "")


def sender_domain(c: Column) -> Column:
    """What follows the last '@', in lower case, up to '>' or white space; null without '@'."""
    return F.nullif(F.regexp_extract(F.lower(c), r"@([^@\s>]+)[^@]*$", 1), F.lit(""))


def word_array(c: Column, least: int = 1) -> Column:
    """Runs of letters and digits of at least `least` characters, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]{%d,})" % least), 1)


def search_terms(c: Column, most: int = 16) -> Column:
    """A query's distinct words of two characters or more, the first `most` of them."""
    return F.slice(F.array_distinct(word_array(c, 2)), 1, most)


def embedding_input(subject: Column, sender: Column, body: Column, limit: int = 8_000) -> Column:
    """'Subject: ..', 'From: ..', a blank line and the body, without the parts that are null or empty."""
    part = lambda label, c: F.when(F.length(F.trim(c)) > 0, F.concat(F.lit(label), F.trim(c)))
    head = F.concat_ws("\n", part("Subject: ", subject), part("From: ", sender))
    text = F.left(normalize_space(body), F.lit(limit))
    return F.concat_ws("\n\n", F.nullif(head, F.lit("")), F.nullif(text, F.lit("")))


def label_similarity(a: Column, b: Column) -> Column:
    """Shared words over all words of two arrays; 0 where either is empty."""
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def fold(text: str | None) -> str | None:
    """Lower case without accents; what is no letter a-z or digit becomes one blank."""
    if text is None:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in plain).split())


def fnv1a32(text: str | None) -> int | None:
    """FNV-1a over the text's UTF-16 units, as an unsigned 32-bit number."""
    if text is None:
        return None
    h = 0x811C9DC5
    for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist():
        h = ((h ^ unit) * 0x01000193) & 0xFFFFFFFF
    return h


#: Accented small letters of Latin-1 and Latin Extended-A, and what they are without the accent.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def fold_latin(c: Column) -> Column:
    """Lower case without accents, in the JVM; letters outside Latin-1 and Latin Extended-A stay."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def index_words(c: Column) -> Column:
    """The words that the full-text index knows: runs of letters and digits, in lower case, without accents."""
    return F.regexp_extract_all(fold_latin(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def filename_words(c: Column) -> Column:
    """A file name as words: camel case parted, in lower case, without accents, what is no letter a-z or digit as one blank."""
    parted = F.regexp_replace(c, r"(\p{Ll}|\d)(\p{Lu})", "$1 $2")
    return F.trim(F.regexp_replace(fold_latin(parted), "[^a-z0-9]+", " "))


def canonical_key(c: Column) -> Column:
    """A label as a key: fold, '_' for what is no letter a-z or digit, 60 characters, "category" where nothing is left."""
    key = F.left(F.regexp_replace(F.trim(F.regexp_replace(fold_latin(c), "[^a-z0-9]+", " ")), " ", "_"), F.lit(60))
    return F.when(F.length(key) > 0, key).otherwise("category")


def tag_key(prefix: str, c: Column) -> Column:
    """prefix + id in lower case, '_' for what is neither letter a-z, digit, '_' nor '-'."""
    return F.regexp_replace(F.lower(F.concat(F.lit(prefix), c)), "[^a-z0-9_-]", "_")


def folder_name(c: Column, default: str = "Category") -> Column:
    """A label as a folder's name: '-' for slashes, white space as one blank, 100 characters, a default where nothing is left."""
    name = F.left(F.trim(F.regexp_replace(F.regexp_replace(c, r"[/\\\\]", "-"), r"\s+", " ")), F.lit(100))
    return F.when(F.length(name) > 0, name).otherwise(default)


def basic_entities(c: Column) -> Column:
    """The entities amp, lt, gt, quot, apos and nbsp as characters, and numeric ones, in one pass."""
    named = {"nbsp": "\u00a0", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
    for name, char in named.items():
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return F.replace(F.when(c.contains("&#"), numeric_entities(c)).otherwise(c), F.lit("&amp;"), F.lit("&"))


def numeric_entity(text: str | None) -> str | None:
    def char(m):
        n = int(m.group(1)[1:], 16) if m.group(1)[0] in "xX" else int(m.group(1))
        return chr(n) if 0 < n <= 0x10FFFF and not 0xD800 <= n < 0xE000 else m.group()

    return None if text is None else re.sub(r"&#([xX][0-9a-fA-F]{1,6}|\d{1,7});", char, text)


def safe_slice(text: str | None, units: int) -> str | None:
    """The first `units` UTF-16 units of a text; a pair that the cut would part goes."""
    if text is None or len(text) * 2 <= units:
        return text
    return text.encode("utf-16-le", "surrogatepass")[: 2 * units].decode("utf-16-le", "ignore")


def preprocessed(body: Column, is_html: Column, limit: int = 8_000) -> Column:
    """What a body is read as: cut at four times the limit, without markup, quotes and signature, white space as one blank, cut at the limit."""
    text = cut(body, 4 * limit)
    text = F.when(F.coalesce(is_html, F.lit(False)), basic_entities(strip_html(text))).otherwise(text)
    return cut(F.trim(F.regexp_replace(strip_quotes(text), r"(?U)\s+", " ")), limit)


def chunked(text: str | None, most: int = 1_200, overlap: int = 150) -> list[str]:
    """A text in overlapping chunks of at most `most` characters.

    Each ends after the last paragraph, else sentence, else blank of its window, if that lies in the window's second
    half, and the next begins `overlap` characters before that end. Null and blank texts have none.
    """
    most = max(200, most)
    overlap = max(0, min(overlap, most // 2))
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", (text or "").replace("\r\n", "\n"))).strip()
    if len(text) <= most:
        return [text] if text else []
    out, start = [], 0
    while True:
        end = min(start + most, len(text))
        if end < len(text):
            window = text[start:end]
            places = (window.rfind("\n\n") + 2, max(window.rfind(x) for x in (". ", "? ", "! ", ".\n")) + 1, window.rfind(" ") + 1)
            at = places[0] if places[0] > 1 else places[1] or places[2] or len(window)
            if at > most / 2:
                end = start + at
        if piece := text[start:end].strip():
            out.append(piece)
        if end >= len(text):
            return out
        start = max(end - overlap, start + 1)


def _batched(function, kind: str):
    """A function of one value as an Arrow-batched column function; nulls pass."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(function, na_action="ignore")

    return lambda c: F.pandas_udf(run, kind)(c)


fold_accents = _batched(fold, "string")
decode_entities = _batched(html.unescape, "string")
numeric_entities = _batched(numeric_entity, "string")
chunks = _batched(chunked, "array<string>")


def cut(c: Column, units: int) -> Column:
    """safe_slice() of a column; texts that are short enough don't leave the JVM."""
    return F.when(F.length(c) * 2 <= units, c).otherwise(_batched(lambda t: safe_slice(t, units), "string")(c))


def text_hash(c: Column) -> Column:
    """fnv1a32() of a column, in Arrow batches."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(fnv1a32, na_action="ignore").astype("Int64")

    return F.pandas_udf(run, "long")(c)
