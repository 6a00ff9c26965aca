"""Problem 1: splitting oversized texts at natural boundaries by dynamic programming."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.runtime import spread
from skein.sources import table

#: Boundary levels and what a cut there costs, beside the squared share by which a piece falls short of the even size.
PARAGRAPH, LINE, SENTENCE, WORD, INSIDE = range(5)
PENALTY = (0.0, 0.15, 0.3, 2.0, 8.0)
BLANKS = re.compile(r"[ \t]+")
NEWLINES = re.compile(r"\n{3,}")
BREAKS = re.compile(r"\n\n+|\n|(?<=[.!?…])[\"'»”’)\]]*\s+")
SPACES = re.compile(r"\s+")


def tidy(text: str) -> str:
    """CRLF to LF, runs of blanks and tabs to one blank, three or more LF to two, no white space at the ends."""
    return NEWLINES.sub("\n\n", BLANKS.sub(" ", text.replace("\r\n", "\n"))).strip()


def boundaries(text: str, fine: int) -> list[tuple[int, int, int]]:
    """Places (end of the piece before, start of the text after, level) where text may be cut, in order.

    Word boundaries are places only within sentences longer than `fine` characters, and single characters only within
    words longer than that, so that any two neighbouring places are at most about `fine` apart.
    """
    out: list[tuple[int, int, int]] = []

    def between(a: int, b: int) -> None:
        if b - a <= fine:
            return
        last = a
        for m in [*SPACES.finditer(text, a + 1, b - 1), None]:
            end = m.start() if m else b
            while end - last > fine:
                last += fine
                out.append((last, last, INSIDE))
            if m:
                out.append((m.start(), m.end(), WORD))
                last = m.end()

    at = 0
    for m in BREAKS.finditer(text):
        if m.end() >= len(text):
            break
        gap = m.group()
        end = m.start() + len(gap) - len(gap.lstrip("\"'»”’)]"))
        level = PARAGRAPH if gap.count("\n") > 1 else LINE if "\n" in gap else SENTENCE
        between(at, end)
        out.append((end, m.end(), level))
        at = m.end()
    between(at, len(text))
    return out


def overlap_start(text: str, start: int, least: int, overlap: int) -> int:
    """Where a piece whose own text begins at start takes up the text before: at a word, at most `overlap` characters back, after `least`."""
    low = max(least, start - overlap)
    if overlap <= 0 or low >= start:
        return start
    if low > 0 and not text[low - 1].isspace():
        m = SPACES.search(text, low, start)
        if m is None:  # an unbroken run
            return low
        low = m.end()
    while low < start and text[low].isspace():
        low += 1
    return low


def split_text(text: str | None, limit: int = 1_200, overlap: int = 150) -> list[tuple[int, int, int]]:
    """Pieces (start, own_start, end) of a tidied text: text[start:end] is at most `limit` long, own_start is where its overlap ends.

    Cuts minimise the sum of cut penalties and of the squared shortfalls against an even division. No pieces for an
    empty text, one for a text within the limit. An overlap of the limit or more is refused.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    if not text:
        return []
    if len(text) <= limit:
        return [(0, 0, len(text))]
    fine = max(1, (limit - overlap) // 4)
    places = [(0, 0, PARAGRAPH), *boundaries(text, fine), (len(text), len(text), PARAGRAPH)]
    n = len(places)
    starts = [0] + [overlap_start(text, s, 0, overlap) for _, s, _ in places[1:-1]] + [len(text)]
    number = max(2, -(-(len(text) - overlap) // max(1, limit - overlap)))
    even = min(limit - overlap, len(text) / number)
    best, back = [0.0] + [float("inf")] * (n - 1), [0] * n
    for j in range(1, n):
        end, _, level = places[j]
        cost = PENALTY[level] if j < n - 1 else 0.0
        i = j - 1
        while i >= 0 and end - starts[i] <= limit:
            short = (end - places[i][1]) / even - 1
            c = best[i] + 0.2 + cost + short * short
            if c < best[j]:
                best[j], back[j] = c, i
            i -= 1
    cuts, j = [], n - 1
    while j > 0:
        i = back[j]
        cuts.append((starts[i], places[i][1], places[j][0]))
        j = i
    return cuts[::-1]


def split_items(df: DataFrame, kind: str, key: str, text: str, limit: int = 1_200, overlap: int = 150, with_text: bool = True, once: bool = False) -> DataFrame:
    """(item_kind, item_rowid, piece_no, pieces, start, own_start, length[, text]) of each item's tidied text.

    Whole texts are read, however long; null keys are dropped, null, empty and blank texts give no piece, repeated rows
    give equal rows, unless `once` drops repeated keys before the texts are cut. Positions count Unicode characters of the
    tidied text.
    """
    rows = df.select(F.col(key).cast("long").alias("item_rowid"), F.col(text).alias("text")).where(F.col("item_rowid").isNotNull() & F.col("text").isNotNull())
    if once:
        rows = rows.dropDuplicates(["item_rowid"])
    names = ["item_rowid", "piece_no", "pieces", "start", "own_start", "length"] + ["text"] * with_text

    def cut(batches):
        for b in batches:
            ids, no, count, start, own, length, out = [], [], [], [], [], [], []
            for i, t in zip(b["item_rowid"].to_pylist(), b["text"]):
                t = tidy(t.as_py())
                pieces = split_text(t, limit, overlap)
                for k, (a, o, e) in enumerate(pieces):
                    ids.append(i), no.append(k), count.append(len(pieces)), start.append(a), own.append(o), length.append(e - a)
                    if with_text:
                        out.append(t[a:e])
            cols = [pa.array(ids, pa.int64())] + [pa.array(c, pa.int32()) for c in (no, count, start, own, length)] + [pa.array(out, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(cols, names)

    done = spread(rows).mapInArrow(cut, "item_rowid long, piece_no int, pieces int, start int, own_start int, length int" + ", text string" * with_text)
    return done.select(F.lit(kind).alias("item_kind"), *names)


def pieces(spark: SparkSession, folder: str, with_text: bool) -> DataFrame:
    mails = split_items(table(spark, folder, "emails"), "email", "email_rowid", "body", with_text=with_text, once=with_text)
    return mails.unionByName(split_items(table(spark, folder, "attachment_chunks"), "chunk", "chunk_rowid", "text", with_text=with_text, once=with_text))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items that had to be cut."""
    cut = pieces(spark, folder, False).where((F.col("pieces") > 1) & (F.col("piece_no") == 0))
    return cut.select("item_kind", "item_rowid").distinct()


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces with their texts; repeated rows once."""
    return pieces(spark, folder, True)


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}
ORACLE_SQL = {
    "p1_found": r"""
with t as (
  select 'email' as item_kind, email_rowid as item_rowid, body as text from emails
  union all select 'chunk', chunk_rowid, text from attachment_chunks),
n as (select item_kind, item_rowid, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as text from t)
select distinct item_kind, item_rowid from n where length(text) > 1200"""
}
