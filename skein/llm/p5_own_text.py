"""Problem 5: what the sender newly wrote, without quoted history, signatures and legal small print.

Bodies are exploded to normalised lines; what a line is follows from where its like stands in all other mails: above
quoted text, at the close of the senders' own text, in the last paragraph. Patterns serve only to read markup, quote
marks and header fields, and to mask what differs between lines of one make (names, numbers, addresses).
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.wordlists import slices
from skein.runtime import materialize, spread
from skein.sources import table

BLOCKS = re.compile(r"<(style|script|head)\b[^>]*>.*?</\1\s*>", re.I | re.S)
HAS_MARKUP = re.compile(r"<(?:p|div|br|html|body|blockquote|table|span|hr|small)\b[^<>]*>", re.I)
QUOTE_OPEN = re.compile(r"<blockquote\b[^>]*>", re.I)
QUOTE_CLOSE = re.compile(r"</blockquote\s*>", re.I)
LINE_TAG = re.compile(r"<br\s*/?>|</?(?:li|tr|h\d)\b[^>]*>", re.I)
BLOCK_TAG = re.compile(r"</?(?:p|div|hr|table|small)\b[^>]*>", re.I)
SIGN_OPEN = re.compile(r"<div\b[^>]*(?:class|id)=[\"'][^\"']*(?:\bsig\b|signature)[^\"']*[\"'][^>]*>", re.I)
TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>|<![a-zA-Z][^<>]*>", re.S)
PREFIX = re.compile(r"^[ \t]*(?:\|[ \t]*)*>")
#: A header field of a mail and the year that its date holds.
FIELD = re.compile(r"^\*?[^\W\d_]+(?: [^\W\d_]+)?\*?\s?:\s?\S")
DATED = re.compile(r"\b(?:19|20)\d\d\b")
#: What differs between lines of one make.
MASKS = (
    (re.compile(r"(?<!\S)(?:[^\s@]*@|https?://|www\.)\S+"), "@"),
    (re.compile(r"\b[A-ZÀ-ÖØ-ÞŒŠŽ][\w'’.-]*(?:[ ,/]+[A-ZÀ-ÖØ-ÞŒŠŽ][\w'’.-]*)*"), "X"),
    (re.compile(r"\+?\(?\d(?:[\d .()/:+-]*\d)?\)?"), "0"),
)
HIDDEN = frozenset("x0@")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
CLAUSE_END = re.compile(r"\s*[;:]\s+")
WORDLESS = re.compile(r"[\W_]+")

LINE, SIGNED, MARK, CLAUSE = range(4)
LINES = ["line_no", "stretch", "unit", "kind", "line", "shape", "flag", "long", "plain", "words"]
LINES_DDL = "line_no int, stretch int, unit int, kind int, line long, shape long, flag int, long int, plain int, words int"


def body_lines(body: str) -> list[tuple[str, int, bool]]:
    """Lines of a text or HTML body: (text, depth of block quotes, inside a block marked as signature)."""
    text = body.replace("\r\n", "\n").replace("\r", "\n")
    if HAS_MARKUP.search(text):
        text = BLOCKS.sub("", text)
        text = QUOTE_CLOSE.sub("\n\x02\n", QUOTE_OPEN.sub("\n\x01\n", text))
        text = BLOCK_TAG.sub("\n\n", LINE_TAG.sub("\n", SIGN_OPEN.sub("\n\n\x03\n", text)))
        text = html.unescape(TAG.sub("", text))
    out, depth, signed = [], 0, False
    for x in text.split("\n"):
        x = x.replace("\xa0", " ").strip()
        if x == "\x01":
            depth += 1
        elif x == "\x02":
            depth = max(0, depth - 1)
        elif x == "\x03":
            signed = True
        else:
            if not x and signed and out and out[-1][0]:
                signed = False
            out.append((x, depth, signed))
    return out


def marked(lines: list[tuple[str, int, bool]]) -> list[bool]:
    """Lines quoted by marks: block quotes, prefixes, and header fields (three or more in a row, one with a year) with the paragraph under them."""
    quoted = [depth > 0 or bool(x) and PREFIX.match(x) is not None for x, depth, _ in lines]
    filled = [i for i, line in enumerate(lines) if line[0]]
    fields = [not quoted[i] and FIELD.match(lines[i][0]) is not None for i in filled]
    a = 0
    while a < len(filled):
        b = a
        while b < len(filled) and fields[b] and filled[b] - filled[a] == b - a:
            b += 1
        if b - a >= 3 and any(DATED.search(lines[filled[k]][0]) for k in range(a, b)):
            k = filled[b] if b < len(filled) else len(lines)
            while k < len(lines) and lines[k][0]:
                quoted[k] = True
                k += 1
            for k in range(a, b):
                quoted[filled[k]] = True
        a = max(b, a + 1)
    return quoted


def short(x: str) -> bool:
    return len(x) <= 70 and not (x.endswith((".", "?", "!", ";")) and len(x.split()) > 5)


def goes_on(x: str) -> bool:
    """Whether the line under x is the rest of a sentence broken over lines."""
    return len(x) >= 45 and not x.endswith((".", "!", "?", ":", ";", ","))


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def line_rows(body: str) -> list[tuple]:
    """The rows LINES of a body.

    One a line without quote marks (kind LINE, or SIGNED inside signature markup): `stretch` counts the quotes above it, `line` is
    its normalised text and `shape` that with names, numbers and addresses masked and with what stands above (a blank
    line or not); flag: a quote follows next; long: too long for a closing line, or the rest of the line above; plain: it holds letters or digits. One
    row MARK where the body has quotes. One a CLAUSE of 24 or more masked characters and four words that no mask hides: flag: in the last paragraph of its
    stretch (or the last but a line above a quote), words: those of its sentence. `unit` ties clauses to lines: lines of one paragraph, ended after each line of
    less than 45 characters.
    """
    lines = body_lines(body)
    quoted = marked(lines)
    masked = "\n".join(x.capitalize() if len(x) > 20 and x.isupper() else x for x, _, _ in lines)
    for pattern, by in MASKS:
        if by != "@" or "@" in masked or "://" in masked or "www." in masked:
            masked = pattern.sub(by, masked)
    masked = masked.lower().split("\n")
    out, n = [], len(lines)
    if any(quoted):
        out.append((0, 0, 0, MARK, 0, 0, 0, 0, 0, 0))
    stretch = unit = 0
    paragraphs: list[list[int]] = []
    i = 0
    while i <= n:
        if i == n or quoted[i]:
            if paragraphs:
                end = len(paragraphs) - (i < n and len(paragraphs) > 1 and len(paragraphs[-1]) == 1)  # a line above a quote may lead in
                for p, paragraph in enumerate(paragraphs):
                    last = int(p + 1 >= end)
                    text: list[str] = []
                    for k in paragraph:
                        x, _, signed = lines[k]
                        after = next((j for j in range(k + 1, min(n, k + 40)) if lines[j][0]), None)
                        shape = digest(masked[k] + ("\n" if k == 0 or not lines[k - 1][0] else ""))
                        out.append((k, stretch, unit, SIGNED if signed else LINE, digest(" ".join(x.lower().split())), shape, int(after is not None and quoted[after]), int(not short(x) or goes_on(lines[k - 1][0] if k != paragraph[0] else "")), int(WORDLESS.fullmatch(x) is None), len(x)))
                        text.append(masked[k])
                        if len(x) < 45 or k == paragraph[-1]:
                            for sentence in SENTENCE.split(" ".join(text)):
                                if len(sentence) >= 24:
                                    words = len(sentence.split())
                                    for c in CLAUSE_END.split(sentence):
                                        c = " ".join(c.strip(" .!?;").split())
                                        if len(c) >= 24 and len([w for w in c.split() if w not in HIDDEN]) >= 4:
                                            out.append((k, stretch, unit, CLAUSE, 0, digest("clause " + c), last, 0, 0, words))
                            unit += 1
                            text = []
                stretch, paragraphs = stretch + 1, []
        elif lines[i][0]:
            if i and paragraphs and lines[i - 1][0] and not quoted[i - 1]:
                paragraphs[-1].append(i)
            else:
                paragraphs.append([i])
        i += 1
    return out


def mails(emails: DataFrame) -> DataFrame:
    """(email_rowid, account, sender, thread, at, text): hashes of the account, of the address in from_addr and of the subject without reply marks and tags (without a subject the mail is its own thread); the date in ms, else the time of indexing."""
    at = F.when(F.col("date_ms") < 100_000_000_000, F.col("date_ms") * 1000).otherwise(F.col("date_ms"))
    address = F.lower(F.regexp_extract("from_addr", r"([^\s<>\"'(),;:]+@[^\s<>\"'(),;:]+)", 1))
    subject = F.lower(F.trim(F.regexp_replace("subject", r"(?i)^(?:\s*(?:(?:re|fwd?|aw|wg|tr|rv|antw|\(copy\))\s*:|\(copy\)|\[[^\]]{0,40}\])\s*)+", "")))
    return emails.where(F.col("email_rowid").isNotNull() & F.col("body").isNotNull()).select(
        F.col("email_rowid").cast("long").alias("email_rowid"), F.xxhash64("account_id").alias("account"), F.xxhash64(F.when(address == "", F.lower("from_addr")).otherwise(address)).alias("sender"),
        F.when(F.length(subject) >= 4, F.xxhash64(subject)).otherwise(F.xxhash64("email_rowid")).alias("thread"), F.coalesce(at, F.unix_millis("indexed_at"), F.lit(1 << 62)).alias("at"), F.col("body").alias("text"),
    )


def exploded(rows: DataFrame) -> DataFrame:
    """The lines and clauses of each mail (see line_rows) with its account, sender, thread and date."""
    heads = ["email_rowid", "account", "sender", "thread", "at"]

    def read(batches):
        for b in slices(batches):
            cols: list[list] = [[] for _ in LINES]
            row = []
            for r, body in enumerate(b["text"]):
                found = line_rows(body.as_py())
                row += [r] * len(found)
                for c, values in zip(cols, zip(*found)):
                    c.extend(values)
            at = pa.array(row, pa.int64())
            types = [pa.int64() if c in ("line", "shape") else pa.int32() for c in LINES]
            yield pa.RecordBatch.from_arrays([*[b[c].take(at) for c in heads], *[pa.array(c, t) for c, t in zip(cols, types)]], [*heads, *LINES])

    return spread(rows).mapInArrow(read, "email_rowid long, account long, sender long, thread long, at long, " + LINES_DDL)


def lower_bound(hits: Column, n: Column) -> Column:
    """Wilson's lower bound (95 %) of a share: `hits` of `n`."""
    p, z = hits / n, 1.96
    return (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def habits(rows: DataFrame, flag: str, least_share: Column | float, least_threads: int) -> DataFrame:
    """Shapes found in `least_threads` threads and with more than one sender, for which `flag` holds in a share whose lower bound is at least `least_share`.

    A thread counts once, whatever the number of copies of its mails. Both aggregations combine before the shuffle, so
    that a line which a third of all mails hold is no task's burden.
    """
    per = rows.groupBy("shape", "kind", "thread").agg(F.avg(flag).alias("share"), F.min("sender").alias("low"), F.max("sender").alias("high"))
    of = per.groupBy("shape", "kind").agg(F.count(F.lit(1)).alias("threads"), F.sum("share").alias("hits"), F.min("low").alias("low"), F.max("high").alias("high"))
    held = (F.col("threads") >= least_threads) & (F.col("low") != F.col("high"))
    return of.where(held & (lower_bound(F.col("hits"), F.col("threads")) >= least_share)).select("shape", "kind")


def judged(lines: DataFrame, least_threads: int = 8, lead_share: float = 0.4, print_share: float = 0.6, least_words: int = 12, closing_lines: int = 10) -> DataFrame:
    """The lines without quote marks, each as lead-in, small print or candidate for a closing line: (email_rowid, account, sender, thread, at, line_no, part, line, shape, words, signed, lead, print, closing).

    A shape after which quotes stand in other mails is a lead-in wherever it stands. A clause that closes other mails'
    text is small print, if its sentence has `least_words` words; it makes all lines of its unit small print, with the
    lines right above and rules around. What is left, cut at quotes, lead-ins and small print, is the sender's: of each
    part the last lines, up to `closing_lines` and as long as they are short, are candidates (`closing`), if any line of
    the mail stands above. The windows are those of one mail.
    """
    least = F.when(F.col("kind") == CLAUSE, print_share).otherwise(lead_share)
    known = materialize(habits(lines.where(F.col("kind") != MARK).withColumn("kind", F.when(F.col("kind") == CLAUSE, CLAUSE).otherwise(LINE)), "flag", least, least_threads))
    rows = lines.where(F.col("kind") != MARK).join(known.select("shape", F.lit(True).alias("known")), "shape", "left")
    rows = rows.where((F.col("kind") != CLAUSE) | F.col("known") & (F.col("words") >= least_words)).repartition("email_rowid")
    legal = F.max(F.col("kind") == CLAUSE).over(Window.partitionBy("email_rowid", "unit"))
    rows = rows.withColumn("legal", legal).where(F.col("kind") != CLAUSE)
    mail = Window.partitionBy("email_rowid").orderBy("line_no")
    above = F.coalesce(F.lead("legal").over(mail), F.lit(False)) & ((F.lead("line_no").over(mail) == F.col("line_no") + 1) | (F.col("plain") == 0))
    below = F.coalesce(F.lag("legal").over(mail), F.lit(False)) & (F.col("plain") == 0)
    rows = rows.withColumn("print", F.col("legal") | above & (F.col("long") == 0) | below).withColumn("lead", F.coalesce("known", F.lit(False)) & ~F.col("print"))
    cut = (F.col("print") | F.col("lead")).cast("int")
    rows = rows.withColumn("part", F.sum(cut).over(mail)).withColumn("own", cut == 0).withColumn("held", F.sum(1 - cut).over(mail))
    tail = Window.partitionBy("email_rowid", "stretch", "part", "own").orderBy(F.desc("line_no"))
    closing = F.col("own") & (F.max("long").over(tail) == 0) & (F.row_number().over(tail) <= closing_lines) & ((F.col("held") > 1) | (F.col("stretch") > 0))
    return rows.withColumn("closing", closing).select("email_rowid", "account", "sender", "thread", "at", "line_no", (F.col("part") + F.lit(1000) * F.col("stretch")).alias("part"), "line", "shape", F.lit(LINE).alias("kind"), "words", (F.col("kind") == SIGNED).alias("signed"), "lead", "print", "closing")


def signatures(lines: DataFrame, least_threads: int = 8, closing_share: float = 0.7, sender_threads: int = 3) -> DataFrame:
    """(email_rowid, part, line_no) of the candidates that are closing lines: of a shape that closes the mails of many threads, or that the same sender closed mails of `sender_threads` threads with."""
    own = lines.where(~F.col("lead") & ~F.col("print"))
    common = habits(own.withColumn("flag", F.col("closing").cast("int")), "flag", closing_share, least_threads).select("shape")
    ends = own.where("closing")
    again = ends.groupBy("sender", "line", "thread").agg(F.count(F.lit(1)).alias("n")).groupBy("sender", "line").agg(F.count(F.lit(1)).alias("threads")).where(F.col("threads") >= sender_threads)
    at = ["email_rowid", "part", "line_no"]
    return ends.join(common, "shape", "left_semi").select(*at).unionByName(ends.join(again, ["sender", "line"], "left_semi").select(*at)).unionByName(lines.where("signed").select(*at)).distinct()


def quoted_lines(lines: DataFrame, least_chars: int = 25) -> DataFrame:
    """(email_rowid, line_no) of lines that another sender wrote earlier in the thread of the same account.

    The first author of a line in a thread is the message with the earliest date (ties: the smaller row id). That is
    aggregated before the shuffle in place of a rank over all messages that hold the line. One line alone, or as many as
    half of the mail, make no quote: a copy of a whole mail keeps its text.
    """
    own = lines.where(~F.col("lead") & ~F.col("print"))
    told = own.where(~F.col("closing") & (F.col("words") >= least_chars)).select("email_rowid", "account", "thread", "line", "line_no", "sender", "at")
    by = ["account", "thread", "line"]
    first = told.groupBy(*by).agg(F.min(F.struct("at", "email_rowid", "sender")).alias("first"), F.min("sender").alias("low"), F.max("sender").alias("high")).where("low <> high").select(*by, "first")
    again = told.join(first, by).where((F.col("first.sender") != F.col("sender")) & (F.col("first.email_rowid") != F.col("email_rowid"))).select("email_rowid", "line_no").distinct()
    counts = again.groupBy("email_rowid").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    held = own.join(counts.select("email_rowid"), "email_rowid", "left_semi").groupBy("email_rowid").agg(F.count_distinct("line_no").alias("own"))
    return again.join(counts.join(held, "email_rowid").where(F.col("n") < 0.5 * F.col("own")).select("email_rowid"), "email_rowid", "left_semi")


def evidence(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All exploded rows, the judged lines, the closing lines and the lines first written by others, of mails (see mails)."""
    lines = materialize(exploded(rows))
    own = materialize(judged(lines))
    return lines, own, signatures(own), quoted_lines(own)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The kinds of foreign matter in each email's body."""
    lines, own, signed, again = evidence(mails(table(spark, folder, "emails")))
    of = lambda df, kind: df.select("email_rowid", F.lit(kind).alias("removed_kind"))
    quote = of(lines.where(F.col("kind") == MARK), "quote").unionByName(of(own.where("lead"), "quote")).unionByName(of(again, "quote"))
    return quote.unionByName(of(signed, "signature")).unionByName(of(own.where("print"), "disclaimer")).distinct()


def remaining(body: str, leads: set[int], gone: set[int]) -> str:
    """A body's text without quotes, the lines `gone`, and lead-ins with the paragraph under them."""
    lines = body_lines(body)
    drop = [q or i in gone or i in leads for i, q in enumerate(marked(lines))]
    for i in leads:
        k = next((j for j in range(i + 1, len(lines)) if lines[j][0]), len(lines))
        while k < len(lines) and lines[k][0] and not drop[k]:
            drop[k] = True
            k += 1
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x for (x, _, _), d in zip(lines, drop) if not d)).strip()


def p5_own_text(spark: SparkSession, folder: str) -> DataFrame:
    """Each email's newly written text; repeated rows once. The part from the first closing line on is its signature."""
    rows = mails(table(spark, folder, "emails")).dropDuplicates(["email_rowid"])
    _, own, signed, again = evidence(rows)
    start = signed.groupBy("email_rowid", "part").agg(F.min("line_no").alias("start"))
    closing = own.where("closing").join(start, ["email_rowid", "part"]).where(F.col("line_no") >= F.col("start")).select("email_rowid", "line_no")
    gone = closing.unionByName(own.where("print").select("email_rowid", "line_no")).unionByName(again).select("*", F.lit(False).alias("lead")).unionByName(own.where("lead").select("email_rowid", "line_no", F.lit(True).alias("lead")))
    known = gone.groupBy("email_rowid").agg(F.collect_set(F.when(F.col("lead"), F.col("line_no"))).alias("leads"), F.collect_set(F.when(~F.col("lead"), F.col("line_no"))).alias("gone"))

    def read(batches):
        for b in slices(batches):
            out = [remaining(t, set(a or ()), set(g or ())) for t, a, g in zip(b["text"].to_pylist(), b["leads"].to_pylist(), b["gone"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["email_rowid"], pa.array(out, pa.string())], ["email_rowid", "own_text"])

    return rows.select("email_rowid", "text").join(known, "email_rowid", "left").select("email_rowid", "text", "leads", "gone").mapInArrow(read, "email_rowid long, own_text string")


QUERIES = {"p5_found": p5_found, "p5_own_text": p5_own_text}
