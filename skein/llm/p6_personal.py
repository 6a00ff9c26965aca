"""Problem 6: personal information in free text: proposed by patterns, confirmed by checksums, scored by context."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.wordlists import slices
from skein.runtime import spread
from skein.sources import table

PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street": "[STREET]", "person": "[PERSON]", "iban": "[IBAN]", "card": "[CARD]"}
#: The kinds that p6_found gives; account and card numbers are redacted as well.
FOUND = ("email", "phone", "id_number", "street", "person")

UP = r"[A-ZÀ-ÖØ-ÞŒŠŽ]"
DOT = r"(?:\.|\s?[\[({]\s?(?:dot|punkt|punto|point)\s?[\])}]\s?|\s(?:dot|punkt|punto)\s)"
AT = r"(?:@|\s?[\[({]\s?(?:at|@|a|arroba)\s?[\])}]\s?|\sat\s|\sarroba\s)"
EMAIL_PLAIN = re.compile(r"(?<![\w.%+'-])[\w.%+'-]*[\w%+-]@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
EMAIL_SPELT = re.compile(rf"[A-Za-z0-9_%+-]+(?:{DOT}[A-Za-z0-9_%+-]+)*{AT}[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+", re.I)
EMAIL_WORD = re.compile(r"(?<![\w.%+-])(?:[A-Za-z0-9._%+-]+\s(?:AT|ARROBA)|[A-Za-z0-9-]*[._%+\d][A-Za-z0-9._%+-]*\s(?:at|arroba))\s[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z][A-Za-z0-9-]*)+")
SPELT_AT = re.compile(r" (?:AT|at|ARROBA|arroba) ")
SPELT_HINT = re.compile(r"[\[({]\s?(?:dot|at|punkt|punto|point|arroba)\s?[\])}]|\s(?:dot|punkt|arroba)\s", re.I)

PHONE = re.compile(r"(?<![\w.,/#+€$£-])(?:\+\d{1,3}[\s.-]?(?:\(0\)\s?)?(?:\(?\d{1,5}\)?[\s./-]?){2,6}\d|\(0?\d{1,4}\)[\s./-]?\d[\d\s./-]{4,12}\d|0\d{1,5}(?:[\s./-]?\d{1,8}){1,5}|[2-9]\d{2}[\s.-]\d{3}[\s.-]\d{3,4}|[6-9]\d{8})(?![\w/#€]|[.,-]\d)")
PHONE_BEFORE = re.compile(r"(?:\btel|\btél|\bt|\bm|\bf|\bmobil\w*|\bmóvil|\bphone|\bfax|\bcall(?: me)?(?: on| at)?|\breach me on|\breach (?:me|us) (?:on|at)|\bllamarme al|\bjoindre au|\berreichen (?:mich|uns) unter|\bunter|\bhandy|\btelefon\w*|\btfno)[.:]?\s*$", re.I)
PHONE_AGAINST = re.compile(r"(?:\bnumber|\bnumm?er|\bnuméro|\bnúmero|\bticket|\bcase|\bstock|\bpage|\border|\binvoice|\bref\w*|\bid|#|€|\beur|\blautet|\bsécurité(?: est)?(?: le)?|\bdocumento(?: es)?(?: el)?|\bis)\s*$", re.I)

ID_WORDS = re.compile(r"\b(?:social|security|ssn|passport|passe?port|passeport|pasaporte|reisepass|ausweis\w*|personal\w*|tax|steuer\w*|steuernummer|tin|nif|nie|dni|documento|sécurité|sécu|insee|nir|identity|identité|identidad|id|national insurance)\b", re.I)
NINO = re.compile(r"(?<![\w-])[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D](?!\w)|(?<![\w-])QQ\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D](?!\w)")
SSN = re.compile(r"(?<![\w./#+-])\d{3}([\s-]?)\d{2}\1\d{4}(?![\w/-]|[.,]\d)")
NIR = re.compile(r"(?<![\w./#+-])\d\s?\d{2}\s?\d{2}\s?\d[\dAB]\s?\d{3}\s?\d{3}\s?\d{2}(?![\w/-]|[.,]\d)")
TAX_DE = re.compile(r"(?<![\w./#+-])\d{2}\s?\d{3}\s?\d{3}\s?\d{3}(?![\w/-]|[.,]\d)")
DNI = re.compile(r"(?<![\w./#+-])(?:[XYZ]-?)?\d{1,2}\.?\d{3}\.?\d{3}-?[A-HJ-NP-TV-Z](?!\w)")
PASSPORT = re.compile(r"(?<![\w/#-])[A-Z]{1,2}\d{6,8}(?!\w)")
CARD = re.compile(r"(?<![\w./#+-])\d(?:[\s-]?\d){12,18}(?![\w/-])")
CARD_GROUPS = re.compile(r"\d{4}([\s-])\d{4}\1\d{4}\1\d{4}")
CARD_WORDS = re.compile(r"\b(?:card|karte|kartennummer|kreditkarte|carte|tarjeta|visa|mastercard|credit|crédit|crédito)\b", re.I)
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)")
IBAN_WORDS = re.compile(r"\b(?:iban|account|konto|kontonummer|compte|cuenta)\b", re.I)

TOWN = rf"{UP}[\w'’-]+(?:[ -](?:am|an der|sur|sous|de|del|la)[ -]{UP}[\w'’-]+)?"
POSTCODE_UK = r"[A-Z]{1,2}\d{1,2}[A-Z]?\s\d[A-Z]{2}"
STREETS = [
    re.compile(rf"(?<![\w#-])(?:(?:Flat|Apt\.?|Apartment|Unit)\s\d+[A-Za-z]?,?\s)?\d+[a-zA-Z]?,?\s(?:{UP}[\w'’.-]+\s){{1,3}}(?:Lane|Close|Street|St|Road|Rd|Way|Avenue|Ave|Drive|Dr|Court|Row|Terrace|Crescent|Gardens|Hill|Place|Square|Walk|Mews|Grove)\b\.?(?:,?\s{TOWN}(?:,?\s{POSTCODE_UK})?|,?\s{POSTCODE_UK})?"),
    re.compile(rf"(?<![\w#-])(?:{UP}[\w'’.-]+[\s-])?{UP}[\w'’-]*?(?:straße|strasse|str\.|weg|platz|gasse|allee|damm|ufer|steig|pfad)\s\d+(?:\s?[a-z]\b)?(?:,?\s\d{{5}}(?:\s{TOWN})?)?(?!\w)|(?<![\w#-])(?:Am|An der|An den|Auf dem|Im|In der|Zum|Zur|Unter den)\s{UP}[\w'’-]+(?:\s{UP}[\w'’-]+)?\s\d+(?:\s?[a-z]\b)?,?\s\d{{5}}(?:\s{TOWN})?"),
    re.compile(rf"(?<![\w#-])\d+(?:\s?(?:bis|ter|[a-zA-Z])\b)?,?\s(?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Pp]lace|[Cc]hemin|[Aa]llée|[Ii]mpasse|[Qq]uai|[Rr]oute|[Cc]ours|[Ss]quare|[Ss]entier|[Pp]assage)\s(?:(?:de la|de|du|des|la|le|les|au|aux)\s|(?:de\s)?[ld]['’])*[\w'’-]+(?:\s{UP}[\w'’-]+)*(?:,?\s\d{{5}}(?:\s{TOWN})?)?"),
    re.compile(rf"(?<![\w#-])(?:[Cc]alle|C/|[Aa]venida|[Aa]vda\.?|[Pp]laza|[Pp]aseo|[Cc]amino|[Rr]onda|[Tt]ravesía|[Cc]arretera)\s(?:(?:de las|de los|de la|del|de|la|el|los|las)\s)*[\w'’-]+(?:\s{UP}[\w'’-]+)*,?\s(?:n[.º°]*\s?)?\d+(?:\s?[a-z]\b)?(?:,?\s(?:piso|puerta|bajo|\d+[ºª])\s?\w*)?(?:,?\s\d{{5}}(?:\s{TOWN})?)?"),
]
#: Substrings, one of which each match of the pattern of the same place holds once white space is written as single blanks.
STREET_HINTS = [
    (" Lane", " Close", " Street", " St", " Road", " Rd", " Way", " Ave", " Drive", " Dr", " Court", " Row", " Terrace", " Crescent", " Gardens", " Hill", " Place", " Square", " Walk", " Mews", " Grove"),
    ("straße ", "strasse ", "str. ", "weg ", "platz ", "gasse ", "allee ", "damm ", "ufer ", "steig ", "pfad ", "Am ", "An de", "Auf dem", "Im ", "In der", "Zum ", "Zur ", "Unter den"),
    ("ue ", "venue ", "oulevard ", "lace ", "hemin ", "llée ", "mpasse ", "uai ", "oute ", "ours ", "quare ", "entier ", "assage "),
    ("alle ", "C/", "venida ", "vda", "laza ", "aseo ", "amino ", "onda ", "ravesía ", "arretera "),
]
#: Six or more digits with little between them: only there are numbers of persons sought.
CLUSTER = re.compile(r"\d(?:[\s./()-]{0,2}\d){5,}")

WORD = re.compile(rf"(?<![\w@.+#/-]){UP}[\w'’]*(?:-{UP}[\w'’]*)?(?![\w@])")
#: Given names that are everyday words as well; alone they are names only by their context.
EVERYDAY = frozenset("mark art will frank april grace joy rose iris basil may june august hope faith dawn bill rich grant dean chase guy jack miles rob sue pat drew ray pearl ruby daisy lily ivy olive ginger penny".split())
#: Greetings, titles and words that a name follows; verbs of saying that follow a name.
NAME_BEFORE = re.compile(
    r"(?:\b(?:ask|dear|hi|hello|hey|moin|morning|afternoon|evening|day|as|with|from|by|and|tell|told|thank|thanks|mr|mrs|ms|dr|herr|frau|monsieur|madame|mme|señor|señora|don|doña|hallo|liebe|lieber|tag|sehr geehrte|sehr geehrter|bitte|wie|bonjour|salut|cher|chère|dit|demandez à|demande à|hola|buenas|buenos días|buenos|estimado|estimada|querido|querida|dijo|pregunta a|pregunte a|contact|kontakt|to|an|à|para|von|de|y|et|und)|:|>|^)\s*$",
    re.I,
)
WORD_BEFORE = re.compile(NAME_BEFORE.pattern.replace('|:|>|^)', ')'), re.I)
NAME_AFTER = re.compile(r"^\s*(?:said|says|wrote|writes|thinks|asked|asks|called|sagte|sagt|meinte|meint|schrieb|fragt|rief|dit|écrit|a écrit|demande|dijo|dice|escribió|pregunta|<|&lt;|[,!]?\s*(?:<br|</|\r?\n|$))", re.I)
#: Titles, after which a surname is a name; and what a person's whole name follows, known or not.
TITLES = ("Mr", "Mr.", "Mrs", "Mrs.", "Ms", "Ms.", "Dr", "Dr.", "Herr", "Herrn", "Frau", "Mme", "M.", "Monsieur", "Madame", "Sr", "Sr.", "Sra", "Sra.", "Señor", "Señora")
INTRODUCED = (*TITLES, "Don", "Doña", "Dear", "Liebe", "Lieber", "Cher", "Chère", "Estimado", "Estimada", "Querido", "Querida", "y name is", "I am", "ch heiße", "ein Name ist", "e m'appelle", "e llamo", "i nombre es", "Ask", "Regards,", "Best,", "Grüße,", "Cordialement,", "Saludos,")
#: What follows the name of an organisation.
ORGANISATION = re.compile(r"^\s+(?:GmbH|SARL|Ltd|Coop|Works|Inc|AG|KG|SA|LLC|PLC|Team|Group)\b")


def folded(word: str) -> str:
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", word.replace("ø", "o").replace("Ø", "O")) if not unicodedata.combining(c)).casefold()


def luhn(digits: str) -> bool:
    d = [int(c) for c in digits[::-1]]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2]) in range(0, 1000, 10)


def nir_valid(text: str) -> bool:
    """The French security number's key: 97 minus the first 13 digits mod 97."""
    s = re.sub(r"\s", "", text).replace("2A", "19").replace("2B", "18")
    return len(s) == 15 and s.isdigit() and int(s[13:]) == 97 - int(s[:13]) % 97


def dni_valid(text: str) -> bool:
    """The Spanish identity number's letter: the number mod 23."""
    s = re.sub(r"[.\s-]", "", text).upper()
    s = {"X": "0", "Y": "1", "Z": "2"}.get(s[0], s[0]) + s[1:]
    return s[:-1].isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(s[:-1]) % 23] == s[-1]


def tax_de_valid(text: str) -> bool:
    """The German tax number's check digit (ISO 7064, mod 11, 10)."""
    s = re.sub(r"\s", "", text)
    p = 10
    for c in s[:10]:
        p = 2 * ((p + int(c) - 1) % 10 + 1) % 11
    return len(s) == 11 and (11 - p) % 10 == int(s[10])


def iban_valid(text: str) -> bool:
    """The international account number's check digits (mod 97)."""
    s = re.sub(r"\s", "", text)
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Names:
    """Given names and surnames, as sorted hashes; a name is looked up by its folded spelling."""

    def __init__(self, given, family):
        self.given, self.family = (np.unique(np.fromiter(x, np.int64, len(x))) for x in (given, family))
        self.known: dict[str, tuple[bool, bool]] = {}

    @staticmethod
    def slot(word: str) -> int:
        return xxhash.xxh64_intdigest(folded(word)) - (1 << 63)

    def look_up(self, word: str) -> tuple[bool, bool]:
        """Whether the word is a given name, and whether it is a surname."""
        if (found := self.known.get(word)) is None:
            if len(self.known) >= 100_000:
                self.known.clear()
            s = self.slot(word)
            found = self.known[word] = tuple(bool(len(x)) and int(x[min(len(x) - 1, int(x.searchsorted(s)))]) == s for x in (self.given, self.family))
        return found

    def is_given(self, word: str) -> bool:
        return self.look_up(word)[0]

    def is_family(self, word: str) -> bool:
        return self.look_up(word)[1]


HEADER_NAME = re.compile(r'^\s*"?([^"<(@]+?)"?\s*<([^>]*)>|^\s*([^\s<(]+@[^\s<(]+)\s*\(([^)]+)\)')


def header_name(header: str | None) -> tuple[str, str] | None:
    """(given, family) of a From header's display name, if the address bears one of them out, so that it names a person."""
    m = HEADER_NAME.match(header or "")
    if not m:
        return None
    name, address = (m.group(1), m.group(2)) if m.group(1) else (m.group(4), m.group(3))
    local = folded(address.split("@")[0])
    parts = [p.strip() for p in name.strip().strip('"').split(",", 1)]
    words = parts[0].split() if len(parts) == 1 else [parts[1], parts[0]]
    if len(words) != 2 or not all(w.replace("-", "").replace("'", "").isalpha() for w in words):
        return None
    given, family = (words[1], words[0]) if len(parts) == 1 and words[0].isupper() and not words[1].isupper() else words
    return (given, family) if folded(family) in local and (folded(given) in local or folded(given)[:1] == local[:1] or folded(family) == re.sub(r"\d+$", "", local)) else None


def spans(text: str, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the finds in a text, in order, none overlapping; a line end of two characters counts as one in the patterns."""
    if "\r\n" in text:
        parts = text.split("\r\n")
        ends, at = [], -1
        for p in parts[:-1]:
            at += len(p) + 1
            ends.append(at)
        return [(a + bisect_left(ends, a), b + bisect_left(ends, b), kind) for a, b, kind in spans("\n".join(parts), names)]
    out: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []

    def add(a: int, b: int, kind: str) -> None:
        if a < b and not any(a < y and x < b for x, y in taken):
            taken.append((a, b))
            out.append((a, b, kind))

    if "@" in text:
        for m in EMAIL_PLAIN.finditer(text):
            add(m.start() + (len(m.group()) - len(m.group().lstrip(".'"))), m.end(), "email")
    if SPELT_HINT.search(text):
        for m in EMAIL_SPELT.finditer(text):
            if SPELT_HINT.search(m.group()):
                add(m.start(), m.end(), "email")
    blank = " ".join(text.split())
    if any("." in after.split(" ", 1)[0][:-1] for after in SPELT_AT.split(blank)[1:]):
        for m in EMAIL_WORD.finditer(text):
            add(m.start(), m.end(), "email")
    before = lambda m, n=40: re.sub(r"\s+", " ", text[max(0, m.start() - n) : m.start()])
    clusters = [(max(0, m.start() - 8), m.end() + 6) for m in CLUSTER.finditer(text)]
    at = lambda pattern: (m for a, b in clusters for m in pattern.finditer(text, a, b))
    # numbers: each has a score for its form, one for its checksum - by how seldom chance fulfils it - and one for words near by
    for a, b in clusters:
        for m in IBAN.finditer(text, a, b + 24):
            if 0.1 + 0.5 * iban_valid(m.group()) + 0.4 * bool(IBAN_WORDS.search(before(m))) >= 0.6:
                add(m.start(), m.end(), "iban")
    for m in at(NINO):
        add(m.start(), m.end(), "id_number")
    for m in at(NIR):
        if 0.2 + 0.4 * nir_valid(m.group()) + 0.4 * bool(ID_WORDS.search(before(m, 50))) >= 0.6:
            add(m.start(), m.end(), "id_number")
    for m in at(DNI):
        digits = len(re.sub(r"\D", "", m.group()))
        form = 0.2 if "." in m.group() or len(m.group()) >= 8 else 0.0
        if form + (0.4 if digits >= 7 else 0.2) * dni_valid(m.group()) + 0.4 * bool(ID_WORDS.search(before(m))) >= 0.6:
            add(m.start(), m.end(), "id_number")
    for m in at(PASSPORT):
        if re.search(r"pass|pasap|ausweis|\bid\b|document", before(m, 30), re.I):
            add(m.start(), m.end(), "id_number")
    for m in at(CARD):
        digits = re.sub(r"\D", "", m.group())
        if luhn(digits) and 0.2 + 0.2 + 0.2 * bool(CARD_GROUPS.fullmatch(m.group())) + 0.4 * bool(CARD_WORDS.search(before(m))) >= 0.6:
            add(m.start(), m.end(), "card")
    for m in at(TAX_DE):
        if 0.2 + 0.2 * tax_de_valid(m.group()) + 0.4 * bool(ID_WORDS.search(before(m))) >= 0.6:
            add(m.start(), m.end(), "id_number")
    for m in at(SSN):
        near = before(m, 30)
        if ID_WORDS.search(near) or m.group(1) == "-" and not PHONE_AGAINST.search(near):
            add(m.start(), m.end(), "id_number")
    for hints, pattern in zip(STREET_HINTS, STREETS):
        if any(h in blank for h in hints):
            for m in pattern.finditer(text):
                add(m.start(), m.end(), "street")
    for m in at(PHONE):
        s, near = m.group().rstrip(" .-/"), before(m, 30)
        n = sum(map(str.isdigit, s))
        score = 0.3 + 0.4 * s.startswith(("+", "(0")) + 0.3 * bool(re.match(r"\([2-9]\d\d\)|[2-9]\d\d[.-]\d{3}[.-]\d{4}$|0", s)) + 0.5 * bool(PHONE_BEFORE.search(near)) - 0.6 * bool(PHONE_AGAINST.search(near))
        line = re.split(r"[\r\n]|<br\s*/?>|</?(?:p|div)[^>]*>", text[max(0, m.start() - 80) : m.start()], flags=re.I)[-1].strip(" >|")
        tail = re.split(r"[\r\n]|<", text[m.end() : m.end() + 40])[0].strip()
        score += 0.3 * (not line and not tail)
        if 8 <= n <= 15 and score >= 0.5 and not ("/" in s and n < 10 and not s.startswith(("0", "+", "("))):
            add(m.start(), m.start() + len(s), "phone")
    taken.sort()
    # names of persons
    words = list(WORD.finditer(text))
    i = 0
    while i < len(words):
        m = words[i]
        w = m.group()
        i += 1
        given, family = names.look_up(w)
        nxt = words[i] if i < len(words) else None
        gap = text[m.end() : nxt.start()] if nxt else "x"
        if not given:
            head = text[max(0, m.start() - 24) : m.start()]
            if head[-1:].isspace():
                head = head.rstrip()
                if family and head.endswith(TITLES):
                    add(m.start(), m.end(), "person")
                # a whole name that no header bears
                elif len(gap) == 1 and gap.isspace() and head.endswith(INTRODUCED) and not ORGANISATION.match(text[m.end() : m.end() + 10]) and not ORGANISATION.match(text[nxt.end() : nxt.end() + 10]) and not (i + 1 < len(words) and words[i + 1].start() == nxt.end() + 1):
                    add(m.start(), nxt.end(), "person")
                    i += 1
            continue
        if nxt and gap and gap.isspace() and gap.count("\n") < 2 and names.is_family(nxt.group()) and not (names.is_given(nxt.group()) and not names.is_family(nxt.group())):
            add(m.start(), nxt.end(), "person")
            i += 1
            continue
        if ORGANISATION.match(text[m.end() : m.end() + 10]):
            continue
        prior = text[max(0, m.start() - 24) : m.start()]
        score = 0.6
        if folded(w) in EVERYDAY:
            score -= 0.4
            if w.isupper():
                score -= 0.2
        elif len(w) < 3:
            score -= 0.3
        if re.search(r"\d\.?\s+$", prior) and folded(w) in ("april", "may", "june", "august"):
            score -= 0.6
        tagless = re.sub(r"<[^<>]*>\s*$", "\n", prior)
        # a name at the beginning of a line counts only if the line ends with it
        if NAME_BEFORE.search(tagless.split("\n")[-1] if "\n" in tagless else tagless) and (tagless.split("\n")[-1].strip(" >|") or NAME_AFTER.match(text[m.end() : m.end() + 20])):
            score += 0.3
        elif "\n" in tagless and tagless.count("\n") == 1 and tagless.endswith("\n") and WORD_BEFORE.search(tagless):  # broken over lines
            score += 0.3
        if NAME_AFTER.match(text[m.end() : m.end() + 20]):
            score += 0.15
        if score >= 0.49:
            add(m.start(), m.end(), "person")
    return sorted(out)


def header_spans(header: str, names: Names) -> list[tuple[int, int, str]]:
    """Finds in a From header: addresses, and a display name that holds a given name or bears the address out."""
    out = [(m.start(), m.end(), "email") for m in EMAIL_PLAIN.finditer(header)]
    m = HEADER_NAME.match(header)
    if m:
        g = 1 if m.group(1) else 4
        name = m.group(g)
        words = re.findall(r"[^\W\d_][\w'’-]*", name)
        if header_name(header) or 2 <= len(words) <= 4 and any(names.is_given(w) for w in words) and not re.search(r"\b(?:GmbH|SARL|Ltd|Coop|Works|Team)\b", name) or len(words) == 1 and names.is_given(words[0]):
            a = m.start(g) + len(name) - len(name.lstrip(" \"'"))
            b = m.end(g) - (len(name) - len(name.rstrip(" \"'")))
            out.append((a, b, "person"))
    elif "@" not in header:
        words = re.findall(r"[^\W\d_][\w'’-]*", header)
        if 1 <= len(words) <= 3 and any(names.is_given(w) for w in words):
            s = header.strip(" \"'")
            a = header.find(s)
            out.append((a, a + len(s), "person"))
    return sorted(out)


def harvested_names(emails: DataFrame, most_names: int = 8_000_000) -> Names:
    """The names in all From headers, as hashes (64 MB at most); a collection with more than `most_names` different names is refused."""

    def read(batches):
        given, family = set(), set()
        for b in batches:
            for h in set(b["from_addr"].to_pylist()):
                if n := header_name(h):
                    given.add(Names.slot(n[0])), family.add(Names.slot(n[1]))
        yield pa.RecordBatch.from_arrays([pa.array([*given, *family], pa.int64()), pa.array([True] * len(given) + [False] * len(family))], ["slot", "given"])

    got = emails.select("from_addr").where(F.col("from_addr").isNotNull()).mapInArrow(read, "slot long, given boolean").distinct().limit(most_names + 1).toPandas()
    if len(got) > most_names:
        raise ValueError(f"more than {most_names} names")
    return Names(set(got.slot[got.given].tolist()), set(got.slot[~got.given].tolist()))


def redacted(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join([*out, text[at:]])


def personal_spans(emails: DataFrame, names: Names) -> DataFrame:
    """(email_rowid, field_name, pii_kind, pii_text): one row a find; whole texts, null fields give none, repeated rows give equal rows."""
    sent = emails.sparkSession.sparkContext.broadcast((names.given, names.family))
    cols = ["email_rowid", "field_name", "pii_kind", "pii_text"]

    def read(batches):
        own = Names(set(), set())
        own.given, own.family = sent.value
        for b in slices(batches):
            rows = []
            for i, text, header in zip(b["email_rowid"].to_pylist(), b["text"], b["from_addr"].to_pylist()):
                text = text.as_py()
                for field, t, found in (("body", text, spans(text, own) if text else []), ("from_addr", header, header_spans(header, own) if header else [])):
                    rows += [(i, field, kind, " ".join(t[x:y].split())) for x, y, kind in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[k] for r in rows], pa.string()) for k in (1, 2, 3)]], cols)

    src = emails.select(F.col("email_rowid").cast("long").alias("email_rowid"), F.col("body").alias("text"), "from_addr").where(F.col("email_rowid").isNotNull())
    return spread(src).mapInArrow(read, "email_rowid long, field_name string, pii_kind string, pii_text string")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every find in bodies and From headers."""
    emails = table(spark, folder, "emails")
    return personal_spans(emails, harvested_names(emails)).where(F.col("pii_kind").isin(*FOUND)).distinct()


def p6_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies and From headers with typed placeholders; repeated rows once."""
    emails = table(spark, folder, "emails")
    names = harvested_names(emails)
    sent = spark.sparkContext.broadcast((names.given, names.family))

    def read(batches):
        own = Names(set(), set())
        own.given, own.family = sent.value
        for b in slices(batches):
            texts, headers = b["text"].to_pylist(), b["from_addr"].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b["email_rowid"], pa.array([redacted(t, spans(t, own) if t else []) for t in texts], pa.string()), pa.array([redacted(h, header_spans(h, own) if h else []) for h in headers], pa.string())], ["email_rowid", "body", "from_addr"]
            )

    src = emails.select(F.col("email_rowid").cast("long").alias("email_rowid"), F.col("body").alias("text"), "from_addr").where(F.col("email_rowid").isNotNull()).dropDuplicates(["email_rowid"])
    return spread(src).mapInArrow(read, "email_rowid long, body string, from_addr string")


QUERIES = {"p6_found": p6_found, "p6_redacted": p6_redacted}
