"""Time ranges in questions, in English and French."""

from __future__ import annotations

import calendar
import re
from datetime import datetime, timedelta

#: The months' names.
MONTHS = {
    name: i
    for names in (
        "january february march april may june july august september october november december".split(),
        "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    )
    for i, name in enumerate(names, 1)
}
UNITS = {"day": 1, "jour": 1, "week": 7, "semaine": 7, "month": 30, "mois": 30, "year": 365, "an": 365}
LAST_N = re.compile(r"\b(?:last|past|previous)\s+(\d{1,4})\s+(day|week|month|year)s?\b|\b(\d{1,4})\s+(?:derniers?\s+|dernières?\s+)?(jour|semaine|mois|an)s?\b(?:\s+derni(?:er|ère)s?)?", re.I)
MONTH_YEAR = re.compile(rf"\b({'|'.join(MONTHS)})\s+((?:19|20)\d\d)\b", re.I)
NAMED = re.compile(r"\b(today|aujourd'hui|yesterday|hier|(?:this|last)\s+(?:week|month|year)|cette semaine|semaine dernière|ce mois|mois dernier|cette année|année dernière)\b", re.I)
RECENT = re.compile(r"\b(?:recently|recent|lately|récemment|récents?|récentes?)\b", re.I)
YEAR = re.compile(r"\b(?:in|since|during|from|en|depuis|pendant)\s+((?:19|20)\d\d)\b", re.I)
FRENCH = {"aujourd'hui": "today", "hier": "yesterday", "cette semaine": "this week", "semaine dernière": "last week", "ce mois": "this month", "mois dernier": "last month", "cette année": "this year", "année dernière": "last year"}


def _day(d: datetime) -> datetime:
    return d.replace(hour=0, minute=0, second=0, microsecond=0)


def _month(year: int, month: int) -> tuple[datetime, datetime]:
    start = datetime(year, month, 1)
    return start, start + timedelta(days=calendar.monthrange(year, month)[1])


def time_scope(question: str, now: datetime) -> tuple[datetime, datetime] | None:
    """The first moment and the last millisecond of the range that a question names, seen from `now`; None where it names none.

    Tried in turn: a number of units back, a month of a year, a named range (weeks begin on Monday), "recent" (30
    days), a year after a preposition.
    """
    today, end = _day(now), None
    if m := LAST_N.search(question):
        n, unit = (m.group(1), m.group(2)) if m.group(1) else (m.group(3), m.group(4))
        start, end = today - timedelta(days=int(n) * UNITS[unit.lower()]), today + timedelta(days=1)
    elif m := MONTH_YEAR.search(question):
        start, end = _month(int(m.group(2)), MONTHS[m.group(1).lower()])
    elif m := NAMED.search(question):
        name = " ".join(m.group(1).lower().split())
        name = FRENCH.get(name, name)
        if name in ("today", "yesterday"):
            start = today - timedelta(days=name == "yesterday")
            end = start + timedelta(days=1)
        else:
            back, unit = name.startswith("last"), name.split()[1]
            if unit == "week":
                start = today - timedelta(days=today.weekday() + 7 * back)
                end = start + timedelta(days=7)
            elif unit == "month":
                y, mo = (today.year, today.month) if not back else ((today.year, today.month - 1) if today.month > 1 else (today.year - 1, 12))
                start, end = _month(y, mo)
            else:
                start = datetime(today.year - back, 1, 1)
                end = datetime(today.year - back + 1, 1, 1)
    elif RECENT.search(question):
        start, end = today - timedelta(days=30), today + timedelta(days=1)
    elif m := YEAR.search(question):
        start, end = datetime(int(m.group(1)), 1, 1), datetime(int(m.group(1)) + 1, 1, 1)
    return (start, end - timedelta(milliseconds=1)) if end else None


def without_scope(question: str) -> str:
    """The question without the words that name a range."""
    for pattern in (LAST_N, MONTH_YEAR, NAMED, RECENT, YEAR):
        question = pattern.sub(" ", question)
    return " ".join(question.split())
