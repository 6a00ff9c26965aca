"""Tolerant reading of model answers: fenced, truncated or wrapped JSON."""

from __future__ import annotations

import json
import re


def unfenced(text: str) -> str:
    """Text without a leading reasoning block and without a code fence around it."""
    text = re.sub(r"^\s*<think>.*?</think>", "", text, flags=re.S).strip()
    return re.sub(r"^```[a-zA-Z]*\s*|\s*```$", "", text).strip()


def salvaged(text: str | None, most: int = 20) -> list[dict]:
    """The complete JSON objects of a text, outermost first come, up to `most`; braces inside strings don't count."""
    out, depth, start, quoted, escaped = [], 0, 0, False, False
    for i, c in enumerate(text or ""):
        if quoted:
            quoted, escaped = (c != '"' or escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                try:
                    out.append(json.loads(text[start : i + 1]))
                except ValueError:
                    pass
                if len(out) >= most:
                    break
    return out


def batch_answers(text: str | None, n: int) -> list[list[int] | None]:
    """n answers from an array, an object keyed 1..n or 0..n-1, or either wrapped in one key; None where there is no answer, [] where there is an empty one."""
    try:
        got = json.loads(unfenced(text or ""))
    except ValueError:
        return [None] * n
    if isinstance(got, dict) and len(got) == 1 and isinstance(inner := next(iter(got.values())), (dict, list)) and not next(iter(got)).isdigit():
        got = inner
    if isinstance(got, dict):
        keys = {int(k): v for k, v in got.items() if str(k).isdigit()}
        base = 0 if 0 in keys else 1
        got = [keys.get(i + base) for i in range(n)]
    if not isinstance(got, list):
        return [None] * n
    one = lambda v: [int(x) for x in v if str(x).lstrip("-").isdigit()] if isinstance(v, list) else [int(v)] if isinstance(v, int) and not isinstance(v, bool) else None
    return [one(v) for v in (got + [None] * n)[:n]]


def rerank_order(text: str | None, n: int) -> list[int]:
    """The places 0..n-1 in the order of the first list of numbers in an answer: valid ones once each, then the others as they stood."""
    def numbers(v):
        if isinstance(v, dict):
            v = next(iter(v.values()), None)
            return numbers(v)
        if isinstance(v, list):
            return [x for i in v for x in (numbers(i) if isinstance(i, (list, dict)) else [i])]
        return []

    try:
        got = numbers(json.loads(unfenced(text or "")))
    except ValueError:
        got = []
    order = list(dict.fromkeys(x for x in got if isinstance(x, int) and not isinstance(x, bool) and 0 <= x < n))
    return order + [i for i in range(n) if i not in order]
