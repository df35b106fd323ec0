"""Directions for use ("take 1 tab po bid x 7 days") as a struct of their parts."""

from __future__ import annotations

import re

from lumenpair.functions import vocabulary as V
from lumenpair.functions.arrow import parser

#: Phrases that stand for one token, in the order in which they are folded.
PHRASES = [
    (re.compile(p, re.A), to)
    for p, to in (
        (r"\bby mouth\b", "po"),
        (r"\bas needed\b", "prn"),
        (r"\bevery other day\b", "qod"),
        (r"\b(?:(?:each|every) day|once (?:a day|daily))\b", "daily"),
        (r"\btwice (?:a day|daily)\b", "bid"),
        (r"\bthree times (?:a day|daily)\b", "tid"),
        (r"\bfour times (?:a day|daily)\b", "qid"),
        (r"\b(?:every night at bedtime|at bedtime|every night)\b", "qhs"),
        (r"\b(?:each|every|in the) mo(?:rn|m)ing\b(?!\s+and\b)", "qam"),
        (r"\b(?:each|every|in the) even(?:in|m)g\b(?!\s+and\b)", "qpm"),
        (r"\bin each nostril\b", "nasal"),
        (r"\b(?:(?:at|with) )?lunch(?: time)?\b", "lunch"),
        (r"\bat (?:midday|noon)\b", "noon"),
        (r"\b(?:each|every|in the) afternoon\b", "afternoon"),
        (r"\b(?:at|with) breakfast\b", "breakfast"),
        (r"\b(?:at|with) (?:dinner|supper)\b", "dinner"),
    )
]
DOTTED = re.compile(r"q\.o\.d\.|q\.i\.d\.|t\.i\.d\.|b\.i\.d\.|p\.r\.n\.|q\.d\.|p\.o\.")
DAYS = (re.compile(r"x\s*(\d+)\s*d(?:ays)?\b", re.A), re.compile(r"for\s+(\d+)\s*days?\b", re.A))
DAYS_OUT = re.compile(r"x\s*\d+\s*d(?:ays)?|for\s+\d+\s*days?", re.A)
COUNT = re.compile(r"\d+(?:\.\d+)?", re.A)
Q_WORD = re.compile(r"q[a-z0-9]+", re.A)


def fold(text: str) -> str:
    s = text.lower().strip()
    for pattern, to in PHRASES:
        s = pattern.sub(to, s)
    return re.sub('["“”]', "", DOTTED.sub(lambda m: m.group().replace(".", ""), s))


def dose(tokens: list[str]) -> tuple[float | None, int]:
    """(count, its place): the first number in digits, words or roman ones. A numeral that is a route too counts only before a unit."""
    for k, t in enumerate(tokens):
        if COUNT.fullmatch(t):
            return float(t), k
        if t in V.NUMBERS:
            return float(V.NUMBERS[t]), k
        if t in V.ROMAN and (t not in V.ROUTES or tokens[k + 1 : k + 2] and tokens[k + 1] in V.DOSE_UNITS):
            return float(V.ROMAN[t]), k
    return None, -1


def agreeing(tokens: list[str], table: dict, skip: int = -1):
    """(value, places): the first token's value, and all tokens that repeat it. One that says another is left over."""
    value, places = None, set()
    for k, t in enumerate(tokens):
        if k != skip and t in table and (value is None or table[t] == value):
            value = table[t]
            places.add(k)
    return value, places


def parse(text: str) -> dict:
    s = fold(text)
    days = next((float(m.group(1)) for p in DAYS if (m := p.search(s))), None)
    tokens = [t for t in (x.rstrip(".") for x in re.split(r"[\s,]+", DAYS_OUT.sub("", s))) if t]
    count, at = dose(tokens)
    unit, a = agreeing(tokens, V.DOSE_UNITS)
    route, b = agreeing(tokens, V.ROUTES, at)
    rate, c = agreeing(tokens, V.FREQUENCIES)
    meal, d = agreeing(tokens, V.MEALS)
    when = {k for k, t in enumerate(tokens) if t in V.TIMES_OF_DAY}
    known = a | b | c | d | when | {at}
    times = sorted({V.TIMES_OF_DAY[tokens[k]] for k in when})
    return {
        "dose": count,
        "unit": unit,
        "route": route,
        "per_day": rate,
        "as_needed": any(t in V.AS_NEEDED for t in tokens),
        "days": days,
        "meal": meal,
        "times": times,
        "vague": count is None and route is None and rate is None and not times,
        "unknown_rate": any(Q_WORD.fullmatch(t) and t not in V.FREQUENCIES and t not in V.ROUTES for t in tokens),
        "rest": [t for k, t in enumerate(tokens) if k not in known and t not in V.FILLERS and t not in V.AS_NEEDED],
    }


parse_directions = parser(
    parse, dose="double", unit="string", route="string", per_day="double", as_needed="boolean", days="double", meal="string", times="strings", vague="boolean", unknown_rate="boolean", rest="strings"
)
