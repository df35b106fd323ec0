"""Postal addresses as a struct of comparable parts."""

from __future__ import annotations

import re

from lumenpair.functions import vocabulary as V
from lumenpair.functions.arrow import parser

SUFFIXES, WAYS = frozenset(V.STREET_SUFFIXES.values()), frozenset(V.DIRECTIONS.values())
FRACTION = re.compile(r"^(\d+?)(1/2|1/4|3/4)\b", re.A)
GLUED_SUFFIX = re.compile(rf"\b({'|'.join(sorted(V.STREET_SUFFIXES, key=len, reverse=True))})(apartment|suite|unit|apt|ste)(\d\w*)\b", re.A)
GLUED_UNIT = re.compile(r"(apartment|apt|suite|ste|unit)(\d.*)", re.A)
HASH = re.compile(r"#\s*(\S+)")
ZIP = r"(\d{5}(?:-\d{4})?)?\s*$"
WITH_COMMA, WITHOUT = re.compile(r"^(.*?),\s*([A-Za-z]{2})\s*" + ZIP, re.A), re.compile(r"^(.*?)\s+([A-Za-z]{2})\s*" + ZIP, re.A)


def fold(s: str) -> str:
    """Lower case; commas within a number go, others are spaces; periods go."""
    return " ".join(re.sub(r"(\d),(\d)", r"\1\2", s.lower(), flags=re.A).replace(",", " ").replace(".", "").split())


def cut_suffix(token: str) -> str | None:
    """The suffix that a token of five letters or more is the beginning of."""
    return next((V.STREET_SUFFIXES[w] for w in V.LONG_SUFFIXES if len(token) >= 5 and w != token and w.startswith(token)), None)


def street(raw: str) -> dict:
    """base, suffix and unit of a street line; where there is no suffix, the last token and the base without it."""
    s = GLUED_SUFFIX.sub(r"\1 \2\3", FRACTION.sub(r"\1 \2", fold(raw)))
    s = " ".join(f"{m.group(1)} {m.group(2)}" if (m := GLUED_UNIT.fullmatch(t)) else t for t in s.split(" "))
    unit = None
    if m := HASH.search(s):
        unit, s = m.group(1), (s[: m.start()] + s[m.end() :]).strip()
    tokens, kept, k = s.split(), [], 0
    while k < len(tokens):
        if unit is None and tokens[k] in V.UNIT_WORDS and k + 1 < len(tokens):
            unit = tokens[k + 1]
            k += 1
        else:
            kept.append(tokens[k])
        k += 1
    words = [V.STREET_SUFFIXES.get(t) or V.DIRECTIONS.get(t) or cut_suffix(t) or t for t in kept]
    if unit is None and len(words) >= 3 and re.fullmatch(r"\d+", words[-1], re.A) and words[-2] in SUFFIXES:
        return {"base": " ".join(words[:-2]), "suffix": words[-2], "unit": words[-1], "last": None, "short": None}
    many = len(words) > 1
    ends = many and words[-1] in SUFFIXES
    return {
        "base": " ".join(words[:-1] if ends else words),
        "suffix": words[-1] if ends else None,
        "unit": unit.lower() if unit else None,
        "last": words[-1] if many and not ends else None,
        "short": " ".join(words[:-1]) if many and not ends else None,
    }


def split_line(raw: str) -> tuple[str, str, str, str]:
    """(street, city, state, zip) of an address in one line; the city is the word before the state."""
    line = raw.strip()
    m = WITH_COMMA.match(line)
    if not m and (loose := WITHOUT.match(line)) and loose.group(2).lower() not in SUFFIXES | WAYS:
        m = loose
    if not m:
        return line, "", "", ""
    before = m.group(1).split()
    if len(before) < 2:
        return m.group(1).strip(), "", m.group(2), m.group(3) or ""
    return " ".join(before[:-1]), before[-1], m.group(2), m.group(3) or ""


def unit_value(raw: str) -> str:
    words = fold(raw).split()
    return " ".join(words[1:] if len(words) > 1 and words[0] in V.UNIT_WORDS else words)


def parse(line: str, unit: str | None, city: str | None, state: str | None, zip_code: str | None) -> dict:
    parts = (line, city or "", state or "", zip_code or "") if city or state or zip_code else split_line(line)
    out = street(parts[0])
    if out["unit"] is None and unit:
        out["unit"] = unit_value(unit)
    return out | {"city": fold(parts[1]), "state": fold(parts[2]).replace(" ", ""), "zip": re.sub(r"\D", "", parts[3], flags=re.A)[:5]}


#: (street, unit, city, state, zip), the street not null.
parse_address = parser(parse, base="string", suffix="string", unit="string", last="string", short="string", city="string", state="string", zip="string")
