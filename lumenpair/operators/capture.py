"""Records read from captures of a screen: words with boxes, of which labels, their values beside or below them, and telling patterns make the fields.

What a word is used for depends on what was used before, so a capture is read as a whole by Python, an array of words a capture; captures are small. What is told of a text
alone is remembered, as screens repeat their labels. Nothing raises: what can't be read is missing, and the diagnostics say why."""

from __future__ import annotations

import datetime
import math
import re
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenpair.functions import vocabulary as V
from lumenpair.functions.rules import DIGIT_LIKE
from lumenpair.operators.verdicts import RECORD

#: Labels as they are written without spaces, the words they may take, and the field they name; those named `-` are known, but of no use.
LABELS = [
    (name, int(words), key)
    for name, words, key in (
        x.split() for x in (
            "patient 3 patient, gender 2 -gender, address 3 address, dob 3 dob, prescriber 3 prescriber, agentname 2 -agentName, location 3 location, licenses 2 -licenses, phone 3 phone, supervisor 2 -supervisor, spi 1 -spi, written 3 written, available 3 available, ndc 3 ndc, "
            "medication 3 medication, quantity 3 quantity, directions 3 directions, refills 2 refills, refillsauthorized 2 refills, refillsremaining 2 refills, totalfills 2 refills, ds 1 -ds2, note 3 note, substitutions 3 substitutions, dxcodes 3 -dxCodes, order 2 -order"
        ).split(", ")
    )
]
FRAME = "agent audit claims dispense ds dur edits escript fill image mab more new order original prescription refill refilled replace rxedits select sn spi supervisor time workflow zoom".split()
TRIMMED, NAMES = ("patient", "prescriber", "phone"), ("patient", "prescriber")
GAP, SIG_GAP, PATIENT_X = 150, 50, 110
#: Texts that a task remembers, of each kind.
KEPT = 50_000


@dataclass(slots=True)
class Word:
    text: str
    x: float
    y: float
    w: float
    h: float


@dataclass(slots=True)
class Label:
    key: str
    name: str
    row: int
    at: Word
    text: str


@dataclass(slots=True)
class Reading:
    """The state of one capture: values, where they stand and how they were found; labels in their order; lines that no label claimed, and which of them are used."""

    values: dict = field(default_factory=dict)
    found: dict = field(default_factory=dict)
    labels: list = field(default_factory=list)
    left: list = field(default_factory=list)
    used: set = field(default_factory=set)
    refills_name: str = ""


@lru_cache(maxsize=KEPT)
def squeezed(s: str) -> str:
    return re.sub("[^a-z0-9]", "", s.lower())


def text_of(words: list[Word]) -> str:
    return " ".join(" ".join([w.text for w in words]).split())


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last if x == y else 1 + min(last, row[j], row[j + 1])
    return row[-1]


def allowed(n: int) -> int:
    return 1 if n <= 5 else 2 if n <= 9 else 3


def lines_of(words: list[Word]) -> list[list[Word]]:
    """A word joins the last line where it is within 0.6 of that line's mean height of its mean y; lines are sorted from the left."""
    out: list[list[Word]] = []
    y = h = 0.0
    for w in sorted(words, key=lambda w: (w.y, w.x)):
        if out and abs(w.y - y / len(out[-1])) <= (h / len(out[-1]) or w.h or 1) * 0.6:
            out[-1].append(w)
            y, h = y + w.y, h + w.h
        else:
            out.append([w])
            y, h = w.y, w.h
    return [sorted(line, key=lambda w: w.x) for line in out]


@lru_cache(maxsize=KEPT)
def nearest(said: str, n: int, patient: bool):
    """(share of its length that is off, name, key) of the first label that `said`, in n words, is closest to; None where none is close enough."""
    best = None
    for name, most, key in LABELS:
        if n <= most and (patient or key != "patient") and abs(len(said) - len(name)) <= allowed(len(name)):
            off = distance(said, name)
            if off <= allowed(len(name)) and (best is None or off / len(name) < best[0]):
                best = (off / len(name), name, key)
    return best


def label_at(words: list[Word], start: int = 0, longer: bool = False):
    """(name, key, words taken) of the label that up to three words are closest to, as a share of its length; of equals the first, or with `longer` the one of more words."""
    return labelled(tuple([w.text for w in words[start : start + 3]]), words[start].x <= PATIENT_X, longer) if start < len(words) else None


@lru_cache(maxsize=KEPT)
def labelled(texts: tuple[str, ...], patient: bool, longer: bool):
    best = None
    for n in range(1, len(texts) + 1):
        said = squeezed(" ".join(texts[:n]))
        found = nearest(said, n, patient) if said else None
        if found and (best is None or found[0] < best[0] or (longer and found[0] == best[0])):
            best = (*found, n)
    return best and best[1:]


@lru_cache(maxsize=KEPT)
def frames(said: str) -> bool:
    return any(said == t if len(t) <= 2 else abs(len(said) - len(t)) <= allowed(len(t)) and distance(said, t) <= allowed(len(t)) for t in FRAME)


def framed(word: Word) -> bool:
    """Whether a word belongs to the window around the record."""
    return framing(word.text)


@lru_cache(maxsize=KEPT)
def framing(text: str) -> bool:
    said = squeezed(text)
    return bool(said) and frames(said)


def before_gap(words: list[Word], gap: float) -> list[Word]:
    for k in range(1, len(words)):
        if words[k].x - (words[k - 1].x + words[k - 1].w) > gap:
            return words[:k]
    return words


def pieces(line: list[Word]) -> list[list[Word]]:
    out = [[line[0]]]
    for a, b in zip(line, line[1:]):
        if b.x - (a.x + a.w) > GAP:
            out.append([])
        out[-1].append(b)
    return out


def value_words(words: list[Word], key: str) -> list[Word]:
    if key in TRIMMED:
        words = next((words[:k] for k in range(1, len(words)) if squeezed(words[k].text) and (framed(words[k]) or label_at(words, k))), words)
    words = before_gap(words, GAP)
    return before_gap(words, SIG_GAP) if key == "directions" else words


@lru_cache(maxsize=KEPT)
def no_name(text: str) -> bool:
    solid = re.sub(r"\s", "", text)
    return bool(re.search(r"\d{6,}", text)) or (bool(solid) and len(re.findall(r"\d", text)) / len(solid) > 0.4)


def clusters(xs: list[float]) -> list[int]:
    out, n, last = [0] * len(xs), -1, -math.inf
    for k in sorted(range(len(xs)), key=xs.__getitem__):
        n += xs[k] - last > GAP
        out[k], last = n, xs[k]
    return out


def put(r: Reading, key: str, words: list[Word], how: str, name: str = "") -> None:
    text = text_of(words)
    if text and not (key in NAMES and no_name(text)):
        r.values[key], r.found[key] = text, (how, words)
        if key == "refills":
            r.refills_name = name


def read_rows(r: Reading, lines: list[list[Word]]) -> None:
    """Values on their label's own row. A label that is written in full within the row ends the value, and is read next."""
    todo = [(line, k) for k, line in enumerate(lines)]
    while todo:
        line, row = todo.pop(0)
        match = label_at(line, longer=True)
        if not match:
            r.left.append(line)
            continue
        name, key, n = match
        r.labels.append(Label(key, name, row, line[0], text_of(line[:n])))
        rest = line[n:]
        if rest and rest[0].text.strip().startswith(":"):
            head = rest[0].text.strip()[1:]
            rest = ([Word(head, rest[0].x, rest[0].y, rest[0].w, rest[0].h)] if head else []) + rest[1:]
        full = lambda k, m: m and squeezed(text_of(rest[k : k + m[2]])) == m[0]  # noqa: E731, B023
        cut = next((k for k in range(len(rest)) if (m := label_at(rest, k)) and full(k, m) and (m[1][0] != "-" if k == 0 else m[1] != key)), None)
        if cut is not None:
            todo.insert(0, (rest[cut:], row))
            rest = rest[:cut]
        words = value_words(rest, key)
        if text_of(words) and not (key == "refills" and "refills" in r.values and name == "totalfills"):
            put(r, key, words, "inline-row", name)


def gather(r: Reading, key: str) -> None:
    """Lines between the label's row and the next label's that begin below its value belong to it."""
    label = next((b for b in r.labels if b.key == key), None)
    if key not in r.values or label is None:
        return
    how, words = r.found[key]
    end = min((b.at.y for b in r.labels if b.at.y > label.at.y + 1), default=math.inf)
    texts, more = [r.values[key]], []
    for k, line in enumerate(r.left):
        if k not in r.used and label.at.y + 1 < line[0].y < end and abs(line[0].x - words[0].x) <= GAP / 2:
            r.used.add(k)
            own = before_gap(line, GAP)
            own = before_gap(own, SIG_GAP) if key == "directions" else own
            if text_of(own):
                texts.append(text_of(own))
                more += own
    r.values[key], r.found[key] = " ".join(texts), (how, words + more)


def read_columns(r: Reading) -> None:
    """Labels without a value, by rows, take the next unused line of the value column that stands as their own column does; what finds none takes the first unused line."""
    label_of, line_of = clusters([b.at.x for b in r.labels]), clusters([line[0].x for line in r.left])
    columns = max(line_of, default=-1) + 1
    groups: list[list[int]] = []
    for k, b in enumerate(r.labels):
        if b.key not in r.values:
            if groups and r.labels[groups[-1][-1]].row == b.row:
                groups[-1].append(k)
            else:
                groups.append([k])
    free = lambda column=None: next((k for k in range(len(r.left)) if k not in r.used and column in (None, line_of[k])), None)

    def assign(group: list[int], k: int) -> None:
        r.used.add(k)
        for label, words in zip(group, pieces(r.left[k]) if len(group) > 1 else [r.left[k]]):
            b = r.labels[label]
            put(r, b.key, value_words(words, b.key), "block-column", b.name)

    late = []
    for group in groups:
        k = free(min(label_of[group[0]], columns - 1)) if columns else None
        if k is None:
            late.append(group)
        else:
            assign(group, k)
    for group in late:
        if (k := free()) is not None:
            assign(group, k)


def digits_of(s: str) -> str:
    like, digit = sum(ch in DIGIT_LIKE for ch in s), sum(ch in "0123456789" for ch in s)
    if not like or re.search("[a-zA-Z]", "".join(ch for ch in s if ch not in DIGIT_LIKE)) or (digit < like and digit + like > 2):
        return s
    return "".join(DIGIT_LIKE.get(ch, ch) for ch in s)


@lru_cache(maxsize=KEPT)
def date_of(s: str) -> bool:
    s = s.strip()
    m = re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})", s) or re.fullmatch(r"(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})", s) or re.fullmatch(r"([A-Za-z]+)\.?\s+(\d{1,2}),?\s+(\d{4})", s)
    if not m:
        return False
    a, b, c = m.groups()
    months = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    full = "january february march april may june july august september october november december".split()
    if a.isalpha():
        named = {x: k + 1 for k, x in enumerate(months)} | {x: k + 1 for k, x in enumerate(full)} | {"sept": 9}
        y, mo, d = int(c), named.get(a.lower(), 0), int(b)
    else:
        y, mo, d = (int(a), int(b), int(c)) if len(a) == 4 else (int(c) + (0 if len(c) == 4 else 2000 if int(c) <= 49 else 1900), int(a), int(b))
    try:
        datetime.date(max(y, 1), mo, d)
        return True
    except ValueError:
        return False


@lru_cache(maxsize=KEPT)
def repaired(s: str, labelled: bool = False) -> str | None:
    t = s.strip()
    d = digits_of(t)
    if re.fullmatch(r"\d{1,4}[\s.-]\d{1,2}[\s.-]\d{2,4}", d):
        d = re.sub(r"[\s.-]", "/", d)
    for p in (r"(\d{1,2})/(\d{1,2})/(\d{3})\s(\d)", r"(\d{1,2})/(\d{2})(\d{4})", r"(\d{2})(\d{2})/(\d{4})", *([r"(\d{2})[/lI1|](\d{2})[/lI1|](\d{4})"] if labelled else [])):
        if m := re.fullmatch(p, d):
            g = m.groups()
            return "/".join((g[0], g[1], "".join(g[2:])))
    return d if d != t else None


def address_of(raw: str) -> dict:
    p = r"^(.*?)[,\s]+([A-Za-z]{2})\s*(\d{5})(\d{4})?\s*$"
    text = raw.strip()
    m = re.match(p, text) or re.match(p, re.sub(r"\s+\d{6,}\s*$", "", text))
    words = (m.group(1) if m else text).split()
    if not m:
        at = max((k for k, w in enumerate(words) if re.sub("[.,]", "", w.lower()) in V.STREET_SUFFIXES), default=-1)
        return {"street": text} if at in (-1, len(words) - 1) else {"street": " ".join(words[: at + 1]), "city": " ".join(words[at + 1 :])}
    out = {"state": m.group(2).upper(), "zip": m.group(3)}
    return out | ({"street": " ".join(words[:-1]), "city": words[-1]} if len(words) > 1 else {"street": m.group(1).strip()})


@lru_cache(maxsize=KEPT)
def quantity_of(raw: str) -> tuple[str | None, str | None]:
    words = raw.split()
    for k, w in enumerate(words):
        if re.fullmatch(r"\d+(\.\d+)?", digits_of(w)):
            unit = " ".join(words[k + 1 :])
            return digits_of(w), unit if unit and squeezed(unit) not in ("unspecified", "unit", "ea", "each") else None
    return None, None


@lru_cache(maxsize=KEPT)
def refills_of(raw: str) -> str | None:
    m = re.match(r"\d+", digits_of(raw.split()[0])) if raw.split() else None
    return m and m.group()


def forbids(raw: str) -> bool | None:
    s = raw.strip().lower()
    return True if "not allowed" in s or s == "1" or "daw" in s else False if "allowed" in s or s == "0" else None


def is_phone(raw: str) -> bool:
    return bool(re.fullmatch(r"\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}", raw.strip()))


@lru_cache(maxsize=KEPT)
def number_of(text: str) -> str | None:
    """`npi` or `ndc` where a word is one by its shape."""
    s = text.strip()
    return "npi" if re.fullmatch(r"\d{10}", s) else "ndc" if re.fullmatch(r"\d{11}|\d{4,5}-\d{3,4}-\d{1,2}", s) else None


def all_fills(lines: list[list[Word]]) -> str | None:
    """The number of `N (including this fill)`."""
    for line in lines:
        t = [w.text.strip() for w in line]
        for k in range(len(t) - 3):
            if re.fullmatch(r"\d+", t[k]) and [t[k + 1].lower().removeprefix("("), t[k + 2].lower(), t[k + 3].lower().rstrip(").,")] == ["including", "this", "fill"]:
                return t[k]
    return None


def read(words: list[Word]) -> tuple[dict, list[dict]]:
    """(record, diagnostics) of one capture's words."""
    lines = lines_of([w for w in words if w.text and w.text.strip()])
    first = next((k for k, line in enumerate(lines) if label_at(line, longer=True)), None)
    if first is None:
        return {}, []
    below = lines[first:]
    r = Reading()
    own = lambda line: (m := label_at(line, longer=True)) and m[1][0] != "-"
    lines = [line for line in below if own(line) or sum(map(framed, line)) < 2]
    read_rows(r, lines)
    gather(r, "directions")
    gather(r, "location")
    read_columns(r)
    gather(r, "location")
    numbers = [(kind, w) for line in lines for w in line if (kind := number_of(w.text))]
    npi, code = (next((w for k, w in numbers if k == kind), None) for kind in ("npi", "ndc"))
    if "refills" not in r.values and (n := all_fills(below)):
        r.values["refills"], r.found["refills"], r.refills_name = n, ("pattern-anchor-fallback", []), "totalfills"
    return assembled(r, npi, code)


def assembled(r: Reading, npi: Word | None, code: Word | None) -> tuple[dict, list[dict]]:
    record: dict = {}
    notes: list[dict] = []
    checks = {"phone": is_phone, "quantity": lambda v: quantity_of(v)[0] is not None, "refills": lambda v: refills_of(v) is not None, "substitutions": lambda v: forbids(v) is not None}
    pool = [(text_of(line), line[0]) for line in r.left if text_of(line)]
    claimed = {v for k, v in r.values.items() if k not in checks or checks[k](v)} & {t for t, _ in pool}
    label = lambda key: next(({"text": b.text, "x": b.at.x, "y": b.at.y} for b in r.labels if b.key == key), None)

    def say(name: str, key: str | None, value=None, why: str = "no-value-paired", how: str | None = None, at: Word | None = None):
        if value is None:
            notes.append({"field": name, "status": "miss", "label": label(key) if key else None, "reason": why})
            return False
        at = at or next(iter(r.found.get(key, (None, []))[1]), None)
        notes.append({"field": name, "status": "resolved", "strategy": how or r.found.get(key, ("pattern-anchor",))[0], "label": label(key) if key else None, "value": {"text": str(value), "x": at.x if at else 0, "y": at.y if at else 0}})
        return True

    def date(key: str):
        """(value, how, where): the label's own text, as it is or repaired; else the first free line that is a date, but for the date from which it is available."""
        own = r.values.get(key)
        if own:
            for v in (own, repaired(own, True)):
                if v and date_of(v):
                    return v, None, None
        for t, at in pool if key != "available" else ():
            for v in (t, repaired(t)):
                if t not in claimed and v and date_of(v):
                    claimed.add(t)
                    return v, "pattern-anchor-fallback", at
        return None, None, None

    def take(name: str, key: str, into: dict, as_name: str, value, why: str = "no-value-paired", shown=None, how=None, at=None):
        if say(name, key, None if value is None else shown if shown is not None else value, why, how, at):
            into[as_name] = value

    dates = {k: date(k) for k in ("dob", "written", "available")}
    v = r.values.get
    wrong = lambda key, why: why if key in r.values else "no-value-paired"
    take("patientName", "patient", record, "patientName", v("patient"), "label-not-found")
    for name, key in (("patientDOB", "dob"), ("dateWritten", "written"), ("availableDate", "available")):
        value, how, at = dates[key]
        take(name, key, record, name, value, wrong(key, "validation-failed:date-shape"), how=how, at=at)
    take("patientAddress", "address", record, "patientAddress", v("address") and address_of(v("address")), shown=v("address"))
    take("sig", "directions", record, "sig", v("directions") and re.sub(r"\bO\.\s+(?=\d)", "0.", v("directions")))
    take("substitutionsNotAllowed", "substitutions", record, "substitutionsNotAllowed", forbids(v("substitutions")) if v("substitutions") else None, wrong("substitutions", "ambiguous-value"), shown=v("substitutions"))
    amount, unit = quantity_of(v("quantity") or "")
    take("quantity", "quantity", record, "quantity", amount, wrong("quantity", "validation-failed:not-numeric"))
    if amount and unit:
        record["quantityUnit"] = unit
    take("refills", "refills", record, "refills", refills_of(v("refills") or ""), wrong("refills", "validation-failed:not-numeric"))
    if "refills" in record and r.refills_name == "totalfills":
        record["refillsFromTotalFills"] = True
    who: dict = {}
    take("prescriber.name", "prescriber", who, "name", v("prescriber"))
    take("prescriber.phone", "phone", who, "phone", v("phone") if v("phone") and is_phone(v("phone")) else None, wrong("phone", "validation-failed:phone-shape"))
    take("prescriber.address", "location", who, "address", v("location") and address_of(v("location")), shown=v("location"))
    for name, into, key, word in (("prescriber.npi", who, "npi", npi), ("drug.ndc", drug := {}, "ndc", code)):
        if say(name, None, word and word.text.strip(), "not-found-in-capture", "pattern-anchor", word):
            into[key] = word.text.strip()
    take("drug.name", "medication", drug, "name", v("medication"))
    return record | ({"prescriber": who} if who else {}) | ({"drug": drug} if drug else {}), notes


NOTE = "array<struct<field:string,status:string,strategy:string,label:struct<text:string,x:double,y:double>,value:struct<text:string,x:double,y:double>,reason:string>>"


def read_arrays(words):
    """[(record, diagnostics)] of a list<struct<word, text, x, y, w, h>> array of captures."""
    flat = words.flatten()
    ends = pc.fill_null(pc.list_value_length(words), 0).to_pylist()
    texts = flat.field("text").to_pylist()
    boxes = [pc.fill_null(flat.field(k).cast("double"), math.nan).to_pylist() for k in ("x", "y", "w", "h")]
    every = [Word(t or "", x, y, w, h) for t, x, y, w, h in zip(texts, *boxes)]
    out, at = [], 0
    for n in ends:
        try:
            out.append(read(every[at : at + n]))
        except Exception:  # a screen is never the reason for a failure
            out.append(({}, []))
        at += n
    return out


def records(words: DataFrame) -> DataFrame:
    """(capture, record, diagnostics) of words(capture, word, text, x, y, w, h). A capture in which no label is known has an empty record; so has one that can't be read."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    both = f"struct<record:{RECORD},diagnostics:{NOTE}>"
    types = [to_arrow_type(_parse_datatype_string(x)) for x in (RECORD, NOTE)]

    def read_all(words: pa.Array) -> pa.Array:
        found = read_arrays(words)
        return pa.StructArray.from_arrays([pa.array([x[i] for x in found], types[i]) for i in range(2)], ["record", "diagnostics"])

    grouped = words.groupBy("capture").agg(F.sort_array(F.collect_list(F.struct("word", "text", "x", "y", "w", "h"))).alias("_w"))
    return grouped.select("capture", F.arrow_udf(read_all, both)("_w").alias("_r")).select("capture", "_r.record", "_r.diagnostics")
