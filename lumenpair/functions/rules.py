"""Small rules on single values: lines, titles, labels, colours, keys and sets. Nulls give null or false as stated; nothing raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenpair.functions.scalars import blank, currency, trimmed

MARKER = "escript"
#: Letters that are read for one another.
LOOK_ALIKE = ("dp", "li1", "o0")
SHORT_LABELS = (
    ("Waiting for a PioneerRx", "Waiting"), ("Checked ", "Checked"), ("Rx is not an escript", "Not escript"), ("OCR didn't find enough text", "No OCR text"), ("No PioneerRx window found", "No window"),
    ("Open the Escript tab", "Open Escript"), ("UIA source read failed", "UIA error"), ("UIA read failed", "UIA error"), ("Drug lookup failed", "Lookup error"),
)
UNREADABLE = ("not_provided", "unparseable_date", "unparseable_quantity")


def has_marker(word: Column, marker: str = MARKER, most: int = 2) -> Column:
    """Whether a word is the marker, but for what isn't a letter behind it, with at most `most` letters read for a look-alike."""
    w = F.lower(F.regexp_replace(word, r"(?U)\P{L}+$", ""))
    alike = {c: "".join(sorted({x for g in LOOK_ALIKE if c in g for x in g} | {c})) for c in marker}
    wrong = reduce(lambda a, b: a + b, [(F.substring(w, k + 1, 1) != c).cast("int") for k, c in enumerate(marker)])
    return F.coalesce(w.rlike("^" + "".join(f"[{alike[c]}]" for c in marker) + "$") & (wrong <= most), F.lit(False))


def usability(n_words: Column, marked: Column, least: int = 5) -> Column:
    """Too few words goes before having no marker."""
    return F.when(F.coalesce(n_words, F.lit(0)) < least, "TooSparse").when(~F.coalesce(marked, F.lit(False)), "NotAnEscript").otherwise("Usable")


def screen(title: Column) -> Column:
    """The mode that a window's title tells, by its parts in their order."""
    t = F.lower(F.coalesce(title, F.lit("")))
    return F.when(t.contains("pre-check") | t.contains("precheck"), "PreCheck").when(t.contains("edit rx"), "EditRx").when(t.contains("new rx"), "NewRx").otherwise("Unknown")


def order_window(title: Column) -> Column:
    t = F.lower(trimmed(F.coalesce(title, F.lit(""))))
    return F.when(t.startswith("recommended order - catalog item substitution selection"), "CatalogSubstitution").when(t.startswith("create recommended orders"), "CreateRecommendedOrders").otherwise("None")


def short_label(message: Column, most: int = 14) -> Column:
    """The label of the first known prefix, else the message, cut with an ellipsis behind `most` characters. Null is empty."""
    m = F.coalesce(message, F.lit(""))
    first, *rest = [(F.startswith(m, F.lit(p)), s) for p, s in SHORT_LABELS]
    known = reduce(lambda a, x: a.when(*x), rest, F.when(*first))
    return known.otherwise(F.when(F.length(m) <= most, m).otherwise(F.concat(F.rtrim(F.left(m, F.lit(most))), F.lit("…"))))


def bar_colour(status: Column, reason: Column) -> Column:
    """Yellow is gray where nothing could be read."""
    return F.when(status == "green", "Green").when(status == "red", "Red").when(F.coalesce(reason, F.lit("")).isin(*UNREADABLE), "Gray").otherwise("Yellow")


def shows_box(status: Column, entered: Column, source: Column) -> Column:
    """All but green, and green where substitution is in play on either side."""
    none = F.lit("")
    return (F.coalesce(status, none) != "green") | (F.coalesce(entered, none) == "DAW checked") | (F.coalesce(source, none) == "Substitution NOT allowed (DAW)")


def update_available(local: Column, remote: Column) -> Column:
    """Whether the remote commit is another; what isn't known is no update."""
    known = ~blank(local) & ~blank(remote) & (F.lower(local) != "unknown")
    return F.coalesce(known & ~F.startswith(F.lower(trimmed(remote)), F.lower(trimmed(local))), F.lit(False))


def sha_of(response: Column) -> Column:
    """The text under `sha` at the top of a JSON object; null where there is none, or it isn't text."""
    v = F.try_variant_get(F.try_parse_json(response), "$.sha", "string")
    is_text = F.coalesce(F.get_json_object(response, "$.sha") == v, F.lit(False)) & response.rlike(r'"sha"\s*:\s*"')
    return F.when(is_text & ~blank(v), v)


def key_merge(provided: Column, state: Column, existing: Column) -> Column:
    """What to do about a key in a settings file that is missing, unreadable, no object, or an object with or without a key."""
    return (
        F.when(blank(provided), "skip-no-key-provided")
        .when(state == "missing", "write")
        .when(state.isin("unreadable", "non-object"), "write-with-backup")
        .when(existing == provided, "skip-already-matches")
        .otherwise("write")
    )


def rejection(field: Column, status: Column, correction: Column, fields: tuple[str, ...], private: tuple[str, ...], most: int = 4000) -> Column:
    """Why a report is turned away, by the first rule it breaks; null where it isn't."""
    return (
        F.when(blank(field) | ~field.isin(*fields), "unknown_field")
        .when(field.isin(*private), "private_field")
        .when(~F.coalesce(status, F.lit("")).isin("green", "yellow", "red"), "unknown_status")
        .when(blank(correction), "no_correction")
        .when(F.length(correction) > most, "too_long")
    )


def scrubbed(text: Column, phrases: Column, tokens: Column, runs: Column, mark: str = "[redacted]") -> Column:
    """The text without any of the phrases (in any case), then without tokens, and without words that hold one of the runs of digits. phrases, tokens and runs are
    arrays; tokens are in lower case. Blank phrases are none."""
    quoted = F.transform(F.filter(F.coalesce(phrases, F.array().cast("array<string>")), lambda p: ~blank(p)), lambda p: F.concat(F.lit(r"(?iu)\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    out = F.aggregate(quoted, text, lambda t, p: F.regexp_replace(t, p, F.lit(mark)))
    pieces = F.regexp_extract_all(out, F.lit("[A-Za-z0-9]+|[^A-Za-z0-9]+"), F.lit(0))
    digits = lambda w: F.regexp_replace(w, "[^0-9]", "")
    gone = lambda w: F.coalesce(F.array_contains(tokens, F.lower(w)), F.lit(False)) | ((F.length(digits(w)) >= 5) & F.coalesce(F.exists(runs, lambda r: digits(w).contains(r)), F.lit(False)))
    return F.array_join(F.transform(pieces, lambda w: F.when(gone(w), F.lit(mark)).otherwise(w)), "")


def scrub_tokens(value: Column) -> Column:
    """Words of a value that are scrubbed: of two letters or three digits at least."""
    words = F.regexp_extract_all(F.lower(value), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= F.when(w.rlike("^[0-9]+$"), 3).otherwise(2)))


def scrub_runs(value: Column) -> Column:
    """Runs of digits of a value: long ones and their first five, and what two or three neighbours of three digits or more make together."""
    runs = F.filter(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), lambda r: F.length(r) >= 3)
    at = lambda i, k: F.coalesce(F.try_element_at(runs, i + k), F.lit(""))
    each = F.transform(runs, lambda r, i: F.array(F.when(F.length(r) >= 5, r), F.when(F.length(r) > 5, F.left(r, F.lit(5))), F.when(at(i, 2) != "", F.concat(r, at(i, 2))), F.when(at(i, 3) != "", F.concat(r, at(i, 2), at(i, 3)))))
    return F.array_distinct(F.filter(F.flatten(each), lambda r: F.length(r) >= 5))


def key_value(text: Column) -> Column:
    """struct(key, value) of `Key: Value`, split at the first colon and space; without one the text is the key, and the value empty."""
    at = F.instr(text, ": ")
    return F.struct(F.when(at > 0, F.left(text, at - 1)).otherwise(text).alias("key"), F.when(at > 0, F.substring(text, at + 2, F.length(text))).otherwise("").alias("value"))


def last_value(text: Column) -> Column:
    """What stands behind the last colon and space; empty without one."""
    return F.when(text.contains(": "), F.substring_index(text, ": ", -1)).otherwise("")


def in_parentheses(text: Column) -> Column:
    """What the first parentheses hold, else the text; null where it is blank."""
    return F.when(~blank(text), F.when(text.rlike(r"^[^(]*\([^)]*\)"), trimmed(F.regexp_extract(text, r"^[^(]*\(([^)]*)\)", 1))).otherwise(trimmed(text)))


def before_parentheses(text: Column) -> Column:
    return F.rtrim(F.substring_index(text, " (", 1))


def display_date(iso: Column) -> Column:
    """M/D/YYYY of yyyy-MM-dd; anything else as it is."""
    date = F.when(trimmed(iso).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.call_function("try_to_date", trimmed(iso), F.lit("yyyy-MM-dd")))
    return F.coalesce(F.date_format(date, "M/d/yyyy"), iso)


def chroma(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b)


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def percent(share: Column) -> Column:
    """A percentage with one decimal at most: 25%, 33.3%."""
    return F.concat(F.regexp_replace(F.format_string("%.1f", share), r"\.0$", ""), F.lit("%"))


def zero_state(cell: Column) -> Column:
    v = currency(cell)
    return F.when(v.isNull(), "Unknown").when(v == 0, "Zero").otherwise("NonZero")


def is_primary(supplier: Column) -> Column:
    """Whether it is the supplier that others are held against; a blank one isn't."""
    return F.coalesce(F.lower(supplier).contains("mckesson"), F.lit(False))


def elapsed(*stages: Column) -> Column:
    """Milliseconds of all stages; one that didn't run counts nothing."""
    return reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0).cast("long")) for s in stages])


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def one_each(a: Column, b: Column) -> Column:
    """struct(a, b) of the one value that only a has and the one that only b has; null unless there is exactly one of either."""
    x, y = F.array_except(a, b), F.array_except(b, a)
    return F.when((F.size(x) == 1) & (F.size(y) == 1), F.struct(F.try_element_at(x, F.lit(1)).alias("a"), F.try_element_at(y, F.lit(1)).alias("b")))


def either_only(a: Column, b: Column) -> Column:
    """What one of two sets has and the other hasn't, sorted."""
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


DIGIT_LIKE = {"O": "0", "o": "0", "l": "1", "I": "1", "S": "5", "B": "8"}


def repaired_digits(c: Column) -> Column:
    """Letters that look like digits as these, where there are no others and, in more than two, digits aren't the fewer."""
    likes = "".join(DIGIT_LIKE)
    fixed = F.translate(c, likes, "".join(DIGIT_LIKE.values()))
    n_like, n_digit = F.length(F.regexp_replace(c, f"[^{likes}]", "")), F.length(F.regexp_replace(c, "[^0-9]", ""))
    return F.when(~c.rlike(f"[a-zA-Z&&[^{likes}]]") & (n_like > 0) & ((n_digit >= n_like) | (n_like + n_digit <= 2)), fixed).otherwise(c)


def repaired_date(c: Column, labelled: bool = False) -> Column:
    """A date whose marks or digits were misread, with slashes; null where nothing was to repair. A mark read as l, I, 1 or | is put right only where the text
    stands by its label."""
    t = trimmed(c)
    d = repaired_digits(t)
    d = F.when(d.rlike(r"^\d{1,4}[\s.-]\d{1,2}[\s.-]\d{2,4}$"), F.regexp_replace(d, r"[\s.-]", "/")).otherwise(d)
    shapes = [(r"^(\d{1,2})/(\d{1,2})/(\d{3})\s(\d)$", "$1/$2/$3$4"), (r"^(\d{1,2})/(\d{2})(\d{4})$", "$1/$2/$3"), (r"^(\d{2})(\d{2})/(\d{4})$", "$1/$2/$3")]
    shapes += [(r"^(\d{2})[/lI1|](\d{2})[/lI1|](\d{4})$", "$1/$2/$3")] if labelled else []
    first, *rest = [(d.rlike(p), F.regexp_replace(d, p, to)) for p, to in shapes]
    return reduce(lambda a, x: a.when(*x), rest, F.when(*first)).otherwise(F.when(d != t, d))
