"""Column -> Column functions that read dates, numbers, codes, units and names out of free text. A null gives a null; nothing raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenpair.functions import vocabulary as V

MONTHS = "january february march april may june july august september october november december".split()
#: All that counts as white space at the ends of a text, not only the space.
WHITE = "\t\n\x0b\x0c\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
TITLES, SUFFIXES = ("dr", "mr", "mrs", "ms", "prof"), ("jr", "sr", "ii", "iii", "iv", "v")


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def blank(c: Column) -> Column:
    return F.coalesce(trimmed(c), F.lit("")) == ""


def group(c: Column, pattern: str, k: int) -> Column:
    """Group k of a pattern; null where it doesn't match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, k))


def parse_date(c: Column, past_only: bool = False, this_year: int = 2026) -> Column:
    """yyyy-MM-dd of an ISO, numeric (M/D/YY, M/D/YYYY) or written (Jul 2, 2026) date; null for anything else. Two-digit years up to 49 are 20xx; with
    past_only those after this_year are a century earlier."""
    s = trimmed(c)
    iso, slash, word = r"^\d{4}-\d{1,2}-\d{1,2}$", r"^(\d{1,2})/(\d{1,2})/(%s)$", r"^([A-Za-z]+)\.?\s+(\d{1,2}),?\s+(\d{4})$"
    names = {x: str(k + 1) for k, m in enumerate(MONTHS) for x in (m, m[:3])} | {"sept": "9"}
    month = F.try_element_at(literal_map(names), F.lower(F.regexp_extract(s, word, 1)))
    forms = [(slash % r"\d{4}", "$3-$1-$2"), (slash % r"[0-4]\d", "20$3-$1-$2"), (slash % r"[5-9]\d", "19$3-$1-$2")]
    ymd = F.when(s.rlike(iso), s)
    for pattern, to in forms:
        ymd = ymd.when(s.rlike(pattern), F.regexp_replace(s, pattern, to))
    ymd = ymd.when(s.rlike(word), F.concat_ws("-", F.regexp_extract(s, word, 3), month, F.regexp_extract(s, word, 2)))
    date = F.call_function("try_to_date", ymd, F.lit("y-M-d"))  # null for a day that the month doesn't have
    if past_only:
        date = F.when(s.rlike(slash % r"\d\d") & (F.year(date) > this_year), F.add_months(date, -1200)).otherwise(date)
    return F.date_format(date, "yyyy-MM-dd")


def any_number(c: Column) -> Column:
    """A number in decimal, with any exponent, or in hexadecimal, octal or binary; one too large is infinite. Blank text is zero, as its comparators take it; null for other text."""
    s = trimmed(c)
    based = lambda base: F.conv(F.substring(s, 3, 99), base, 10).cast("double")
    out = F.when(s == "", F.lit(0.0)).when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))
    return out.when(s.rlike("^0[xX][0-9a-fA-F]+$"), based(16)).when(s.rlike("^0[oO][0-7]+$"), based(8)).when(s.rlike("^0[bB][01]+$"), based(2))


def no_number(n: Column) -> Column:
    """Whether any_number() gave none that is finite."""
    return n.isNull() | (F.abs(n) == float("inf"))


def number(c: Column) -> Column:
    """any_number(), where it is finite."""
    n = any_number(c)
    return F.when(F.abs(n) < float("inf"), n)


def wholeish(x: Column) -> Column:
    return F.abs(x - F.floor(x + 0.5)) < 0.05


def unit(c: Column) -> Column:
    """A unit under its common alias; null where none is said, or only that it is each or unspecified."""
    folded = trimmed(F.lower(c))
    return F.when(~folded.isin("", "ea", "each", "unspecified"), F.coalesce(F.try_element_at(literal_map(V.QUANTITY_UNITS), folded), folded))


def currency(c: Column) -> Column:
    """Money with $, thousands commas, or parentheses for a negative; null where blank or unreadable."""
    bare = F.regexp_replace(F.trim(c), r"[$,()\s]", "")
    value = bare.try_cast("decimal(18,4)")
    return F.when(F.trim(c).rlike(r"^\(.*\)$"), -value).otherwise(value)


def package_quantity(c: Column) -> Column:
    """The number after the word `with`; else the only number, if there is just one."""
    found = F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return F.coalesce(group(c, r"(?i)\bwith\s+(\d+(?:\.\d+)?)", 1), F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1)))).try_cast("decimal(18,4)")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def ndc11(c: Column) -> Column:
    """The 11 digits of a product code: three dashed parts of 10 digits are padded by their layout; a bare one must have all 11."""
    s = F.trim(c)
    p = r"^(\d+)-(\d+)-(\d+)$"
    a, b, d = (group(s, p, k) for k in (1, 2, 3))
    total = F.length(a) + F.length(b) + F.length(d)
    pad = lambda x, n: F.when(F.length(x) >= n, x).otherwise(F.lpad(x, n, "0"))
    return F.when(total.isin(10, 11), F.concat(pad(a, 5), pad(b, 4), pad(d, 2))).when(s.rlike(r"^\d{11}$"), s)


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def parse_name(c: Column) -> Column:
    """struct(first, last, middle array, suffix) of `Last, First Middle` or `First Last`; hyphens separate as spaces do. Leading titles and trailing
    generational suffixes go, as long as a word stays; of several suffixes the innermost counts."""
    folded = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[.'’]", ""), r"(?U)\s+", " "))
    tail = rf"(?: (?:{'|'.join(SUFFIXES)}))+"
    untitled = lambda x: F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), rf"^(?:(?:{'|'.join(TITLES)}) )+(?=\S)", "")
    body = lambda x: F.regexp_replace(x, rf"^(\S.*?){tail}$", "$1")
    suffix = lambda x: F.nullif(F.regexp_extract(x, rf"^\S.*? (\S+?)(?<= (?:{'|'.join(SUFFIXES)}))(?:{tail})?$", 1), F.lit(""))
    spaced = lambda x: F.trim(F.replace(x, F.lit("-"), F.lit(" ")))
    words = lambda x: F.filter(F.split(x, " "), lambda t: t != "")
    after = lambda x: F.regexp_replace(x, r"^\S* ?", "")
    none = F.array().cast("array<string>")

    def commas(p: Column) -> Column:
        one, two = p[0], p[1]
        return F.struct(spaced(F.substring_index(body(two), " ", 1)).alias("first"), spaced(body(one)).alias("last"), words(after(body(two))).alias("middle"), F.coalesce(suffix(one), suffix(two)).alias("suffix"))

    parts = F.split(folded, ",")
    with_comma = let(F.array(untitled(F.try_element_at(parts, F.lit(1))), untitled(F.try_element_at(parts, F.lit(2)))), commas)
    plain = let(untitled(folded), lambda x: F.struct(spaced(F.substring_index(body(x), " ", 1)).alias("first"), spaced(after(body(x))).alias("last"), none.alias("middle"), suffix(x).alias("suffix")))
    return F.when(folded.contains(","), with_comma).otherwise(plain)


def canonicals(first: Column) -> Column:
    """All canonical forms of a given name; an unknown one stands for itself."""
    by: dict[str, list[str]] = {}
    for g in "".join(V.NICKNAMES).split(";"):
        canonical, _, variants = g.strip().partition(":")
        for name in (canonical, *variants.split()):
            by.setdefault(name, []).append(canonical)
    table = F.create_map(*[x for k, v in by.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(table, first), F.array(first))


def ladder(*rungs: tuple[Column | bool, str, str]) -> Column:
    """struct(status, reason_code) of the first rung whose condition holds; a condition that is null doesn't."""
    verdict = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason_code"))
    first, *rest = rungs
    return reduce(lambda a, x: a.otherwise(verdict(*x[1:])) if x[0] is True else a.when(x[0], verdict(*x[1:])), rest, F.when(first[0], verdict(*first[1:])))
