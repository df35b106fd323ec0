"""Comparators of one field: struct(status, reason_code) of a source and an entered value. The order of the rungs is the specification."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenpair.functions import scalars as S
from lumenpair.functions.addresses import parse_address
from lumenpair.functions.directions import parse_directions
from lumenpair.functions.scalars import blank, ladder


@dataclass(frozen=True)
class Comparison:
    """What is read out of the two values, by name, and the ladder over it. Parts are columns of an inner projection, so each is computed once, however many rungs use it."""

    parts: dict[str, Column]
    ladder: Callable[[Callable[[str], Column]], Column]

    def inline(self) -> Column:
        return self.ladder(self.parts.__getitem__)


def compared(rows: DataFrame, **comparisons: Comparison) -> DataFrame:
    """rows with the verdict of each comparison in a column of its name."""
    inner = rows.select("*", *[c.alias(f"__{f}_{k}") for f, x in comparisons.items() for k, c in x.parts.items()])
    return inner.select(*[F.col(f"`{c}`") for c in rows.columns], *[x.ladder(lambda k, f=f: F.col(f"`__{f}_{k}`")).alias(f) for f, x in comparisons.items()])


def nothing(c: Column) -> Column:
    """Null or empty; white space is something, here."""
    return c.isNull() | (c == "")


def _dates(missing: Column, a: Column, b: Column) -> Column:
    return ladder((missing, "yellow", "not_provided"), (a.isNull() | b.isNull(), "yellow", "unparseable_date"), (a == b, "green", "exact_match"), (True, "red", "date_mismatch"))


def dates(src: Column, ent: Column, past_only: bool = False, this_year: int = 2026) -> Comparison:
    parts = {"missing": blank(src) | blank(ent), "a": S.parse_date(src, past_only, this_year), "b": S.parse_date(ent, past_only, this_year)}
    return Comparison(parts, lambda p: _dates(p("missing"), p("a"), p("b")))


def written_or_available(written: Column, available: Column, ent: Column) -> Comparison:
    """The entered date may be the date written or the date from which a record is available."""
    parts = {"w_blank": blank(written), "v_blank": blank(available), "e_blank": blank(ent), "w": S.parse_date(written), "v": S.parse_date(available), "e": S.parse_date(ent)}

    def rungs(p):
        w_none, v_none, e_none, w, v, e = map(p, parts)
        bad = v.isNull() | e.isNull()
        return ladder(
            (v_none & (w_none | e_none), "yellow", "not_provided"),
            (v_none & (w.isNull() | e.isNull()), "yellow", "unparseable_date"),
            (v_none & (w == e), "green", "exact_match"),
            (v_none, "red", "date_mismatch"),
            (e_none, "yellow", "not_provided"),
            (bad, "yellow", "unparseable_date"),
            (v == e, "green", "available_date_match"),
            (~w_none & (w == e), "green", "exact_match"),
            (True, "red", "date_mismatch"),
        )

    return Comparison(parts, rungs)


def quantity(src: Column, src_unit: Column, ent: Column, ent_unit: Column, per_day: Column) -> Comparison:
    """per_day: units taken in a day by the entered directions, null where they don't say. Two quantities that last a whole number of days each, one of them a
    multiple of the other, are an adjustment."""
    parts = {"missing": nothing(src) | nothing(ent), "a": S.any_number(src), "b": S.any_number(ent), "ua": S.unit(src_unit), "ub": S.unit(ent_unit), "day": F.when(per_day > 0, per_day)}

    def rungs(p):
        missing, a, b, ua, ub, day = map(p, parts)
        fits = ua.isNull() | ub.isNull() | (ua == ub)
        whole = lambda q: F.floor(q / day + 0.5)
        days = lambda q: S.wholeish(q / day) & whole(q).between(1, 120)
        ratio = F.greatest(whole(a), whole(b)) / F.nullif(F.least(whole(a), whole(b)), F.lit(0))
        return ladder(
            (missing, "yellow", "not_provided"),
            (S.no_number(a) | S.no_number(b), "yellow", "unparseable_quantity"),
            ((a == b) & fits, "green", "exact_match"),
            (~fits, "red", "unit_mismatch"),
            (days(a) & days(b) & S.wholeish(ratio) & (ratio <= 6), "yellow", "quantity_adjusted"),
            (True, "red", "quantity_mismatch"),
        )

    return Comparison(parts, rungs)


def refills(src: Column, ent: Column, total_fills: Column) -> Comparison:
    """total_fills: whether the source counts the first fill too."""
    parts = {"missing": nothing(src) | nothing(ent), "a": S.any_number(src), "b": S.any_number(ent), "all": F.coalesce(total_fills, F.lit(False))}

    def rungs(p):
        a, b = p("a"), p("b")
        left = F.when(p("all"), F.greatest(a - 1, F.lit(0.0))).otherwise(a)
        return ladder((p("missing"), "yellow", "not_provided"), (S.no_number(a) | S.no_number(b), "yellow", "unparseable_quantity"), (left == b, "green", "exact_match"), (True, "red", "refills_mismatch"))

    return Comparison(parts, rungs)


def npi(src: Column, ent: Column) -> Comparison:
    parts = {"missing": blank(src) | blank(ent), "a": S.digits(src), "b": S.digits(ent)}
    return Comparison(parts, lambda p: ladder((p("missing"), "yellow", "not_provided"), (p("a") == p("b"), "green", "exact_match"), (True, "red", "npi_mismatch")))


def phone(src: Column, ent: Column) -> Comparison:
    tail = lambda c: F.right(S.digits(c), F.lit(10))
    parts = {"missing": blank(src) | blank(ent), "a": tail(src), "b": tail(ent)}

    def rungs(p):
        a, b = p("a"), p("b")
        local = (F.right(a, F.lit(7)) == F.right(b, F.lit(7))) & (F.length(a) >= 7)
        usual = lambda d: d.rlike(r"^[2-9]\d{9}$")
        return ladder(
            (p("missing"), "yellow", "not_provided"),
            ((a == b) & (a != ""), "green", "exact_match"),
            (local & usual(a) & usual(b), "red", "phone_area_code_mismatch"),
            (local, "yellow", "phone_ocr_suspect"),
            (True, "yellow", "phone_differs"),
        )

    return Comparison(parts, rungs)


def substitution(not_allowed: Column, as_written: Column) -> Comparison:
    """A null is unknown, which is not false; a source that allows substitution agrees with whatever was entered."""
    rungs = ((not_allowed.isNull(), "yellow", "not_provided"), (~not_allowed, "green", "substitution_allowed"), (as_written.isNull(), "yellow", "not_provided"), (as_written, "green", "daw_consistent"), (True, "red", "daw_required"))
    return Comparison({}, lambda p: ladder(*rungs))


def names(src: Column, ent: Column) -> Comparison:
    return Comparison({"missing": blank(src) | blank(ent), "a": S.parse_name(src), "b": S.parse_name(ent)}, lambda p: _names(p("a"), p("b"), p("missing")))


def _names(a: Column, b: Column, missing: Column) -> Column:
    split = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    bag = lambda n: F.array_sort(F.filter(F.concat(F.array(n["first"]), n["middle"], split(n["last"])), lambda t: t != ""))
    full = lambda n: F.trim(F.concat_ws(" ", n["first"], n["last"]))
    glued = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    la, lb = split(a["last"]), split(b["last"])
    same = (full(a) != "") & ((full(a) == full(b)) | (bag(a) == bag(b)))
    one_suffix, both_differ = a["suffix"].isNull() != b["suffix"].isNull(), a["suffix"] != b["suffix"]
    surname = (a["last"] != "") & (b["last"] != "") & (glued(a["last"]) == glued(b["last"]))
    partial = F.arrays_overlap(la, lb)
    longer, shorter = F.when(F.size(la) >= F.size(lb), la).otherwise(lb), F.when(F.size(la) >= F.size(lb), lb).otherwise(la)
    is_tail = F.when((F.size(shorter) > 0) & (F.size(shorter) < F.size(longer)), F.slice(longer, -F.greatest(F.size(shorter), F.lit(1)), F.greatest(F.size(shorter), F.lit(1))) == shorter)
    exact = a["first"] == b["first"]
    nick = F.arrays_overlap(S.canonicals(a["first"]), S.canonicals(b["first"]))
    shared = F.arrays_overlap(split(a["first"]), split(b["first"]))
    fuzzy = (F.length(a["first"]) >= 3) & (F.length(b["first"]) >= 3) & (F.startswith(a["first"], b["first"]) | F.startswith(b["first"], a["first"]))
    return ladder(
        (missing, "yellow", "not_provided"),
        (same & both_differ, "red", "suffix_mismatch"),
        (same & one_suffix, "yellow", "suffix_dropped"),
        (same, "green", "exact_match"),
        (~surname & ~partial, "red", "surname_mismatch"),
        (~exact & ~nick & ~shared & ~fuzzy, "red", "first_name_mismatch"),
        (both_differ, "red", "suffix_mismatch"),
        (~surname & is_tail, "yellow", "middle_name_present"),
        (~surname, "yellow", "surname_partial"),
        (~exact & ~nick & shared, "yellow", "given_name_partial"),
        (one_suffix, "yellow", "suffix_dropped"),
        (~exact, "yellow", "nickname_match"),
        (True, "green", "exact_match"),
    )


def address(src: Column, ent: Column) -> Comparison:
    """Of two struct(street, unit, city, state, zip). Never red: people move."""
    fields = ("street", "unit", "city", "state", "zip")
    empty = lambda c: F.coalesce(blank(F.concat_ws("", *[c[k] for k in fields])), F.lit(True))
    read = lambda c: F.when(~empty(c), parse_address(F.coalesce(c["street"], F.lit("")), *[c[k] for k in fields[1:]]))
    return Comparison({"a": read(src), "b": read(ent)}, lambda p: _addresses(p("a"), p("b")))


def _addresses(a: Column, b: Column) -> Column:
    stray = lambda n, other: n["suffix"].isNull() & other["suffix"].isNotNull() & n["last"].rlike("^[a-z]$") & ~n["last"].isin(*"nsew")
    base = lambda n, other: F.when(stray(n, other), n["short"]).otherwise(n["base"])
    words = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    alike = lambda x, y: (x == y) | (x.rlike("^[a-z]{5,}$") & y.rlike("^[a-z]+$") & (F.length(x) == F.length(y)) & (F.levenshtein(x, y) <= 1))
    x, y = base(a, b), base(b, a)
    apart = (x != y) & ((F.size(words(x)) != F.size(words(y))) | F.exists(F.zip_with(words(x), words(y), lambda s, t: ~F.coalesce(alike(s, t), F.lit(False))), lambda v: v))
    lacks = lambda s, t: (t != "") & (s == "")
    differ = lambda k: (a[k] != "") & (b[k] != "") & (a[k] != b[k])
    street = lacks(x, y) | ((x != "") & (y != "") & apart) | F.coalesce(a["suffix"] != b["suffix"], F.lit(False))
    city, state, zip_code = lacks(a["city"], b["city"]) | differ("city"), differ("state"), differ("zip")
    confirmed = (a["base"] != "") & (b["base"] != "") & ~street
    partial = (((a["state"] == "") | (a["zip"] == "")) & ~state & ~zip_code & confirmed & (a["city"] != "") & (b["city"] != "") & ~city) | (
        (a["city"] == "") & (a["state"] == "") & (a["zip"] == "") & ((b["city"] != "") | (b["state"] != "") | (b["zip"] != "")) & confirmed
    )
    unit = lambda n: F.translate(n["unit"], "ilo", "110")
    return ladder(
        (a.isNull() | b.isNull(), "yellow", "not_provided"),
        (~partial & (street | city | state | zip_code), "yellow", "address_differs"),
        (unit(a) != unit(b), "yellow", "unit_differs"),
        (partial, "green", "exact_match_partial_source"),
        (True, "green", "exact_match"),
    )


def directions(src: Column, ent: Column) -> Comparison:
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(S.trimmed(F.lower(c)), r"(?U)\s+", " "), "[.,;:!]+$", ""))
    read = lambda c: F.when(~blank(c), parse_directions(c))
    return Comparison({"missing": blank(src) | blank(ent), "same": plain(src) == plain(ent), "a": read(src), "b": read(ent)}, lambda p: _directions(p("missing"), p("same"), p("a"), p("b")))


def _directions(missing: Column, same: Column, a: Column, b: Column) -> Column:
    differ = lambda k: F.coalesce(a[k] != b[k], F.lit(False))
    lone = lambda k: a[k].isNull() != b[k].isNull()
    some = lambda n: F.size(n["times"]) > 0
    both = ("dose", "route", "per_day", "days", "meal")
    contradict = differ("unit") | differ("as_needed") | (some(a) & some(b) & (a["times"] != b["times"]))
    open_ = some(a) != some(b)
    for k in both:
        contradict, open_ = contradict | differ(k), open_ | lone(k)
    left = F.size(F.array_except(a["rest"], b["rest"])) + F.size(F.array_except(b["rest"], a["rest"])) > 0
    return ladder(
        (missing, "yellow", "not_provided"),
        (same, "green", "verbatim_match"),
        (a["vague"] | b["vague"] | a["unknown_rate"] | b["unknown_rate"], "yellow", "sig_ambiguous"),
        (contradict, "red", "sig_mismatch"),
        (open_ | left, "yellow", "sig_ambiguous"),
        (True, "green", "exact_match"),
    )


def per_day(sig: Column) -> Column:
    """Units taken in a day by a struct of parse_directions; null where it doesn't say."""
    return F.when((sig["dose"] > 0) & (sig["per_day"] > 0), sig["dose"] * sig["per_day"])
