import pytest
from pyspark.sql import functions as F

from lumenpair.functions import scalars as S
from lumenpair.operators import fields


def ask(spark, f, *values):
    schema = ", ".join(f"c{i} {'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'string'}" for i, v in enumerate(values))
    rows, v = spark.createDataFrame([values], schema), f(*[F.col(f"c{i}") for i in range(len(values))])
    return (fields.compared(rows, v=v) if isinstance(v, fields.Comparison) else rows.select(v.alias("v"))).first()["v"]


@pytest.mark.parametrize(
    "src, ent, want",
    [
        ("Jordan Rivera", "Rivera, Jordan", "exact_match"),
        ("Rivera, Jordan Alex", "Jordan Rivera", "exact_match"),
        ("Jordan Alex Rivera", "Jordan Rivera", "middle_name_present"),
        ("William Smith", "Bill Smith", "nickname_match"),
        ("William Smith Jr", "William Smith", "suffix_dropped"),
        ("William Smith Jr", "William Smith Sr", "suffix_mismatch"),
        ("Ann Smith-Jones", "Ann SmithJones", "exact_match"),
        ("Ann Garcia Lopez", "Ann Garcia Perez", "surname_partial"),
        ("Mary-Jane Smith", "Mary Smith", "given_name_partial"),
        ("Ann Smith", "Zoe Smith", "first_name_mismatch"),
        ("Ann Smith", "Ann Brown", "surname_mismatch"),
        ("Dr. Ann O'Neil", "ann oneil", "exact_match"),
        (None, "Ann Smith", "not_provided"),
        ("  ", "Ann Smith", "not_provided"),
        ("\t\u00a0\n", "Ann Smith", "not_provided"),
        ("Michael Smith", "Mike Smith", "nickname_match"),
        ("Edward Smith", "Ted Smith", "nickname_match"),
        ("Theodore Smith", "Ted Smith", "nickname_match"),
        ("Alexandra Smith", "Sasha Smith", "nickname_match"),
    ],
)
def test_names(spark, src, ent, want):
    assert ask(spark, fields.names, src, ent)["reason_code"] == want


@pytest.mark.parametrize("text, want", [("2024-2-29", "2024-02-29"), ("2023-02-29", None), ("2/3/49", "2049-02-03"), ("2/3/50", "1950-02-03"), ("July 2, 2026", "2026-07-02"), ("Jul 2 2026", "2026-07-02"), ("13/1/2020", None), ("", None), (None, None), ("Foo 2, 2026", None)])
def test_parse_date(spark, text, want):
    assert ask(spark, S.parse_date, text) == want


def test_dates_with_white_space_around_them(spark):
    v = lambda a, b: ask(spark, fields.dates, a, b)["reason_code"]
    assert [v("\t", "2024-01-01"), v("2024-01-01\n", "1/1/2024"), v("\u00a02024-01-01", "2024-01-02")] == ["not_provided", "exact_match", "date_mismatch"]


def test_every_nickname_stands_for_its_canonical_form(spark):
    from lumenpair.functions import vocabulary as V

    groups = [g.strip().partition(":")[::2] for g in "".join(V.NICKNAMES).split(";") if g.strip()]
    rows = [(f"{c} Smith", f"{v} Smith") for c, vs in groups for v in vs.split()]
    assert len(groups) == 103 and len(rows) > 140
    d = spark.createDataFrame(rows, "a string, b string")
    assert fields.compared(d, v=fields.names(F.col("a"), F.col("b"))).filter("v.reason_code <> 'nickname_match'").count() == 0


def test_birth_dates_are_past(spark):
    assert ask(spark, lambda c: S.parse_date(c, True, 2026), "1/2/30") == "1930-01-02"
    assert ask(spark, lambda c: S.parse_date(c, True, 2026), "1/2/2030") == "2030-01-02"


@pytest.mark.parametrize("text, want", [("1234-5678-90", "01234567890"), ("12345-678-90", "12345067890"), ("12345-6789-0", "12345678900"), ("12345678901", "12345678901"), ("1234567890", None), ("a-b-c", None), (None, None), ("1-2-3", None)])
def test_ndc(spark, text, want):
    assert ask(spark, S.ndc11, text) == want


def test_quantities(spark):
    q = lambda *v: ask(spark, fields.quantity, *v)["reason_code"]
    assert q("90", "Tablet", "90.0", "EA", 1.0) == "exact_match"
    assert q("90", "tab", "90", "ml", 1.0) == "unit_mismatch"
    assert q("90", None, "30", None, 1.0) == "quantity_adjusted"
    assert q("90", None, "31", None, 1.0) == "quantity_mismatch"
    assert q("180", None, "31", None, 30.0) == "quantity_adjusted" and q("210", None, "30", None, 30.0) == "quantity_mismatch"  # rounded days: 6 and 1; 7 and 1
    assert q("0x10", None, "16", None, 1.0) == q("1e100", None, "1E+100", None, 1.0) == "exact_match" and q("1e400", None, "1", None, 1.0) == q("Infinity", None, "1", None, 1.0) == "unparseable_quantity"
    assert q("", None, "31", None, 1.0) == "not_provided"
    assert q("   ", None, "0", None, 1.0) == "exact_match"  # blank text is zero, not missing
    assert q("12d", None, "12", None, 1.0) == "unparseable_quantity"


def test_nullable_booleans(spark):
    s = lambda a, b: spark.sql("SELECT 1").select(fields.substitution(F.lit(a).cast("boolean"), F.lit(b).cast("boolean")).inline().alias("v")).first()["v"]["reason_code"]
    assert [s(None, True), s(False, None), s(True, None), s(True, True), s(True, False)] == ["not_provided", "substitution_allowed", "not_provided", "daw_consistent", "daw_required"]


def test_phones(spark):
    p = lambda a, b: ask(spark, fields.phone, a, b)["reason_code"]
    assert [p("(212) 555-1234", "12125551234"), p("2125551234", "3125551234"), p("2125551234", "1125551234"), p("2125551234", "2125551299"), p(None, "1")] == ["exact_match", "phone_area_code_mismatch", "phone_ocr_suspect", "phone_differs", "not_provided"]


def test_money(spark):
    assert [str(ask(spark, S.currency, v)) for v in ("$1,234.50", "(3.25)", "x", " ", None)] == ["1234.5000", "-3.2500", "None", "None", "None"]
    assert [str(ask(spark, S.package_quantity, v)) for v in ("1 Stock Package with 30.0000", "500", "2 x 10", None)] == ["30.0000", "500.0000", "None", "None"]
