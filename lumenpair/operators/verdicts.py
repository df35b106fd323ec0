"""Verdicts of a pair's fields in their fixed order, what they show, and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenpair.functions.directions import parse_directions
from lumenpair.operators import fields, products
from lumenpair.operators.fields import Comparison

#: Fields in the order in which they are reported, each with the category of its roll-up.
FIELDS = {
    "patientName": "Patient", "patientDOB": "Patient", "patientAddress": "Patient", "prescriberName": "Prescriber", "prescriberNpi": "Prescriber", "prescriberPhone": "Prescriber", "prescriberAddress": "Prescriber",
    "dateWritten": "Rx", "availableDate": "Rx", "quantity": "Rx", "refills": "Rx", "daw": "Rx", "drug": "Rx", "sig": "Rx",
}
#: What a roll-up by category leaves out: people move.
ADDRESSES = ("patientAddress", "prescriberAddress")
RANK = {"green": 0, "yellow": 1, "red": 2}
ADDRESS = "struct<street:string,unit:string,city:string,state:string,zip:string>"
RECORD = (
    f"struct<patientName:string,patientDOB:string,patientAddress:{ADDRESS},prescriber:struct<name:string,npi:string,phone:string,address:{ADDRESS}>,dateWritten:string,availableDate:string,"
    "drug:struct<name:string,ndc:string>,sig:string,quantity:string,quantityUnit:string,refills:string,refillsFromTotalFills:boolean,substitutionsNotAllowed:boolean,daw:boolean>"
)
#: Why a verdict is what it is, in words; {s} and {e} are the two values.
REASONS = {
    "exact_match": "Both sides say the same once written alike.", "not_provided": "One side doesn't say: source {s}, entered {e}.", "suffix_mismatch": "The generational suffixes of {s} and {e} differ, so these may be two people.",
    "suffix_dropped": "Only one of {s} and {e} has a generational suffix.", "surname_mismatch": "The surnames of {s} and {e} have nothing in common.", "first_name_mismatch": "The surnames agree, the given names of {s} and {e} don't.",
    "middle_name_present": "{s} and {e} agree but for a middle name on one side.", "surname_partial": "The surnames of {s} and {e} share a part only.", "given_name_partial": "The given names of {s} and {e} share a part only.",
    "nickname_match": "The given names of {s} and {e} are forms of one name.", "unparseable_date": "{s} or {e} can't be read as a date.", "date_mismatch": "The dates {s} and {e} differ.", "available_date_match": "The entered date is the one from which it is available.",
    "address_differs": "Street, city, state or zip differ: {s}, {e}. People move; look at the date of birth.", "unit_differs": "The addresses agree but for the unit: {s}, {e}.", "exact_match_partial_source": "All that the source says of the address agrees: {s}.",
    "verbatim_match": "The directions are the same words.", "sig_ambiguous": "The directions {s} and {e} can't be compared in full.", "sig_mismatch": "The directions {s} and {e} contradict each other.",
    "unparseable_quantity": "{s} or {e} isn't a number.", "unit_mismatch": "The units of {s} and {e} can't be reconciled.", "quantity_adjusted": "{s} and {e} are whole days of the same directions.", "quantity_mismatch": "The quantities {s} and {e} differ.",
    "refills_mismatch": "The refills {s} and {e} differ.", "npi_mismatch": "The identifiers {s} and {e} differ.", "phone_ocr_suspect": "The local numbers of {s} and {e} agree, an area code looks misread.", "phone_area_code_mismatch": "The local numbers of {s} and {e} agree, the area codes don't.",
    "phone_differs": "The numbers {s} and {e} differ; a clinic may have several.", "substitution_allowed": "The source allows substitution.", "daw_consistent": "The source forbids substitution, and so does the entry.", "daw_required": "The source forbids substitution, the entry doesn't.",
    "name_identity_match": "The product names {s} and {e} are the same once written alike.", "drug_mismatch": "{s} and {e} are different products.", "name_component_match": "{s} and {e} agree in ingredients, strength and form.",
    "unknown_drug": "{s} or {e} isn't a known product.", "pack_size": "The same product in another package.", "strength_unverified": "The same product, but one of {s} and {e} states no strength.", "concept_match": "{s} and {e} are one concept.",
    "generic_substitution": "Another maker's product of the same ingredient, strength and form.", "rxnorm_scd_match": "A second vocabulary has the written product as what was entered.", "catalog_gcn_match": "The catalog has both products in one group.",
    "catalog_gcn_mismatch": "The catalog has the two products in different groups.", "pending_lookup": "The product is still being looked up.",
}


def text_of(value: Column) -> Column:
    """A scalar as it is shown: nothing for null and for empty text."""
    return F.nullif(value.cast("string"), F.lit(""))


def address_text(a: Column) -> Column:
    """street Unit unit, city, state zip; what is blank is skipped."""
    some = lambda *c: F.filter(F.array(*c), lambda x: F.coalesce(x, F.lit("")) != "")
    street, state = F.array_join(some(a["street"], a["unit"]), " Unit "), F.array_join(some(a["state"], a["zip"]), " ")
    return F.nullif(F.array_join(some(street, F.array_join(some(a["city"], state), ", ")), ", "), F.lit(""))


def drug_text(d: Column) -> Column:
    return F.nullif(d["name"], F.lit(""))


def substitution_text(v: Column) -> Column:
    return F.when(v, "Substitution NOT allowed (DAW)").when(~v, "Substitution allowed")


def daw_text(v: Column) -> Column:
    return F.when(v, "DAW checked").when(~v, "DAW not checked")


def explanation(reason: Column, source: Column, entered: Column) -> Column:
    """The reason in words, with both values in it."""
    table = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("nothing"))
    return F.replace(F.replace(F.try_element_at(table, reason), F.lit("{s}"), quoted(source)), F.lit("{e}"), quoted(entered))


def assemble(pairs: DataFrame, verdicts: dict[str, Column], available: Column | None = None, shown: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """pairs with `verdicts`, an array of struct(field, status, reason_code) in the order of FIELDS, with explanation, source_value and entered_value too where `shown` has
    what each field shows. The optional row of availableDate is there only where the column `available` isn't empty."""

    def row(f: str) -> Column:
        parts = [F.lit(f).alias("field"), verdicts[f]["status"].alias("status"), verdicts[f]["reason_code"].alias("reason_code")]
        return F.struct(*parts, *([shown[f][0].alias("source_value"), shown[f][1].alias("entered_value")] if shown else []))

    out = F.array(*[row(f) for f in FIELDS if f in verdicts])
    if shown:  # the words are put in by one lambda, not once for each field
        out = F.transform(out, lambda v: F.struct(v["field"].alias("field"), v["status"].alias("status"), v["reason_code"].alias("reason_code"), explanation(v["reason_code"], v["source_value"], v["entered_value"]).alias("explanation"), v["source_value"].alias("source_value"), v["entered_value"].alias("entered_value")))
    if available is not None:
        out = F.filter(out, lambda v: (v["field"] != "availableDate") | (F.coalesce(available, F.lit("")) != ""))
    return pairs.withColumn("verdicts", out)


def comparisons(s: Column, e: Column, this_year: int = 2026) -> dict[str, Comparison]:
    """The comparisons of two RECORDs that need no dimension. Units a day come from the column __read, the entered directions as they were read."""
    p, q = s["prescriber"], e["prescriber"]
    return {
        "patientName": fields.names(s["patientName"], e["patientName"]),
        "patientDOB": fields.dates(s["patientDOB"], e["patientDOB"], True, this_year),
        "patientAddress": fields.address(s["patientAddress"], e["patientAddress"]),
        "prescriberName": fields.names(p["name"], q["name"]),
        "prescriberNpi": fields.npi(p["npi"], q["npi"]),
        "prescriberPhone": fields.phone(p["phone"], q["phone"]),
        "prescriberAddress": fields.address(p["address"], q["address"]),
        "dateWritten": fields.written_or_available(s["dateWritten"], s["availableDate"], e["dateWritten"]),
        "quantity": fields.quantity(s["quantity"], s["quantityUnit"], e["quantity"], e["quantityUnit"], fields.per_day(F.col("__read"))),
        "refills": fields.refills(s["refills"], e["refills"], s["refillsFromTotalFills"]),
        "daw": fields.substitution(s["substitutionsNotAllowed"], e["daw"]),
        "sig": fields.directions(s["sig"], e["sig"]),
    }


def shown_values(s: Column, e: Column) -> dict[str, tuple[Column, Column]]:
    both = lambda get: (get(s), get(e))
    out = {k: both(lambda r, k=k: text_of(r[k])) for k in ("patientName", "patientDOB", "dateWritten", "quantity", "refills", "sig")}
    out |= {f"prescriber{k.title()}": both(lambda r, k=k: text_of(r["prescriber"][k])) for k in ("name", "npi", "phone")}
    out |= {"patientAddress": both(lambda r: address_text(r["patientAddress"])), "prescriberAddress": both(lambda r: address_text(r["prescriber"]["address"])), "drug": both(lambda r: drug_text(r["drug"]))}
    return out | {"availableDate": (text_of(s["availableDate"]), text_of(e["dateWritten"])), "daw": (substitution_text(s["substitutionsNotAllowed"]), daw_text(e["daw"]))}


def verify(pairs: DataFrame, by_ndc: DataFrame, by_name: DataFrame, skip: Column | None = None, this_year: int = 2026, **evidence: DataFrame) -> DataFrame:
    """pairs(source, entered, ...), two RECORDs each, with `verdicts` in the order of FIELDS and `summary`. by_ndc and by_name are products' dimensions, evidence is
    what products.upgraded() takes. Where `skip` holds the product isn't looked up: those rows are parted from the others, so they take no part in the joins."""
    s, e = F.col("source"), F.col("entered")
    drug = lambda rows: products.compared(rows, s["drug"], e["drug"], by_ndc, by_name, **evidence)
    if skip is None:
        rows = drug(pairs)
    else:
        put_off = F.coalesce(skip, F.lit(False))
        rows = drug(pairs.filter(~put_off)).unionByName(pairs.filter(put_off).withColumn("drug", deferred(F.lit(None), F.lit(True))))
    rows = fields.compared(rows.withColumn("__read", parse_directions(e["sig"])), **{f"__{k}": c for k, c in comparisons(s, e, this_year).items()})
    v = {k: F.col(f"__{k}") for k in FIELDS if k not in ("drug", "availableDate")} | {"drug": F.col("drug"), "availableDate": F.col("__dateWritten")}
    out = assemble(rows, v, s["availableDate"], shown_values(s, e)).select(*[F.col(f"`{c}`") for c in pairs.columns], "verdicts")
    return out.withColumn("summary", F.struct(*summary(F.col("verdicts"))))


def in_order(verdicts: Column) -> Column:
    """Whether the fields of the verdicts are in their order, each once."""
    place = F.transform(verdicts, lambda v: F.array_position(F.array(*map(F.lit, FIELDS)), v["field"]))
    return (F.array_position(place, F.lit(0).cast("long")) == 0) & (place == F.array_sort(F.array_distinct(place)))


def complete(verdicts: Column, available: Column) -> Column:
    """Whether all fields are there; availableDate only where the source has it."""
    return F.size(verdicts) == len(FIELDS) - F.when(F.coalesce(available, F.lit("")) == "", 1).otherwise(0)


def summary(verdicts: Column) -> list[Column]:
    """Counts of each status, and of all."""
    having = lambda s: F.filter(verdicts, lambda v: v["status"] == s)
    return [F.size(having(s)).cast("long").alias(s) for s in RANK] + [F.size(verdicts).cast("long").alias("total")]


def worst(status: Column) -> Column:
    """Aggregate: the gravest status; of no rows, green."""
    top = F.max(F.when(status == "red", 2).when(status == "yellow", 1).otherwise(0))
    return F.when(top == 2, "red").when(top == 1, "yellow").otherwise("green")


def categories(verdicts: Column, excluded: tuple[str, ...] = ADDRESSES) -> Column:
    """array of struct(category, status) of the categories that a pair's verdicts have, each with its gravest status. Within the row: no shuffle."""

    def one(name: str) -> Column:
        own = F.filter(verdicts, lambda v: v["field"].isin(*[f for f, k in FIELDS.items() if k == name and f not in excluded]))
        has = lambda s: F.exists(own, lambda v: v["status"] == s)
        return F.when(F.size(own) > 0, F.struct(F.lit(name).alias("category"), F.when(has("red"), "red").when(has("yellow"), "yellow").otherwise("green").alias("status")))

    return F.array_compact(F.array(*[one(k) for k in dict.fromkeys(FIELDS.values())]))


def by_category(long: DataFrame, key: str, excluded: tuple[str, ...] = ADDRESSES) -> DataFrame:
    """(key, category, status): the gravest status of each category of a pair. One shuffle on (key, category), combined before it."""
    table = F.create_map(*[F.lit(x) for kv in FIELDS.items() for x in kv])
    rows = long.filter(~F.col("field").isin(*excluded)) if excluded else long
    return rows.groupBy(key, F.try_element_at(table, F.col("field")).alias("category")).agg(worst(F.col("status")).alias("status"))


def deferred(verdict: Column, skip: Column) -> Column:
    """The verdict, or a placeholder where the lookup it needs is put off."""
    return F.when(skip, F.struct(F.lit("yellow").alias("status"), F.lit("pending_lookup").alias("reason_code"))).otherwise(verdict)


def patched(first: DataFrame, late: DataFrame, key: str, generation: str) -> DataFrame:
    """(key, field, status, reason_code): the first pass's rows, of which the placeholder is replaced by the late row of the same pair, where that is of the pair's latest
    generation; a stale one is dropped. first(key, generation, field, status, reason_code) has one generation for each key."""
    fresh = late.select(F.col(key), F.col(generation), F.col("field"), F.col("status").alias("_s"), F.col("reason_code").alias("_r"))
    out = first.join(fresh, [key, generation, "field"], "left")
    waits = (F.col("reason_code") == "pending_lookup") & F.col("_s").isNotNull()
    return out.select(key, "field", F.when(waits, F.col("_s")).otherwise(F.col("status")).alias("status"), F.when(waits, F.col("_r")).otherwise(F.col("reason_code")).alias("reason_code"))
