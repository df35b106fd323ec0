"""Comparison of products by name and code: concepts of a dimension, evidence of others, and the ladder over them.

A concept is struct(id, ingredient, strength, form, name). Dimensions are tables: by_ndc(ndc11, concept), by_name(name, concept)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenpair.functions import products as P
from lumenpair.functions import scalars as S
from lumenpair.functions import vocabulary as V
from lumenpair.functions.scalars import ladder

TRIPLE = ("ingredient", "strength", "form")


def strength_of(name: Column) -> Column:
    return F.coalesce(P.stated_concentration(name), P.stated_strength(name))


def by_code(concepts: DataFrame, codes: DataFrame) -> DataFrame:
    """by_ndc of concepts(concept_id, display, ingredient, strength, form) and codes(ndc11, concept_id)."""
    return codes.join(concepts, "concept_id").select("ndc11", concept().alias("concept"))


def concept() -> Column:
    key = F.concat(F.lit("GX:"), F.concat_ws("|", *TRIPLE))
    return F.struct(key.alias("id"), *TRIPLE, F.concat_ws(" ", "display", "strength", "form").alias("name"))


def prefixes(tokens: Column, most: int) -> Column:
    """struct(n, key) of the leading 1..most tokens of a non-empty array."""
    return F.transform(F.sequence(F.lit(1), F.least(F.size(tokens), F.lit(most))), lambda i: F.struct(i.alias("n"), F.array_join(F.slice(tokens, 1, i), " ").alias("key")))


def candidates(names: DataFrame, index: DataFrame, value: str, most: int, keys: DataFrame | None = None) -> DataFrame:
    """(name, letter, strength, qualifier, value): every value under the longest key of index(name_key, value) that the folded name begins with, as it is (letter '') and
    with a letter more at the end of a first token of 8 characters or more. names(name, text, tokens, strength, qualifier) are distinct. `keys` are those of index
    where it lacks some."""
    some = names.filter(F.size("tokens") > 0)
    own = some.select("name", "strength", "qualifier", F.explode(prefixes(F.col("tokens"), most)).alias("p")).select("name", "strength", "qualifier", "p.n", F.col("p.key").alias("key"))
    keys = (index if keys is None else keys).select("name_key").distinct()
    first = F.substring_index("name_key", " ", 1)
    short = F.expr("substring(substring_index(name_key, ' ', 1), 1, length(substring_index(name_key, ' ', 1)) - 1)")
    longer = keys.filter(first.rlike("[a-z]$") & (F.length(first) >= 9)).select(
        "name_key", F.right(first, F.lit(1)).alias("letter"), F.concat(short, F.expr("substring(name_key, length(substring_index(name_key, ' ', 1)) + 1)")).alias("key")
    )
    whole = keys.select("name_key", F.lit("").alias("letter"), F.col("name_key").alias("key"))
    hit = own.join(whole.unionByName(longer), "key")
    best = hit.groupBy("name", "letter", "strength", "qualifier").agg(F.max_by("name_key", "n").alias("name_key"))
    return best.join(index, "name_key").select("name", "letter", "strength", "qualifier", value)


def narrowed(found: DataFrame, distinct: list[Column], result: Column) -> DataFrame:
    """(name, result) of found(name, letter, strength, qualifier, own_strength, own_qualifier, ...): candidates that confirm a stated strength and qualifier, where all of a
    letter are one by `distinct`; what is found as it stands goes before what a letter more finds, and the letters must agree."""
    fits = (F.col("strength").isNull() | (F.col("own_strength") == F.col("strength"))) & (F.col("qualifier").isNull() | (F.col("own_qualifier") == F.col("qualifier")))
    left = found.filter(fits).withColumn("_k", F.to_json(F.struct(*distinct))).withColumn("_r", result)
    one = left.groupBy("name", "letter").agg(F.min("_k").alias("_k"), F.max("_k").alias("_m"), F.max("_r").alias("_r")).filter("_k = _m")
    whole = one.filter("letter = ''").select("name", F.col("_r").alias("found"))
    lettered = one.filter("letter <> ''").groupBy("name").agg(F.min("_k").alias("_k"), F.max("_k").alias("_m"), F.max("_r").alias("lettered")).filter("_k = _m").select("name", "lettered")
    return whole.join(lettered, "name", "full").select("name", F.coalesce("found", "lettered").alias("result"))


def read_names(names: DataFrame, folded: Column | None = None) -> DataFrame:
    """(name, tokens, strength, qualifier) of each distinct name."""
    distinct = names.select("name").filter("name IS NOT NULL AND name <> ''").distinct()
    read = distinct.select("name", P.parse_product(F.col("name")).alias("_p"), (P.parse_product(folded) if folded is not None else P.parse_product(F.col("name"))).alias("_f"))
    return read.select("name", F.filter(F.split("_f.text", " "), lambda t: t != "").alias("tokens"), strength_of(F.col("name")).alias("strength"), F.col("_p.qualifier").alias("qualifier"))


def by_names(names: DataFrame, concepts: DataFrame, index: DataFrame, most: int = 4) -> DataFrame:
    """by_name of distinct names(name), by concepts(concept_id, display, ingredient, strength, form) and index(name_key, concept_id). What is ambiguous is missing. A key's concepts that are
    alike go as one, so a name meets as many rows as its key has kinds of concepts, however many concepts there are."""
    own = concepts.select("concept_id", "display", *[F.col(k).alias(f"_{k}") for k in TRIPLE], P.parse_product(F.col("display"))["qualifier"].alias("own_qualifier"))
    key = F.concat(F.lit("GX:"), F.concat_ws("|", *[f"_{k}" for k in TRIPLE]))
    result = F.struct(key.alias("id"), *[F.col(f"_{k}").alias(k) for k in TRIPLE], F.concat_ws(" ", "display", "_strength", "_form").alias("name"))
    kinds = index.join(own, "concept_id").groupBy("name_key", "own_qualifier", *[f"_{k}" for k in TRIPLE]).agg(F.max(result).alias("best"))
    values = kinds.select("name_key", F.struct("own_qualifier", *[f"_{k}" for k in TRIPLE], "best").alias("_v"))
    found = candidates(read_names(names), values, "_v", most, index).select("name", "letter", "strength", "qualifier", "_v.*").withColumn("own_strength", F.col("_strength"))
    return narrowed(found, [F.col(f"_{k}") for k in TRIPLE], F.col("best")).withColumnRenamed("result", "concept")


def catalog_text(c: Column) -> Column:
    return F.regexp_replace(c, "[@#]", " ")


def groups_by_names(names: DataFrame, entries: DataFrame, most: int = 10) -> DataFrame:
    """(name, gcn) of distinct names(name) by entries(ndc11, gcn, description): the one group of those whose description begins like the name. A group that isn't given
    doesn't count."""
    index = catalog_index(entries, most)
    own = entries.select("ndc11", F.nullif("gcn", F.lit("")).alias("gcn"), strength_of(F.col("description")).alias("own_strength"), P.parse_product(F.col("description"))["qualifier"].alias("own_qualifier"))
    found = candidates(read_names(names, catalog_text(F.col("name"))), index, "ndc11", most).filter("letter = ''").join(own, "ndc11")
    return narrowed(found.filter("gcn IS NOT NULL"), [F.col("gcn")], F.col("gcn")).withColumnRenamed("result", "gcn")


def catalog_index(entries: DataFrame, most: int = 10) -> DataFrame:
    """(name_key, ndc11): every leading 1..most tokens of the folded descriptions."""
    text = P.parse_product(catalog_text(F.trim("description")))["text"]
    tokens = entries.filter("trim(description) <> ''").select("ndc11", F.filter(F.split(text, " "), lambda t: t != "").alias("tokens")).filter(F.size("tokens") > 0)
    return tokens.select("ndc11", F.explode(prefixes(F.col("tokens"), most)["key"]).alias("name_key")).distinct()


def form_words(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.replace(F.lower(c), F.lit(","), F.lit(" ")), r"\s+"), lambda t: (t != "") & ~t.isin(*V.FORM_ROUTES))))


def same_concept(a: Column, b: Column) -> Column:
    """Whether two vocabularies' concepts agree: ingredient and strength alike, and the words of the forms but for the route."""
    full = lambda c: F.least(*[F.length(c[k]) for k in TRIPLE]) > 0
    forms = (F.size(form_words(a["form"])) > 0) & (form_words(a["form"]) == form_words(b["form"]))
    return F.coalesce(full(a) & full(b) & (a["ingredient"] == b["ingredient"]) & (a["strength"] == b["strength"]) & forms, F.lit(False))


def elided(x: Column, y: Column) -> Column:
    """One is the other without its last letter."""
    longer, shorter = F.when(F.length(x) > F.length(y), x).otherwise(y), F.when(F.length(x) > F.length(y), y).otherwise(x)
    return (F.length(longer) - F.length(shorter) == 1) & (F.length(shorter) >= 8) & (F.left(longer, F.length(shorter)) == shorter)


def parts_agree(a: Column, b: Column, strength_a: Column, strength_b: Column) -> Column:
    x, y = F.array_except(a["ingredients"], b["ingredients"]), F.array_except(b["ingredients"], a["ingredients"])
    same = (F.size(x) == 0) & (F.size(y) == 0) | (F.size(x) == 1) & (F.size(y) == 1) & elided(F.try_element_at(x, F.lit(1)), F.try_element_at(y, F.lit(1)))
    either = lambda k: (F.size(a[k]) == 0) | (F.size(b[k]) == 0) | (a[k] == b[k])
    all_ = (F.size(a["ingredients"]) > 0) & (F.size(b["ingredients"]) > 0) & same & (a["ratios"] == b["ratios"]) & (strength_a == strength_b) & (a["form"] == b["form"])
    return F.coalesce(all_ & either("salts") & either("routes") & a["release"].eqNullSafe(b["release"]), F.lit(False))


SIDES = ("src", "ent")


def looked_up(rows: DataFrame, src: Column, ent: Column, by_ndc: DataFrame, by_name: DataFrame) -> DataFrame:
    """rows with __src and __ent: struct(name, ndc, ndc11, product, code_concept, name_concept) of src and ent, struct(name, ndc) each. Left joins: no row is dropped."""
    out = rows
    for side, c in zip(SIDES, (src, ent)):
        out = out.withColumn(f"__{side}_name", F.nullif(c["name"], F.lit(""))).withColumn(f"__{side}_ndc", F.nullif(c["ndc"], F.lit("")))
        out = out.withColumn(f"__{side}_ndc11", S.ndc11(F.col(f"__{side}_ndc")))
    for side in SIDES:
        out = out.join(by_ndc.select(F.col("ndc11").alias(f"__{side}_ndc11"), F.col("concept").alias(f"__{side}_code")), f"__{side}_ndc11", "left")
        out = out.join(by_name.select(F.col("name").alias(f"__{side}_name"), F.col("concept").alias(f"__{side}_named")), f"__{side}_name", "left")
    return out


def verdict(rows: DataFrame, name: str = "drug") -> DataFrame:
    """looked_up() rows with the verdict in a column, by codes, names and concepts."""
    c = lambda side, k: F.col(f"__{side}_{k}")
    out = rows
    for s in SIDES:
        text = c(s, "name")
        out = out.withColumns({f"__{s}_p": F.when(text.isNotNull(), P.parse_product(text)), f"__{s}_conc": P.stated_concentration(text), f"__{s}_hint": F.coalesce(P.hints_concentration(text), F.lit(False)), f"__{s}_stated": P.stated_strength(text)})
        out = out.withColumns({f"__{s}_hours": P.stated_hours(text), f"__{s}_concept": F.coalesce(c(s, "code"), c(s, "named"))})
    has = lambda x: x.isNotNull()
    sure = lambda x: F.coalesce(x, F.lit(False))
    ps, pe = c("src", "p"), c("ent", "p")
    both_conc = has(c("src", "conc")) & has(c("ent", "conc"))
    plain = ~both_conc & ~c("src", "hint") & ~c("ent", "hint")
    hours = sure(c("src", "hours") != c("ent", "hours"))
    texts = sure((ps["text"] != "") & (pe["text"] != "")) & ~hours
    routes = ~sure(ps["route"] != pe["route"]) & (has(ps["route"]) | has(pe["route"]))
    a, b = c("src", "concept"), c("ent", "concept")
    missing = a.isNull() | b.isNull()
    named = lambda s: c(s, "code").isNull()
    by_name = named("src") | named("ent")
    alone = lambda s, o: has(c(s, "p")["qualifier"]) & named(o) & c(o, "p")["qualifier"].isNull()
    conflict = sure(ps["qualifier"] != pe["qualifier"]) | sure(alone("src", "ent")) | sure(alone("ent", "src"))
    verified = lambda s: has(c(s, "code")) | (plain & has(c(s, "stated"))) | has(c(s, "conc"))
    unverified = ~verified("src") | ~verified("ent")
    same_pack = sure(F.left(c("src", "ndc11"), F.lit(9)) == F.left(c("ent", "ndc11"), F.lit(9)))
    triple = (a["ingredient"] == b["ingredient"]) & (a["strength"] == b["strength"]) & (a["form"] == b["form"])
    strength = lambda s: F.coalesce(c(s, "conc"), c(s, "stated"))
    none = lambda s: c(s, "name").isNull() & c(s, "ndc").isNull()
    same = a["id"] == b["id"]
    rungs = ladder(
        (none("src") | none("ent"), "yellow", "not_provided"),
        (texts & (ps["text"] == pe["text"]), "green", "name_identity_match"),
        (texts & routes & (ps["routeless"] == pe["routeless"]), "green", "name_identity_match"),
        (c("src", "ndc11") == c("ent", "ndc11"), "green", "exact_match"),
        (both_conc & (c("src", "conc") != c("ent", "conc")), "red", "drug_mismatch"),
        (plain & sure(c("src", "stated") != c("ent", "stated")), "red", "drug_mismatch"),
        (missing & ~hours & parts_agree(ps, pe, strength("src"), strength("ent")), "green", "name_component_match"),
        (missing, "yellow", "unknown_drug"),
        (same & same_pack, "yellow", "pack_size"),
        ((same | triple) & unverified, "yellow", "strength_unverified"),
        (same & by_name & conflict, "yellow", "unknown_drug"),
        (same & by_name, "green", "concept_match"),
        (same | triple, "yellow", "generic_substitution"),
        (by_name, "yellow", "unknown_drug"),
        (True, "red", "drug_mismatch"),
    )
    return out.withColumn(name, rungs)


def upgraded(rows: DataFrame, name: str, other_by_ndc: DataFrame | None = None, groups_by_ndc: DataFrame | None = None, groups_by_name: DataFrame | None = None) -> DataFrame:
    """verdict() rows, where other evidence may settle a yellow verdict: a second vocabulary's concept of the written code, other_by_ndc(ndc11, other), against the entered name's
    concept; then the groups of a catalog, groups_by_ndc(ndc11, gcn) and groups_by_name(name, gcn). Only yellow rows are looked up."""
    yellow = (F.col(name)["status"] == "yellow") & (F.col(name)["reason_code"] != "not_provided")
    out = rows.withColumn("__key", F.when(yellow, F.col("__src_ndc11"))).withColumn("__key_name", F.when(yellow & F.col("__src_ndc11").isNotNull(), F.col("__ent_name")))
    agree = F.lit(False)
    written = entered = F.lit(None).cast("string")
    if other_by_ndc is not None:
        out = out.join(other_by_ndc.select(F.col("ndc11").alias("__key"), "other"), "__key", "left")
        agree = same_concept(F.col("other"), F.col("__ent_named"))
    if groups_by_ndc is not None and groups_by_name is not None:
        out = out.join(groups_by_ndc.select(F.col("ndc11").alias("__key"), F.nullif("gcn", F.lit("")).alias("__written")), "__key", "left")
        out = out.join(groups_by_name.select(F.col("name").alias("__key_name"), F.col("gcn").alias("__entered")), "__key_name", "left")
        written, entered = F.col("__written"), F.col("__entered")
    say = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason_code"))
    better = F.when(agree, say("green", "rxnorm_scd_match")).when(written == entered, say("green", "catalog_gcn_match")).when(written != entered, say("yellow", "catalog_gcn_mismatch"))
    return out.withColumn(name, F.when(yellow, F.coalesce(better, F.col(name))).otherwise(F.col(name)))


def compared(rows: DataFrame, src: Column, ent: Column, by_ndc: DataFrame, by_name: DataFrame, name: str = "drug", **evidence: DataFrame) -> DataFrame:
    """rows with the verdict on struct(name, ndc) src and ent in the column `name`."""
    out = verdict(looked_up(rows, src, ent, by_ndc, by_name), name)
    if evidence:
        out = upgraded(out, name, **evidence)
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], name)
