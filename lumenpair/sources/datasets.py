"""Builders of the dimensions: product lists, relation files of delimited lines, and spreadsheet parts, each as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpair.functions.products import parse_product
from lumenpair.functions.scalars import blank, ndc11, trimmed
from lumenpair.operators.lookup import first_wins
from lumenpair.operators.products import catalog_index

CONCEPT = "displayName string, ingredient string, strength string, doseForm string"
DATASET = f"concepts array<struct<{CONCEPT}>>, ndcIndex map<string,bigint>, nameIndex map<string,array<bigint>>, formsByIngredient map<string,array<string>>"
PRODUCT = "product_ndc string, generic_name string, brand_name string, active_ingredients array<struct<name:string,strength:string>>, dosage_form string, packaging array<struct<package_ndc:string>>"
#: Places of the fields in the lines of the three relation files.
CONSO, REL, SAT = {"rxcui": 0, "sab": 11, "tty": 12, "str": 14}, {"rxcui1": 0, "rxcui2": 4, "rela": 7}, {"rxcui": 0, "kind": 8, "value": 10}
HEADERS = {"supplier name": "supplier", "brand/generic": "brand_generic", "description": "description", "ndc": "ndc", "shipping size": "shipping_size", "gcn": "gcn", "dea schedule": "dea_schedule"}


def dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a gzipped JSON dataset: concepts(concept_id, display, ingredient, strength, form), codes(ndc11, concept_id), index(name_key, concept_id) and
    forms(ingredient, form). A missing file raises."""
    raw = spark.read.schema(DATASET).json(path, multiLine=True)
    concepts = raw.select(F.posexplode("concepts").alias("concept_id", "c")).select(F.col("concept_id").cast("long").alias("concept_id"), F.col("c.displayName").alias("display"), "c.ingredient", "c.strength", F.col("c.doseForm").alias("form"))
    codes = raw.select(F.explode("ndcIndex").alias("ndc11", "concept_id"))
    index = raw.select(F.explode("nameIndex").alias("name_key", "ids")).select("name_key", F.explode("ids").alias("concept_id"))
    forms = raw.select(F.explode("formsByIngredient").alias("ingredient", "fs")).select("ingredient", F.explode("fs").alias("form"))
    return {"concepts": concepts, "codes": codes, "index": index, "forms": forms}


def dataset_or_empty(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """dataset(), with empty tables where the file is missing or can't be read: evidence is optional."""
    try:
        out = dataset(spark, path)
        out["concepts"].count()
        return out
    except Exception:  # whatever is wrong with the file, the comparison goes on without it
        return dataset_of(spark.createDataFrame([], DATASET))


def dataset_of(raw: DataFrame) -> dict[str, DataFrame]:
    none = raw.sparkSession.createDataFrame
    return {"concepts": none([], "concept_id long, display string, ingredient string, strength string, form string"), "codes": none([], "ndc11 string, concept_id long"), "index": none([], "name_key string, concept_id long"), "forms": none([], "ingredient string, form string")}


def product_list(raw: DataFrame) -> DataFrame:
    """One row for each entry of `results`, with its place as `ordinal`."""
    return raw.select(F.posexplode("results").alias("ordinal", "p")).select(F.col("ordinal").cast("long").alias("ordinal"), "p.*")


def plain_strength(c: Column) -> Column:
    """Without spaces, in lower case, and without a /1 at the end."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"\s+", "")), "/1$", "")


def plain_ingredient(c: Column) -> Column:
    return F.regexp_replace(F.lower(trimmed(c)), r"\s+", " ")


def concepts(products: DataFrame) -> DataFrame:
    """(concept_id, display, ingredient, strength, form) of products(ordinal, PRODUCT) that have a code, a form, and ingredients with name and strength; ingredients are joined in their
    order. concept_id is the ordinal."""
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    lacking = F.exists("active_ingredients", lambda i: none(i["name"]) | none(i["strength"]))
    whole = products.filter(~none(F.col("product_ndc")) & ~none(F.col("dosage_form")) & (F.size("active_ingredients") > 0) & ~lacking)
    parts = F.array_sort(F.transform("active_ingredients", lambda i: F.struct(plain_ingredient(i["name"]).alias("name"), plain_strength(i["strength"]).alias("strength"))))
    out = whole.withColumn("_i", parts).withColumn("ingredient", F.array_join("_i.name", ";"))
    display = F.trim(F.coalesce(F.nullif("brand_name", F.lit("")), F.nullif("generic_name", F.lit("")), F.col("ingredient")))
    return out.select(F.col("ordinal").alias("concept_id"), display.alias("display"), "ingredient", F.array_join("_i.strength", ";").alias("strength"), F.lower(trimmed(F.col("dosage_form"))).alias("form"))


def codes(products: DataFrame, built: DataFrame) -> DataFrame:
    """(ndc11, concept_id): of a code's products the first that was built. Codes that can't be read go."""
    rows = products.select("ordinal", F.col("ordinal").alias("concept_id"), F.explode("packaging.package_ndc").alias("code")).withColumn("ndc11", ndc11(F.col("code")))
    return first_wins(rows.join(built.select("concept_id"), "concept_id", "left_semi"), "ndc11", "ordinal", "concept_id")


def name_index(products: DataFrame, built: DataFrame) -> DataFrame:
    """(name_key, concept_id): folded brand and generic names, each once for a concept."""
    rows = products.select(F.col("ordinal").alias("concept_id"), F.explode(F.array("brand_name", "generic_name")).alias("name")).filter(~blank(F.col("name")))
    keys = rows.join(built.select("concept_id"), "concept_id", "left_semi").select(parse_product(F.col("name"))["text"].alias("name_key"), "concept_id")
    return keys.filter("name_key <> ''").distinct()


def product_counts(products: DataFrame, built: DataFrame) -> DataFrame:
    """One row of counts: products, those left out, concepts, codes, codes that can't be read, name keys and ingredients."""
    count = lambda d, name, *what: d.agg(F.count_distinct(*what).alias(name) if what else F.count(F.lit(1)).alias(name))
    packs = products.join(built.select(F.col("concept_id").alias("ordinal")), "ordinal", "left_semi").select(F.explode("packaging.package_ndc").alias("code"))
    parts = [count(products, "products"), count(built, "concepts"), count(codes(products, built), "codes"), packs.agg(F.count_if(ndc11(F.col("code")).isNull()).alias("unread_codes"))]
    out = one_row(*parts, count(name_index(products, built), "name_keys", "name_key"), count(built, "ingredients", "ingredient"))
    return out.withColumn("skipped", F.col("products") - F.col("concepts"))


def one_row(*parts: DataFrame) -> DataFrame:
    """Tables of one row each, side by side."""
    names = [c for p in parts for c in p.columns]
    rows = [p.select(*[F.col(c) if c in p.columns else F.lit(None).cast("long").alias(c) for c in names]) for p in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.agg(*[F.max(c).alias(c) for c in names])


def delimited(lines: DataFrame, places: dict[str, int], line: str = "value") -> DataFrame:
    """The fields at their places of lines delimited by bars, with all other columns; a line that lacks one of them goes."""
    at = F.split(F.col(line), r"\|")
    out = lines.withColumns({k: F.nullif(F.try_element_at(at, F.lit(p + 1)), F.lit("")) for k, p in places.items()}).drop(line)
    return out.na.drop(subset=list(places))


def forms_of(conso: DataFrame) -> DataFrame:
    """(form): the vocabulary of dose forms that the data itself has."""
    return conso.filter("sab = 'RXNORM' AND tty = 'DF' AND trim(str) <> ''").select(F.trim("str").alias("form")).distinct()


def split_strength(segment: Column) -> Column:
    """struct(ingredient, strength) of a segment: behind an amount at its head, up to the last run of words that begin with a digit, and from it on. Null without such a
    run, or with nothing before it."""
    s = F.regexp_replace(F.trim(F.regexp_replace(segment, r"\s+", " ")), r"^\d\S* [a-zA-Z%]+ (?=\S)", "")
    p = r"^((?:.* )?[^\d ]\S*) (\d\S*(?: \d\S*)*(?: [^\d ]\S*)*)$"
    return F.when(s.rlike(p), F.struct(F.regexp_extract(s, p, 1).alias("ingredient"), F.regexp_extract(s, p, 2).alias("strength")))


def with_form(rows: DataFrame, key: str, text: str, forms: DataFrame) -> DataFrame:
    """rows with `form`, the longest of the forms that ends the text behind a space, in any case; null where none does. Ends are exploded, so forms are joined by equality."""
    words = F.split(F.lower(F.col(text)), " ")
    ends = rows.select(key, F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(words), F.lit(2))), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))).alias("_end"))
    best = ends.join(forms.select(F.lower("form").alias("_end"), "form"), "_end").groupBy(key).agg(F.max_by("form", F.struct(F.length("form"), "form")).alias("form"))
    return rows.join(best, key, "left")


def vocabulary_concepts(conso: DataFrame) -> DataFrame:
    """(rxcui, tty, display, ingredient, strength, form) of conso(ordinal, rxcui, sab, tty, str): the first row of each clinical or branded product whose name has a known form
    and, in each of its parts, an ingredient and a strength. The first that can be read counts."""
    rows = conso.filter("sab = 'RXNORM' AND tty IN ('SCD', 'SBD')").withColumn("_bare", F.trim(F.regexp_replace("str", r"\s*\[[^\]]*\]\s*$", "")))
    formed = with_form(rows, "ordinal", "_bare", forms_of(conso)).filter("form IS NOT NULL")
    before = F.trim(F.expr("substring(_bare, 1, length(_bare) - length(form))"))
    segments = F.filter(F.transform(F.split(before, " / "), lambda s: F.trim(s)), lambda s: s != "")
    split = formed.withColumn("_p", F.transform(segments, split_strength)).filter((F.size("_p") > 0) & ~F.exists("_p", lambda p: p.isNull()))
    pairs = F.array_sort(F.transform("_p", lambda p: F.struct(plain_ingredient(p["ingredient"]).alias("i"), plain_strength(p["strength"]).alias("s"))))
    read = split.withColumn("_q", pairs).select("ordinal", "rxcui", "tty", F.col("str").alias("display"), F.array_join("_q.i", ";").alias("ingredient"), F.array_join("_q.s", ";").alias("strength"), F.lower("form").alias("form"))
    return first_wins(read, "rxcui", "ordinal", "tty", "display", "ingredient", "strength", "form")


def branded_to_clinical(rel: DataFrame, conso: DataFrame) -> DataFrame:
    """(rxcui, scd): for each branded product the first clinical one that it is the trade name of, by rel(ordinal, rxcui1, rela, rxcui2). Both must be there."""
    of = lambda tty, name: conso.filter((F.col("sab") == "RXNORM") & (F.col("tty") == tty)).select(F.col("rxcui").alias(name)).distinct()
    edges = rel.filter("rela = 'has_tradename'").join(of("SBD", "rxcui1"), "rxcui1", "left_semi").join(of("SCD", "rxcui2"), "rxcui2", "left_semi")
    return first_wins(edges, "rxcui1", "ordinal", "rxcui2").select(F.col("rxcui1").alias("rxcui"), F.col("rxcui2").alias("scd"))


def vocabulary_codes(sat: DataFrame, built: DataFrame) -> DataFrame:
    """(ndc11, rxcui): of sat(ordinal, rxcui, kind, value) the first code rows of concepts that were built."""
    rows = sat.filter("kind = 'NDC'").join(built.select("rxcui"), "rxcui", "left_semi").withColumn("ndc11", ndc11(F.col("value")))
    return first_wins(rows, "ndc11", "ordinal", "rxcui")


def entities(c: Column) -> Column:
    """The five entities of XML as characters."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def shared_strings(xml: Column) -> Column:
    """array of the strings of a shared-strings part, the runs of each joined."""
    items = F.regexp_extract_all(xml, F.lit("(?s)<si>(.*?)</si>"), F.lit(1))
    return F.transform(items, lambda i: entities(F.array_join(F.regexp_extract_all(i, F.lit("(?s)<t[^>]*>(.*?)</t>"), F.lit(1)), "")))


def sheet_cells(sheets: DataFrame, key: str, xml: str, shared: DataFrame) -> DataFrame:
    """(key, row, column, value) of the cells of a sheet part; a cell that refers to shared(key, place, value) has that string. Blank and self-closing cells, and references to
    nothing, have no row."""
    rows = sheets.select(key, F.posexplode(F.regexp_extract_all(F.col(xml), F.lit("(?s)<row[^>]*>(.*?)</row>"), F.lit(1))).alias("row", "_r"))
    cells = rows.select(key, "row", F.explode(F.regexp_extract_all("_r", F.lit(r'(?s)<c r="[A-Z]+\d+"[^>]*?(?:/>|>.*?</c>)'), F.lit(0))).alias("_c"))
    value = F.when(F.col("_c").rlike("(?s)<v[^>/]*>.*?</v>"), F.regexp_extract("_c", "(?s)<v[^>/]*>(.*?)</v>", 1))
    raw = cells.select(key, "row", F.regexp_extract("_c", 'r="([A-Z]+)', 1).alias("column"), F.col("_c").rlike(r'^<c [^>]*\st="s"').alias("_s"), value.alias("_v")).filter("_v IS NOT NULL")
    place = F.when(F.col("_s"), F.col("_v").try_cast("int"))
    found = raw.withColumn("place", place).join(shared.select(key, "place", F.col("value").alias("_t")), [key, "place"], "left")
    return found.select(key, "row", "column", F.when(F.col("_s"), F.col("_t")).otherwise(entities(F.col("_v"))).alias("value")).filter("value IS NOT NULL")


def mapped_rows(cells: DataFrame, key: str, headers: dict[str, str] = HEADERS) -> DataFrame:
    """(key, row, one column for each header): the rows behind the first, whose cells name the columns in any case; unknown ones are left out. A row without a known cell goes."""
    names = F.create_map(*[F.lit(x) for kv in headers.items() for x in kv])
    head = cells.filter("row = 0").select(key, "column", F.try_element_at(names, F.lower(trimmed(F.col("value")))).alias("_field")).filter("_field IS NOT NULL")
    body = cells.filter("row > 0").join(head, [key, "column"])
    # as in a dictionary, of two columns of one name the later counts
    at = F.struct(F.length("column"), F.col("column"))
    return body.groupBy(key, "row").agg(*[F.max_by(F.when(F.col("_field") == f, F.col("value")), F.when(F.col("_field") == f, at)).alias(f) for f in headers.values()])


def entries(rows: DataFrame, ordinal: str) -> DataFrame:
    """(ndc11, gcn, description, brand_generic, dea_schedule): the first row of each code that can be read."""
    text = lambda c: F.nullif(trimmed(F.col(c)), F.lit(""))
    kind = F.lower(trimmed(F.col("brand_generic")))
    read = rows.select(F.col(ordinal), ndc11(F.col("ndc")).alias("ndc11"), text("gcn").alias("gcn"), F.coalesce(trimmed(F.col("description")), F.lit("")).alias("description"), F.when(kind.isin("brand", "generic"), kind).alias("brand_generic"), text("dea_schedule").alias("dea_schedule"))
    return first_wins(read, "ndc11", ordinal, "gcn", "description", "brand_generic", "dea_schedule")


def entry_counts(rows: DataFrame, ordinal: str) -> DataFrame:
    """One row of counts: rows, those without a code, with one that can't be read, or with one that came before; codes, groups, codes without a group, and name keys."""
    code = ndc11(F.col("ndc"))
    none = blank(F.col("ndc"))
    first = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(none).alias("missing"), F.count_if(~none & code.isNull()).alias("unread"))
    built = entries(rows, ordinal)
    kept = built.agg(F.count(F.lit(1)).alias("codes"), F.count_distinct("gcn").alias("groups"), F.count_if(F.col("gcn").isNull()).alias("without_group"))
    keys = catalog_index(built).agg(F.count_distinct("name_key").alias("name_keys"))
    return one_row(first, kept, keys).withColumn("repeated", F.col("total") - F.col("missing") - F.col("unread") - F.col("codes"))


