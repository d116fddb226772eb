"""Enrichment joins and the rules by which fields of two records become one.

External metadata is a table of works (``works.mapped``). It is joined by normalised DOI, and
what finds none is joined by title; the side of the works is broadcast by Spark only while its
measured size allows it. A field counts as present if it is neither null nor empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize, predicates, rx
from ..sources import layouts
from ..sources.shared import written
from . import search

PRIORITY = [
    "doi",
    "link",
    "isbn_issn",
    "lugar_publicacion_entrega",
    "publicista_editorial",
    "volumen_edicion",
    "numero_articulo_capitulo_informe",
    "paginas",
    "tipo_documento",
    "peer_reviewed",
    "acceso_abierto",
]
PDF_PRIORITY = [
    "lugar_publicacion_entrega",
    "publicista_editorial",
    "volumen_edicion",
    "isbn_issn",
    "link",
    "peer_reviewed",
    "acceso_abierto",
    "resumen_abstract",
    "keywords",
]
ALWAYS_SET = ["idioma", "tipo_documento", "peer_reviewed", "acceso_abierto"]
CRITICAL = ["lugar_publicacion_entrega", "volumen_edicion", "paginas", "keywords", "tipo_documento"]
TITLE_KEY = 200


def present(c: Column) -> Column:
    return F.coalesce(c.cast("string") != "", F.lit(False))


def prefer(a: Column, b: Column) -> Column:
    """``a`` where present, else ``b``."""
    return F.when(present(a), a).otherwise(b)


def doi_key(c: Column) -> Column:
    return F.lower(rx.strip(c))


def title_key(c: Column) -> Column:
    """Letters and digits of the first 200 characters."""
    return rx.empty_to_null(F.lower(rx.sub(F.substring(c, 1, TITLE_KEY), r"[^\p{L}\p{N}]+", "")))


def title_rule(parsed: Column, external: Column) -> Column:
    """External if the parsed title is missing, short, full of commas, or shorter."""
    commas = F.length(parsed) - F.length(F.replace(parsed, F.lit(","), F.lit("")))
    poor = ~present(parsed) | (F.length(parsed) < 20) | (commas > 3)
    return F.when(present(external) & (poor | (F.length(external) > F.length(parsed))), external).otherwise(parsed)


def authors_rule(parsed: Column, external: Column) -> Column:
    poor = ~present(parsed) | (F.length(parsed) < 10)
    return F.when(present(external) & (poor | (F.length(external) > F.length(parsed))), external).otherwise(parsed)


def year_rule(parsed: Column, external: Column) -> Column:
    """External if the parsed year is missing or one off at most."""
    near = F.coalesce(F.abs(external - parsed) <= 1, F.lit(True))
    return F.when(external.isNotNull() & near, external).otherwise(parsed)


def with_work(records: DataFrame, works: DataFrame, by_title: bool | str = True, name: str = "work", order: str | None = None) -> DataFrame:
    """``records`` with a struct ``work`` of the external record, null where none is found.

    ``works`` has the columns of ``works.mapped``. DOI first; records without a hit look up
    their title (over 10 characters) by equal keys, or with ``by_title="search"`` by the best
    work for their title and authors. Of several works with one key the first by the column
    ``order`` of ``works`` is taken, which is no part of ``work``; without it and among equals that with
    the smallest DOI, then title. Works are made one per key before the joins, so no join multiplies
    records, and records without a key don't take part in it.
    """
    work = F.struct(*[F.col(c) for c in works.columns if c != order])
    place = F.col(order) if order else F.lit(0)
    keyed = works.select(work.alias(name), place.alias("place"), doi_key(F.col("doi")).alias("k"), title_key(F.col("titulo_original")).alias("t"))

    def one_per(key: str) -> DataFrame:
        return keyed.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"{name} {key}")).agg(
            F.min_by(name, F.struct("place", F.coalesce(F.col(f"{name}.doi"), F.lit("")), f"{name}.titulo_original")).alias(f"{name} by {key}")
        )

    found = records.join(one_per("k"), doi_key(F.col("doi")) == F.col(f"{name} k"), "left")
    missing = F.col(f"{name} by k").isNull() & (F.length("titulo_original") > 10)
    if by_title == "search":
        authors = F.col("autores") if "autores" in records.columns else F.lit(None).cast("string")
        terms = F.when(missing, search.terms_of(F.col("titulo_original"), authors))
        found = written(found.withColumn(f"{name} terms", terms), "search-records")
        best = search.best_works(found.select(F.col(f"{name} terms").alias("terms")), works)
        best = best.select(F.col("terms").alias(f"{name} terms"), doi_key(F.col("work_doi")).alias(f"{name} t"))
        by_best = one_per("k").toDF(f"{name} t", f"{name} by t")
        found = found.join(best.join(by_best, f"{name} t"), f"{name} terms", "left")
        chosen = F.coalesce(F.col(f"{name} by k"), F.col(f"{name} by t"))
    elif by_title:
        found = found.join(one_per("t"), F.when(missing, title_key(F.col("titulo_original"))) == F.col(f"{name} t"), "left")
        chosen = F.coalesce(F.col(f"{name} by k"), F.col(f"{name} by t"))
    else:
        chosen = F.col(f"{name} by k")
    return found.select(*records.columns, chosen.alias(name))


def store_works(works: DataFrame, table: str, buckets: int = 64) -> None:
    """External works (``works.mapped``) as a table in buckets of their DOI key, one per key, the
    one with the smallest DOI; those without DOI go."""
    layouts.write_bucketed(works.withColumn("doi_key", doi_key(F.col("doi"))), table, "doi_key", buckets, least="doi")


def with_stored_work(records: DataFrame, table: str, name: str = "work") -> DataFrame:
    """As ``with_work`` by DOI alone, from a table of ``store_works``: no work is shuffled."""
    found = layouts.with_stored(records, table, "doi_key", doi_key(F.col("doi")), "stored work")
    kept = [c for c in records.sparkSession.table(table).columns if c != "doi_key"]
    row = F.struct(*[F.col(f"`stored work`.`{c}`").alias(c) for c in kept])
    return found.withColumn(name, F.when(F.col("stored work").isNotNull(), row)).drop("stored work")


def _field(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("int" if name == "ano" else "string")


def _assign(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({k: v for k, v in values.items()})


def merge_reference(df: DataFrame, work: str = "work") -> DataFrame:
    """A text reference with its work: listed fields external first, title, authors and year
    by their rules, and whether a work was found."""
    x = lambda f: F.col(f"{work}.{f}")
    values = {f: prefer(x(f), _field(df, f)) for f in [*PRIORITY, "resumen_abstract", "keywords"]}
    values["titulo_original"] = title_rule(_field(df, "titulo_original"), x("titulo_original"))
    values["autores"] = authors_rule(_field(df, "autores"), x("autores"))
    values["ano"] = year_rule(_field(df, "ano"), x("ano"))
    values["enriched"] = F.col(work).isNotNull()
    return _assign(df, values)


def merge_pdf_reference(df: DataFrame, work: str = "work") -> DataFrame:
    """A reference of a PDF: nine fields external first, title and authors by their rules; an
    external year always wins; DOI, pages, issue and type stay the parsed ones."""
    x = lambda f: F.col(f"{work}.{f}")
    values = {f: prefer(x(f), _field(df, f)) for f in PDF_PRIORITY}
    values["titulo_original"] = title_rule(_field(df, "titulo_original"), x("titulo_original"))
    values["autores"] = authors_rule(_field(df, "autores"), x("autores"))
    values["ano"] = F.coalesce(x("ano"), _field(df, "ano"))
    values["enriched"] = F.col(work).isNotNull()
    return _assign(df, values)


def merge_update(df: DataFrame, work: str = "work", compat: bool = True) -> DataFrame:
    """All external fields over the parsed ones; with ``compat`` those that a work always
    states win even when they are null."""
    from ..functions.works import fields

    matched = F.col(work).isNotNull()
    values = {}
    for f in fields:
        x = F.col(f"{work}.{f}")
        if compat and f in ALWAYS_SET:
            values[f] = F.when(matched, x).otherwise(_field(df, f))
        else:
            values[f] = F.coalesce(x, _field(df, f))
    return _assign(df, values)


def merge_document(df: DataFrame, work: str = "work", by_doi: bool = True, keep_extracted_doi: bool = False) -> DataFrame:
    """A document with the work found by its DOI: the work, with abstract and keywords filled
    from the text. Found by title only (``by_doi=False``): authors and DOI of the work, if it
    has authors. Without a work the extraction stays."""
    from ..functions.works import fields

    x = lambda f: F.col(f"{work}.{f}")
    matched = F.col(work).isNotNull()
    if not by_doi:
        named = matched & present(x("autores"))
        return _assign(
            df,
            {
                "autores": F.when(named, x("autores")).otherwise(_field(df, "autores")),
                "doi": F.when(named & present(x("doi")), x("doi")).otherwise(_field(df, "doi")),
            },
        )
    values = {f: F.when(matched, x(f)).otherwise(_field(df, f)) for f in fields}
    for f in ("doi", "resumen_abstract", "keywords"):
        values[f] = F.when(matched, prefer(x(f), _field(df, f))).otherwise(_field(df, f))
    if keep_extracted_doi:
        values["doi"] = F.when(matched, prefer(_field(df, "doi"), x("doi"))).otherwise(_field(df, "doi"))
    return _assign(df, values)


def merge_header(df: DataFrame, header: str = "header") -> DataFrame:
    """A TEI header below the extraction: title, authors and abstract of the header first, title
    and abstract normalised; DOI and year of the extraction first."""
    h = lambda f: F.col(f"{header}.{f}")
    return _assign(
        df,
        {
            "titulo_original": prefer(normalize.text(h("title")), _field(df, "titulo_original")),
            "autores": prefer(h("authors"), _field(df, "autores")),
            "resumen_abstract": prefer(normalize.text(h("abstract")), _field(df, "resumen_abstract")),
            "doi": prefer(_field(df, "doi"), h("doi")),
            "ano": F.coalesce(_field(df, "ano"), h("year")),
        },
    )


def llm_exclusive(df: DataFrame, llm: str, doi: str, kind: str, enabled: dict[str, bool], fields: list[str]) -> DataFrame:
    """Where the type goes to the model and it answered: its record, the DOI and the type."""
    answered = predicates.llm_eligible(F.col(kind), enabled) & (F.size(llm) > 0)
    values = {}
    for f in fields:
        value = F.try_element_at(F.col(llm), F.lit(f))
        values[f] = F.when(answered, value.try_cast("int") if f == "ano" else value).otherwise(_field(df, f))
    values["doi"] = F.when(answered, prefer(F.col(doi), F.try_element_at(F.col(llm), F.lit("doi")))).otherwise(_field(df, "doi"))
    values["tipo_documento"] = F.when(answered, F.col(kind)).otherwise(_field(df, "tipo_documento"))
    values["by_llm"] = answered
    return _assign(df, values)


def llm_complement(df: DataFrame, llm: str, header_year: Column, fields: list[str]) -> DataFrame:
    """The model's answer beside the extraction, field by field.

    What the model leaves out stays; an empty field takes the model's value. Where both are
    there: the year is that of the running head, else the model's; its abstract, cut to the
    limit, wins if it is one and the own is none or over a tenth shorter; journal, volume, pages,
    keywords and type win if over a fifth longer, or if the own is under three characters and not
    over a fifth longer; all other fields stay.
    """
    values = {}
    for f in fields:
        a, b = _field(df, f), F.try_element_at(F.col(llm), F.lit(f))
        b = b.try_cast("int") if f == "ano" else b
        if f == "ano":
            better = F.coalesce(header_year, b)
        elif f == "resumen_abstract":
            cut = normalize.truncated(b)
            longer = F.length(cut) > 1.1 * F.length(a)
            better = F.when(predicates.is_abstract(b) & (~predicates.is_abstract(a) | longer), cut).otherwise(a)
        elif f in CRITICAL:
            longer, shorter = F.length(b) > 1.2 * F.length(a), F.length(a) > 1.2 * F.length(b)
            better = F.when(longer | (~shorter & (F.length(a) < 3)), b).otherwise(a)
        else:
            better = a
        values[f] = F.when(~present(b), a).when(~present(a), b).otherwise(better)
    return _assign(df, values)


def filled_fields(columns: list[str]) -> Column:
    """How many of the fields are present."""
    total = F.lit(0)
    for c in columns:
        total = total + present(F.col(c)).cast("int")
    return total


def title_author_match(records: DataFrame, works: DataFrame, record_id: str = "ref_id") -> DataFrame:
    """(record, doi) of the best work for a title: equal title keys, authors alike first.

    The best has the smaller author distance (over the first 200 characters), then the smaller
    DOI. Equal authors meet in a join on both; only for other spellings the different authors of
    a title are compared, each once, and the best is taken before rows are shuffled.
    """
    own = records.select(record_id, "autores", title_key(F.col("titulo_original")).alias("t")).where("t is not null")
    asked = own.select("t", F.coalesce("autores", F.lit("")).alias("autores")).distinct()
    right = works.select(title_key(F.col("titulo_original")).alias("t"), F.coalesce("autores", F.lit("")).alias("wa"), F.col("doi").alias("work_doi"))
    right = right.where("t is not null").groupBy("t", "wa").agg(F.min("work_doi").alias("work_doi"))
    same = asked.join(right.withColumnRenamed("wa", "autores"), ["t", "autores"])
    far = F.levenshtein(F.substring("autores", 1, 200), F.substring("wa", 1, 200))
    rest = asked.join(same, ["t", "autores"], "left_anti").join(right, "t")
    near = rest.groupBy("t", "autores").agg(F.min_by("work_doi", F.struct(far, "work_doi")).alias("work_doi"))
    best = same.select("t", "autores", "work_doi").unionByName(near)
    return own.withColumn("autores", F.coalesce("autores", F.lit(""))).join(best, ["t", "autores"]).select(record_id, "work_doi")
