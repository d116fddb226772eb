"""Whole jobs: citations, documents, reference lists and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import citation, extract, fulltext, tei, works
from ..operators import merge, split
from ..sources import pages as pages_source


def parse_citations(df: DataFrame, column: str, as_of_year: int, compat: bool = True) -> DataFrame:
    """One narrow stage: the plausible line of each text and its fields."""
    return citation.parse_citations(df.withColumn(column, pages_source.plausible_line(F.col(column))), column, as_of_year, compat)


def map_works(records: DataFrame, column: str = "record") -> DataFrame:
    """The external records' fields as columns."""
    return records.select(works.mapped(F.col(column)).alias("w")).select("w.*")


def enrich(parsed: DataFrame, mapped: DataFrame, policy: str = "reference", by_title: bool | str = True, compat: bool = True, order: str | None = None) -> DataFrame:
    """Parsed records with their works merged by a policy; ``by_title`` and ``order`` as in ``merge.with_work``."""
    policies = {
        "reference": merge.merge_reference,
        "pdf_reference": merge.merge_pdf_reference,
        "update": lambda df: merge.merge_update(df, compat=compat),
        "document": merge.merge_document,
    }
    return policies[policy](merge.with_work(parsed, mapped, by_title, order=order)).drop("work")


def extract_documents(df: DataFrame, pages: str, as_of_year: int, meta_title: str | None = None, tei_header: str | None = None) -> DataFrame:
    """``df`` with a document's fields from its pages; all in one narrow stage."""
    df = df.withColumns({"__text": pages_source.whole_text(F.col(pages)), "__first": pages_source.first_page(F.col(pages))})
    t, first = F.col("__text"), F.col("__first")
    title = F.col(meta_title) if meta_title else F.lit(None).cast("string")
    df = df.withColumns(
        {
            "doi": F.coalesce(extract.doi(first), extract.doi(t)),
            "ano": F.coalesce(fulltext.year_from_header(F.substring(t, 1, fulltext.HEAD), as_of_year), extract.year(t, as_of_year)),
            "isbn_issn": extract.isbn_issn(t),
            "titulo_original": fulltext.title(title, first),
            "autores": fulltext.authors(t),
            "resumen_abstract": fulltext.abstract(t),
            "keywords": fulltext.keywords(t),
            "lugar_publicacion_entrega": fulltext.journal(t),
            "paginas": fulltext.pages(t),
            "volumen_edicion": fulltext.volume(t),
            "tipo_documento": fulltext.kind(first),
        }
    )
    if tei_header:
        df = merge.merge_header(df.withColumn("header", tei.header(F.col(tei_header)))).drop("header")
    return df.drop("__text", "__first")


def references_of_documents(df: DataFrame, key: str, text: str, as_of_year: int, tei_refs: str | None = None, compat: bool = True) -> DataFrame:
    """(key, pos, reference and its fields) of every accepted reference; records with neither
    title nor authors go."""
    refs = split.extract_references(df, key, text, tei_refs, compat)
    parsed = citation.parse_citations(refs, "reference", as_of_year, compat)
    return parsed.where("titulo_original is not null or autores is not null")
