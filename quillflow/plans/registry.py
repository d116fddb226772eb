"""All queries and their SQL by name; names begin with the operator's group and number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citation, extract, fulltext, normalize, predicates, rx, tei, works
from ..functions import patterns as P
from ..operators import aggregate, merge, relational, split
from ..sources import corpus, pages, sinks
from ..sources.schema import DOCUMENT, EXPORT_NAMES
from ..streaming import jobs
from . import pipelines, rules

AS_OF = 2026
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_WITH = f"with pieces as ({corpus.PIECES}), cites as (select ref_id, cust, {corpus.CITATION} as t from pieces), arts as (select ref_id, {corpus.ARTICLE} as t from pieces) "


def _register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _column(name: str, make, sql: str | None, source: str = "citations", out: str = "value") -> None:
    """A query of one column function over a derived corpus: (ref_id, value)."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = getattr(corpus, source)(spark, sf_dir)
        return df.select("ref_id", make(F.col("text")).alias(out))

    table = {"citations": "cites", "articles": "arts"}[source]
    _register(name, query, _WITH + f"select ref_id, {sql} as {out} from {table}" if sql else None)


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _re(p: str, group: int = 1, flags: str = "", c: str = "t") -> str:
    return f"nullif(regexp_extract({c}, {_q(p)}, {group}, 's{flags}'), '')"


def _sub(c: str, p: str, by: str, flags: str = "") -> str:
    return f"regexp_replace({c}, {_q(p)}, {_q(by)}, 'g{flags}')"


def _strip(c: str) -> str:
    return _sub(c, r"^\s+|\s+$", "")


# --- normalisation -------------------------------------------------------------------------
_L, _U = "a-záéíóúñ", "A-ZÁÉÍÓÚÑ"


def _spacing_sql(c: str) -> str:
    c = _sub(c, f"([{_L}])([{_U}])", r"\1 \2")
    c = _sub(c, rf"(\d)([{_U}{_L}])", r"\1 \2")
    return _sub(c, rf"([{_U}{_L}])(\d)", r"\1 \2")


def _one_space_sql(c: str) -> str:
    return _strip(_sub(c, r"\s+", " "))


def _text_spacing_sql(c: str) -> str:
    c = _spacing_sql(c)
    c = _sub(c, f"([{_U}][{_L}]{{2,}}),([{_U}])", r"\1, \2")
    c = _sub(c, f"([{_L}]),([{_U}][{_L}]{{2,}})", r"\1, \2")
    c = _sub(c, r"([A-Z])\.([A-Z])", r"\1. \2")
    c = _sub(c, f"([{_L}])([{_U}][{_L}]{{3,}})", r"\1 \2")
    return _one_space_sql(c)


_SQUEEZED = "replace(replace(t, ', ', ','), '. ', '.')"  # gives the normalisers work
_squeezed = lambda c: F.replace(F.replace(c, F.lit(", "), F.lit(",")), F.lit(". "), F.lit("."))
_column("nrm_01_spacing", lambda c: normalize.spacing(c), _spacing_sql("t"))
_column("nrm_02_text_spacing", lambda c: normalize.text_spacing(_squeezed(c)), _text_spacing_sql(_SQUEEZED))
_column("nrm_03_author_comma", lambda c: normalize.author_comma(_squeezed(c)), _sub(_SQUEEZED, f"([{_U}][{_L}]{{2,}}),([{_U}])", r"\1, \2"))
_column("nrm_04_author_list", lambda c: normalize.author_list(_squeezed(c)), _sub(_SQUEEZED, f"([{_L}]),([{_U}][{_L}]{{2,}})", r"\1, \2"))
_column("nrm_05_initials", lambda c: normalize.initials(_squeezed(c)), _sub(_SQUEEZED, r"([A-Z])\.([A-Z])", r"\1. \2"))
_column("nrm_06_concatenated_words", lambda c: normalize.concatenated_words(F.replace(c, F.lit(" "), F.lit(""))), _sub("replace(t, ' ', '')", f"([{_L}])([{_U}][{_L}]{{3,}})", r"\1 \2"))
_column("nrm_07_one_space", lambda c: normalize.one_space(F.concat(F.lit(" \t"), F.replace(c, F.lit(" "), F.lit(" \n ")))), _one_space_sql("' ' || chr(9) || replace(t, ' ', ' ' || chr(10) || ' ')"))
_column("nrm_08_line_breaks", lambda c: normalize.line_breaks(F.replace(F.replace(c, F.lit(". "), F.lit("\r\n")), F.lit(", "), F.lit("\r"))), _sub("replace(replace(t, '. ', chr(13) || chr(10)), ', ', chr(13))", "\\r\\n?", "\n"))
_column("nrm_09_running_heads", lambda c: normalize.without_running_heads(F.concat(c, F.lit("\nVolume 12 of it\nwww.frontiersin.org 3\nend"))), "t || chr(10) || chr(10) || chr(10) || 'end'")
_column("nrm_10_references_header", lambda c: normalize.without_references_header(F.concat(F.lit("References \n "), c)), _strip("t"))
_column("nrm_11_garbage", lambda c: normalize.without_garbage(F.concat(F.lit("and approved the submitted version. References . , "), c)), _strip("t"))
_column("nrm_12_text", lambda c: normalize.text(F.concat(F.lit("#_#x0041 #xE9  "), c)), "'A ' || chr(233) || ' ' || " + _one_space_sql("t"))
_column("nrm_14_tags", lambda c: normalize.without_tags(F.concat(F.lit("<jats:p>"), c, F.lit(" </jats:p>"))), _one_space_sql("t"))
_column("nrm_15_accents", lambda c: normalize.accents(F.concat(F.lit("café; Ñ;"), c)), "'caf' || chr(233) || ' ' || chr(209) || t")
_column("nrm_16_truncated", lambda c: normalize.truncated(F.repeat(c, 60)), "case when length(repeat(t, 60)) > 5000 then (case when strpos(substr(repeat(t, 60), 1, 5000), ' ') > 0 and 5000 - strpos(reverse(substr(repeat(t, 60), 1, 5000)), ' ') > 4500 then substr(repeat(t, 60), 1, 5000 - strpos(reverse(substr(repeat(t, 60), 1, 5000)), ' ')) else substr(repeat(t, 60), 1, 5000) end) || '... [truncado]' else repeat(t, 60) end")
_column("nrm_17_cell", lambda c: normalize.cell(F.concat(F.lit("\x02 a\r\n\n\n\n b    c "), c)), "'a' || chr(10) || chr(10) || 'b  c ' || " + _strip("t"))
_column("nrm_19_keywords", lambda c: normalize.keywords(c), _sub(_one_space_sql("rtrim(t, '.,;')"), r",\s*", ", "))
_column("nrm_20_author_connectors", lambda c: normalize.author_connectors(F.concat(c, F.lit(" and B y C, et al. x"))), "t || ', B, C x'")
_column("nrm_21_reference_start", lambda c: normalize.reference_start(F.concat(F.lit("and approved. some words "), c)), _strip("t"))

# --- generic extraction -----------------------------------------------------------------------


def _doi_sql(p: str) -> str:
    d = f"rtrim({_re(p, 1, 'i')}, '.,;:)')"
    return f"case when regexp_matches({d}, {_q(r'^10[.][0-9]{4,}/[^/]{5}')}) then {d} end"


_URLS = f"coalesce({_doi_sql(P.DOI_URL)}, {_doi_sql(P.DOI_HOST)})"
_column("ext_01_doi_url", extract.doi_from_url, _URLS)
_column("ext_02_doi_label", extract.doi_from_label, _doi_sql(P.DOI_LABEL))
_BARE = "list_transform(regexp_extract_all(t, '(10\\.\\d{4,}/[a-zA-Z0-9\\.\\-]+)', 1, 'i'), lambda d: rtrim(d, '.,;:)'))"
_LONGEST = f"list_max(list_transform(list_filter({_BARE}, lambda d: length(split_part(d, '/', 2)) >= 5 and (contains(split_part(d, '/', 2), '.') or length(split_part(d, '/', 2)) >= 8)), lambda d: {{'n': length(d), 'd': d}})).d"
_column("ext_03_doi_bare", extract.doi_bare_longest, _LONGEST)
_column("ext_04_doi_raw", extract.doi_bare_raw, f"list_first(list_filter({_BARE}, lambda d: length(d) > 0))")
_column("ext_doi", extract.doi, f"coalesce({_URLS}, {_doi_sql(P.DOI_LABEL)}, {_LONGEST})")
_column("ext_05_year_header", lambda c: extract.year_from_header(c, AS_OF), r"try_cast(list_last(regexp_extract_all(t, ':\s*\d+[-–—]\d+,\s*(\d{4})', 1)) as int)", "articles")
_YEARS = r"list_transform(regexp_extract_all(t, '\b(19\d{2}|20\d{2})\b', 1), lambda y: y::int)"
_column("ext_06_year", lambda c: extract.year(c, AS_OF), f"coalesce(list_max(list_filter({_YEARS}, lambda y: y <= {AS_OF + 2})), list_max({_YEARS}))")
_column("ext_07_issn", extract.isbn_issn, "replace(" + _re(P.ISSN, 1, "i") + ", '-', '')", "articles")
_column("ext_08_link", extract.link, _re(P.URL, 0))

# --- citations -----------------------------------------------------------------------------------
_TIERS = [P.YEAR_PARENTHESIS, P.YEAR_SEMICOLON, P.YEAR_DOT_SPACE, P.YEAR_DOT, P.YEAR_COMMA]
_YEAR = "coalesce(" + ", ".join(f"case when {_re(p)}::int between 1900 and 2030 then {_re(p)}::int end" for p in _TIERS) + ")"
_SPAN = "(\\d+[-–—]\\d+)"
_PAGES = f"coalesce({_re('pp?[.]\\s*' + _SPAN)}, {_re(_SPAN)})"
_VOLUME = "coalesce({}, {}, {}, case when regexp_matches(t, '\\d+\\(\\d+\\)') then {} || '(' || {} || ')' end)".format(
    _re("[Vv]ol[.]?\\s*(\\d+)"), _re("[Vv]olume\\s*(\\d+)"), _re("v[.]\\s*(\\d+)"), _re("(\\d+)\\((\\d+)\\)", 1), _re("(\\d+)\\((\\d+)\\)", 2)
)
_column("ref_02_year", citation.year_stated, _YEAR)
#: Of a citation by construction, as the rules read its forms.
_AUTHORS = "a1 || ', ' || i1 || '.' || case when ref_id % 4 = 0 then '' else ', Perez, ' || i2 || '.' end"
_TITLE = "case when ref_id % 5 in (0, 2) then 'Observations on the ' || seg || ' catch of stock ' || a1 end"
_PIECES = f"with pieces as ({corpus.PIECES}) "


def _constructed(name: str, make, sql: str) -> None:
    _register(name, lambda s, d: corpus.citations(s, d).select("ref_id", make(F.col("text")).alias("value")), _PIECES + f"select ref_id, {sql} as value from pieces")


_constructed("ref_02_year_anywhere", citation.year_anywhere, "yr::int")
_constructed("ref_03_authors", citation.authors, _AUTHORS)
_constructed("ref_04_title", citation.title, _TITLE)
_column("ref_06_pages", citation.pages, _PAGES)
_column("ref_07_volume", citation.volume, _VOLUME)
_column(
    "ref_08_book_title",
    lambda c: citation.book_title(F.concat(c, F.when(F.col("ref_id") % 3 == 0, "").otherwise(F.concat(F.lit(" In: Smith, A. (Eds.), The great book of "), F.substring_index(F.substring_index(c, " catch", 1), " ", -1), F.lit(" pp. 1-2"))))),
    "case when ref_id % 3 <> 0 then 'The great book of ' || regexp_extract(t, ' ([a-z]+) catch', 1) end",
)
_column("ref_09_chapter", citation.is_chapter, "regexp_matches(t, '(?i)\\bIn:\\s*')")


def ref_01_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.parse_citations(corpus.citations(spark, sf_dir), "text", AS_OF).drop("text", "cust")


def _fields_by_construction() -> str:
    """What the parser must find, from the pieces the citations are made of."""
    doi = "case when ref_id % 3 = 0 then '10.' || reg || '/jms.' || yr || '.' || p1 when ref_id % 3 = 1 then '10.' || reg || '/jms' || p2 end"
    link = "case when ref_id % 3 = 1 then 'https://doi.org/10.' || reg || '/jms' || p2 end"
    volume = "case when ref_id % 2 = 0 then cast(ref_id % 97 + 1 as varchar) || '(' || cast(ref_id % 6 + 1 as varchar) || ')' end"
    article = f"case when ref_id % 5 in (0, 2) then '{P.ARTICLE}' end"
    return (
        _WITH + f"select ref_id, {doi} doi, yr::int ano, {link} link, p1 || '-' || p2 paginas, {volume} volumen_edicion, null::varchar isbn_issn, {_AUTHORS} autores, "
        f"{_TITLE} titulo_original, {article} tipo_documento, case when ref_id % 5 in (0, 2) then 'J. Mar. Syst' end lugar_publicacion_entrega from pieces"
    )


def ref_01_parse_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ref_01_parse(spark, sf_dir).select("ref_id", "doi", "ano", "link", "paginas", "volumen_edicion")


_register("ref_01_parse", ref_01_parse, _fields_by_construction())
_register("ref_01_parse_core", ref_01_parse_core, "select ref_id, doi, ano, link, paginas, volumen_edicion from (" + _fields_by_construction() + ")")


def agg_03_citations_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of each year and how many have a DOI, pages and a volume."""
    c = F.col("text")
    fields = corpus.citations(spark, sf_dir).select(citation.year_stated(c).alias("ano"), extract.doi(c).alias("doi"), citation.pages(c).alias("paginas"), citation.volume(c).alias("volumen"))
    return fields.groupBy("ano").agg(F.count("*").alias("n"), F.count("doi").alias("n_doi"), F.count("paginas").alias("n_pages"), F.count("volumen").alias("n_volume"))


_register(
    "agg_03_citations_by_year",
    agg_03_citations_by_year,
    _WITH + f"select {_YEAR} ano, count(*) n, count(coalesce({_URLS}, {_doi_sql(P.DOI_LABEL)}, {_LONGEST})) n_doi, count({_PAGES}) n_pages, count({_VOLUME}) n_volume from cites group by 1",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_03_citations_by_year(spark, sf_dir).orderBy("ano")


# --- predicates ------------------------------------------------------------------------------------
_column("prd_01_header", lambda c: predicates.is_header(F.concat(F.when(F.col("ref_id") % 2 == 0, "Volume 3 ").otherwise(""), c)), "ref_id % 2 = 0")
_column("prd_02_section", lambda c: predicates.is_section(F.concat(F.when(F.col("ref_id") % 3 == 0, "Funding ").otherwise(""), c)), "ref_id % 3 = 0")
_column("prd_03_reference_section", lambda c: predicates.is_reference_section(F.concat(F.when(F.col("ref_id") % 2 == 0, "Works  cited ").otherwise(""), c)), "ref_id % 2 = 0")
_column("prd_04_invalid_phrase", lambda c: predicates.has_invalid_phrase(F.concat(c, F.when(F.col("ref_id") % 2 == 0, " we appreciate").otherwise(""))), "ref_id % 2 = 0")
_column("prd_05_excluded_title", lambda c: predicates.is_excluded_title(F.concat(F.when(F.col("ref_id") % 2 == 0, "abstract ").otherwise(""), c)), "ref_id % 2 = 0")
_constructed(
    "prd_06_is_reference",
    lambda c: predicates.is_reference(F.when(F.col("ref_id") % 3 == 0, F.substring(c, 1, 40)).when(F.col("ref_id") % 3 == 1, F.regexp_replace(c, "[0-9]", "")).otherwise(c)),
    "ref_id % 3 = 2 and ref_id % 5 <> 4",  # of the last form nothing stands behind the year
)
_column("prd_07_accepted", predicates.is_accepted_split, "length(t) >= 50 and regexp_matches(t, '\\b(19\\d{2}|20[0-2]\\d)\\b')")
_column("prd_08_is_abstract", lambda c: predicates.is_abstract(c), "ref_id % 3 <> 0", "articles")  # the others hold a link
_column("prd_15_only_numbers", lambda c: predicates.only_numbers(c) | predicates.only_short_upper(c) | predicates.has_concatenated_words(c), "regexp_matches(t, '^\\d+$') or regexp_matches(t, '^[A-Z\\s]{1,30}$') or regexp_matches(t, '[a-z][A-Z]')")


def prd_10_minimal(spark, sf_dir):
    return ref_01_parse(spark, sf_dir).where(predicates.is_minimal_record(F.col("titulo_original"), F.col("autores"))).agg(F.count("*").alias("n"))


def prd_12_upload_limits(spark, sf_dir):
    files = corpus.citations(spark, sf_dir).select("cust", (F.length("text") * 10000).alias("length"))
    return aggregate.upload_limits(files, "cust")


_register("prd_10_minimal", prd_10_minimal, _PIECES + "select count(*) n from pieces")
_register(
    "prd_12_upload_limits",
    prd_12_upload_limits,
    _WITH + "select cust, count(*) n_files, sum(length(t) * 10000)::bigint n_bytes, count(*) <= 10 and sum(length(t) * 10000) <= 52428800 and max(length(t) * 10000) <= 10485760 ok from cites group by 1",
)
_column(
    "prd_13_zero_references",
    lambda c: predicates.zero_reference_message(
        F.when(F.col("ref_id") % 4 == 1, c).when(F.col("ref_id") % 4 == 2, F.concat(F.lit("References "), F.regexp_replace(c, "[0-9]", ""))).when(F.col("ref_id") % 4 == 3, F.concat(F.lit("References "), c)),
        F.when(F.col("ref_id") % 5 == 0, 3).otherwise(0),
    ),
    "case when ref_id % 5 <> 0 then case ref_id % 4 when 0 then 'no text' when 1 then 'no references section' when 2 then 'no years' else 'no reference accepted' end end",
)
_column("prd_14_llm_eligible", lambda c: predicates.llm_eligible(fulltext.kind(c), {P.REPORT: True, P.BOOK: True}), "ref_id % 4 in (0, 2)", "articles")

# --- full text --------------------------------------------------------------------------------------
_column("pdf_02_kind", fulltext.kind, f"case ref_id % 4 when 0 then '{P.REPORT}' when 1 then '{P.THESIS}' when 2 then '{P.BOOK}' else '{P.ARTICLE}' end", "articles")


def _article_query(name: str, make, sql: str) -> None:
    def query(spark, sf_dir):
        return corpus.articles(spark, sf_dir).select("ref_id", make(F.col("text")).alias("value"))

    _register(name, query, _WITH + f"select ref_id, {sql} as value from pieces")


_article_query("pdf_03_title", lambda c: fulltext.title(F.lit(None).cast("string"), c), "'Invest. Mar., Valpara' || chr(237) || 'so, ' || cast(ref_id % 97 + 1 as varchar) || ': ' || p1 || '-' || p2 || ', ' || yr || ' Observations on the ' || seg || ' catch of stock ' || a1 || ' in coastal waters'")
_article_query("pdf_05_authors", fulltext.authors_lines, "a1 || ', ' || i1 || '., Perez, ' || i2")
_article_query("pdf_06_abstract", fulltext.abstract, "'We describe the ' || seg || ' catch of stock ' || a1 || ' over several seasons and compare it with the catch of other stocks in the same waters.'")
_article_query("pdf_07_keywords", fulltext.keywords, "seg || ', catch, stock ' || a1")
_article_query(
    "pdf_08_journal",
    lambda c: fulltext.journal(F.when(F.col("ref_id") % 2 == 0, c).otherwise(F.replace(c, F.lit("Invest. Mar."), F.lit("Rev. Biol. Sur")))),
    "case when ref_id % 2 = 0 then 'Invest. Mar.' else 'Rev. Biol. Sur' end || ', Valpara' || chr(237) || 'so'",
)
_article_query("pdf_09_pages", fulltext.pages, "p1 || '-' || p2")
_article_query("pdf_10_volume", fulltext.volume, "cast(ref_id % 97 + 1 as varchar)")
_article_query("pdf_11_year", lambda c: fulltext.year_from_header(c, AS_OF), "yr::int")
_article_query("pdf_04_authors_section", lambda c: fulltext.authors_section(F.concat(F.lit("Coordinador: Smith, A. and Doe, B.\nResumen\n"), c)), "'Smith, A. and Doe, B.'")


def pdf_01_extract(spark, sf_dir):
    df = corpus.articles(spark, sf_dir).select("ref_id", F.array(F.struct(F.lit(1).alias("page_no"), F.col("text").alias("text"))).alias("pages"))
    return pipelines.extract_documents(df, "pages", AS_OF).drop("pages")


_register(
    "pdf_01_extract",
    pdf_01_extract,
    _PIECES + "select ref_id, case when ref_id % 3 = 0 then '10.' || reg || '/inv.' || p1 || '.mar' end doi, yr::int ano, '0717' || cast(1000 + ref_id % 9000 as varchar(4)) isbn_issn, "
    "'Invest. Mar., Valpara' || chr(237) || 'so, ' || cast(ref_id % 97 + 1 as varchar) || ': ' || p1 || '-' || p2 || ', ' || yr || ' Observations on the ' || seg || ' catch of stock ' || a1 || ' in coastal waters' titulo_original, "
    "a1 || ', ' || i1 || '., Perez, ' || i2 autores, "
    "'We describe the ' || seg || ' catch of stock ' || a1 || ' over several seasons and compare it with the catch of other stocks in the same waters.' resumen_abstract, "
    "seg || ', catch, stock ' || a1 keywords, 'Invest. Mar., Valpara' || chr(237) || 'so' lugar_publicacion_entrega, p1 || '-' || p2 paginas, cast(ref_id % 97 + 1 as varchar) volumen_edicion, "
    f"case ref_id % 4 when 0 then '{P.REPORT}' when 1 then '{P.THESIS}' when 2 then '{P.BOOK}' else '{P.ARTICLE}' end tipo_documento from pieces",
)

# --- sources -----------------------------------------------------------------------------------------


def _paged(spark, sf_dir):
    struct = lambda n, t: F.struct(F.lit(n).alias("page_no"), t.alias("text"))
    return corpus.citations(spark, sf_dir).select("ref_id", "text", F.array(struct(1, F.col("text")), struct(2, F.lit("")), struct(3, F.lit("end"))).alias("pages"))


_register("src_09_whole_text", lambda s, d: _paged(s, d).select("ref_id", pages.whole_text(F.col("pages")).alias("value")), _WITH + "select ref_id, t || chr(10) || 'end' || chr(10) as value from cites")
_register("src_10_first_page", lambda s, d: _paged(s, d).select("ref_id", pages.first_page(F.col("pages")).alias("value")), _WITH + "select ref_id, t as value from cites")
_register("src_11_first_pages", lambda s, d: _paged(s, d).select("ref_id", pages.first_pages(F.col("pages"), 3).alias("value")), _WITH + "select ref_id, '--- PÁGINA 1 ---' || chr(10) || t || chr(10) || '--- PÁGINA 3 ---' || chr(10) || 'end' || chr(10) as value from cites")
_column("src_07_plausible_line", lambda c: pages.plausible_line(F.concat(F.lit("short\n"), c, F.lit("\nmore"))), "trim(t)")
_column(
    "src_08_is_multiple",
    lambda c: pages.is_multiple(F.when(F.col("ref_id") % 3 == 0, c).when(F.col("ref_id") % 3 == 1, F.concat(c, F.lit("\nmore"))).otherwise("no year\nmore")),
    "ref_id % 3 = 1",
)
_column("src_21_llm_input", lambda c: pages.llm_input(c), "case when length(t) > 10000 then substr(t, 1, 10000) || chr(10) || '... [truncado]' when length(t) >= 100 then t end")


def src_12_column_text(spark, sf_dir):
    """Pages of two columns of 30 words (odd numbers left, even ones right, from bottom to top),
    of one column, and with too few words."""
    form = F.col("ref_id") % 3
    n = F.sequence(F.lit(1), F.when(form == 2, 50).otherwise(60))
    word = lambda i: F.struct(F.when((i % 2 == 1) | (form == 1), 10.0).otherwise(90.0).alias("x0"), (-i).cast("double").alias("top"), F.concat(F.lit("w"), i.cast("string")).alias("text"))
    return corpus.citations(spark, sf_dir).select("ref_id", pages.column_text(F.transform(n, word), F.lit(100.0)).alias("value"))


_register(
    "src_12_column_text",
    src_12_column_text,
    _WITH + "select ref_id, case ref_id % 3 when 0 then (select string_agg('w' || i, ' ' order by i desc) from range(1, 60, 2) r(i)) || chr(10) || (select string_agg('w' || i, ' ' order by i desc) from range(2, 61, 2) r(i)) "
    "when 1 then (select string_agg('w' || i, ' ' order by i desc) from range(1, 61) r(i)) end as value from cites",
)
_register(
    "src_06_explode_references",
    lambda s, d: pages.explode_references(corpus.citations(s, d).select("ref_id", F.array("text", F.lit(" "), F.lit("x")).alias("refs")), "refs", "ref_id").withColumn("pos", F.col("pos").cast("int")),
    _WITH + "select ref_id, unnest([0, 1])::int pos, unnest([t, 'x']) reference from cites",
)

# --- splitting ------------------------------------------------------------------------------------------


#: Twenty citations at most make a document, all of one form (by the year's place).
_DOC = "(ref_id / 100) * 5 + ref_id % 5"


def _with_doc(spark, sf_dir):
    return corpus.citations(spark, sf_dir).withColumn("doc", F.expr("(ref_id div 100) * 5 + ref_id % 5"))


def _blobs(spark, sf_dir):
    """(doc, text): the citations of each document behind a heading, joined."""
    c = _with_doc(spark, sf_dir)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref_id", "text"))), lambda s: rx.strip(s["text"])), " ")
    return c.groupBy("doc").agg(F.count("*").alias("n"), F.concat(F.lit("Words before. REFERENCES "), joined, F.lit(" FUNDING none")).alias("text"))


_register(
    "spl_01_section",
    lambda s, d: _blobs(s, d).select("doc", rx.strip(split.reference_section(F.col("text"))).alias("value")),
    _WITH + f", b as (select {_DOC.replace('/', '//')} doc, string_agg({_strip('t')}, ' ' order by ref_id) || ' FUNDING none' t from cites group by 1) select doc, {_strip(_text_spacing_sql('t'))} as value from b",
)
_register(
    "spl_02_end_sections",
    lambda s, d: corpus.citations(s, d).select("ref_id", split.without_end_sections(F.concat("text", F.lit(" Funding x. Acknowledgments y"))).alias("value")),
    _WITH + "select ref_id, t || ' ' as value from cites",
)
_register("spl_05_full_start", lambda s, d: _blobs(s, d).select("doc", F.posexplode(split.by_full_start(F.col("text"))).alias("pos", "value")))
_register("spl_06_simple_start", lambda s, d: _blobs(s, d).select("doc", F.posexplode(split.by_simple_start(rx.sub(F.col("text"), r"(\d)-(\d+)", "$1–$2"))).alias("pos", "value")))
_register("spl_07_year", lambda s, d: _blobs(s, d).select("doc", F.posexplode(split.by_year(F.col("text"))).alias("pos", "value")))


def spl_08_lines(spark, sf_dir):
    c = _with_doc(spark, sf_dir)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref_id", "text"))), lambda s: rx.strip(s["text"])), "\n\n")
    lines = split.by_lines(c.groupBy("doc").agg(joined.alias("text")), "doc", "text")
    return lines.select("doc", "reference")


_register("spl_08_lines", spl_08_lines, _WITH + "select " + _DOC.replace("/", "//") + " doc, " + _one_space_sql("t") + " reference from cites")
_register("spl_10_extract", lambda s, d: split.extract_references(_blobs(s, d), "doc", "text"))


#: Citations whose year stands behind the authors, in the four forms of it.
_YEAR_FIRST = corpus.CITATION.replace("ref_id % 5", "ref_id % 4")


def spl_10_whole(spark, sf_dir):
    """Outside compat mode every reference comes out whole, spaced like any text."""
    c = corpus.pieces(spark, sf_dir).select("ref_id", F.expr("(ref_id div 100) * 4 + ref_id % 4").alias("doc"), F.expr(_YEAR_FIRST).alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref_id", "text"))), lambda s: rx.strip(s["text"])), " ")
    blobs = c.groupBy("doc").agg(F.concat(F.lit("Words before. REFERENCES "), joined, F.lit(" FUNDING none")).alias("text"))
    found = split.extract_references(blobs, "doc", "text", compat=False)
    return found.select("doc", F.col("pos").cast("int").alias("pos"), "reference")


_register(
    "spl_10_whole",
    spl_10_whole,
    f"with pieces as ({corpus.PIECES}), c as (select ref_id, (ref_id // 100) * 4 + ref_id % 4 doc, {_YEAR_FIRST} t from pieces) "
    f"select doc, (row_number() over (partition by doc order by ref_id) - 1)::int pos, {_strip(_text_spacing_sql('t'))} reference from c",
)

# --- XML and JSON --------------------------------------------------------------------------------------------


def _tei(spark, sf_dir):
    xml = F.expr(
        "'<TEI xmlns=\"http://www.tei-c.org/ns/1.0\"><biblStruct><analytic><title level=\"a\">Observations on the ' || seg || '</title>"
        "<author><persName><forename>' || i1 || '</forename><surname>' || a1 || '</surname></persName></author></analytic>"
        "<monogr><title level=\"j\">Mar. Biol.</title><imprint><date when=\"' || yr || '-01\"/><biblScope unit=\"volume\">' || p1 || '</biblScope></imprint></monogr>"
        "<idno type=\"DOI\">10.' || reg || '/x</idno></biblStruct><bibl>Raw ' || a1 || '</bibl></TEI>'"
    )
    return corpus.pieces(spark, sf_dir).select("ref_id", xml.alias("xml"))


_register(
    "xml_01_references",
    lambda s, d: _tei(s, d).select("ref_id", F.posexplode(tei.references(F.col("xml"))).alias("pos", "r")).select("ref_id", F.col("pos").cast("int").alias("pos"), "r.authors", "r.year", "r.title", "r.journal", "r.volume", "r.doi", "r.raw_text"),
    _WITH + "select ref_id, 0::int pos, a1 || ', ' || i1 authors, yr::int as year, 'Observations on the ' || seg title, 'Mar. Biol.' journal, p1 volume, '10.' || reg || '/x' doi, null raw_text from pieces union all select ref_id, 1::int, null, null, null, null, null, null, 'Raw ' || a1 from pieces",
)
_register(
    "xml_05_as_text",
    lambda s, d: _tei(s, d).select("ref_id", F.transform(tei.references(F.col("xml")), tei.as_text)[0].alias("value")),
    _WITH + "select ref_id, a1 || ', ' || i1 || '. (' || yr || '). Observations on the ' || seg || '. Mar. Biol.. Vol. ' || p1 || '. DOI: 10.' || reg || '/x' as value from pieces",
)


def prd_09_quality(spark, sf_dir):
    """Ten references each, 0 to 10 of them full."""
    one = F.regexp_extract("xml", "(?s)(<biblStruct.*</biblStruct>)", 1)
    parts = _tei(spark, sf_dir).select("ref_id", one.alias("full"), F.lit("<bibl>Raw text</bibl>").alias("raw"))
    xml = F.expr("repeat(full, cast(ref_id % 11 as int)) || repeat(raw, cast(10 - ref_id % 11 as int))")
    return parts.select("ref_id", tei.good_quality(tei.references(xml)).alias("value"))


_register("prd_09_quality", prd_09_quality, _WITH + "select ref_id, ref_id % 11 >= 7 as value from pieces")
_register(
    "xml_04_header",
    lambda s, d: _tei(s, d).select("ref_id", tei.header(F.col("xml")).alias("h")).select("ref_id", "h.title", "h.authors", "h.year", "h.doi"),
    _WITH + "select ref_id, 'Observations on the ' || seg title, a1 || ', ' || i1 authors, yr::int as year, '10.' || reg || '/x' doi from pieces",
)


def jsn_01_works(spark, sf_dir):
    return corpus.work_records(spark, sf_dir).select("ref_id", works.mapped(F.col("record")).alias("w")).select("ref_id", "w.*")


_WORKS = (
    "select ref_id, a1 || ', ' || i1 || '.M., Perez, A.' autores, yr::int ano, 'Observations on the ' || seg || ' catch of stock ' || a1 || ' revisited' titulo_original, "
    f"{corpus.WORK_DOI} doi, "
    "case when ref_id % 4 = 0 then 'Journal of Marine Systems' end lugar_publicacion_entrega, 'Sea Press' publicista_editorial, "
    f"case when ref_id % 4 = 0 then '{P.ARTICLE}' else '{P.BOOK}' end tipo_documento, case when ref_id % 4 = 0 then 'Sí' end peer_reviewed, "
    f"'On catches' resumen_abstract, 'fish, ' || seg keywords from pieces"
)
_register(
    "jsn_01_works",
    lambda s, d: jsn_01_works(s, d).select("ref_id", "autores", "ano", "titulo_original", "doi", "lugar_publicacion_entrega", "publicista_editorial", "tipo_documento", "peer_reviewed", "resumen_abstract", "keywords"),
    _WITH + _WORKS,
)
_register(
    "jsn_09_llm",
    lambda s, d: corpus.pieces(s, d).select("ref_id", works.llm_fields(F.expr(
        "case ref_id % 4 when 0 then 'Here: {\"autores\": \"' || a1 || '\", \"doi\": null, \"keywords\": \"null\"} end' when 1 then 'There is none.' "
        "when 2 then '{\"autores\": \"\", \"keywords\": \"' || seg || '\"}' else '{\"autores\": broken' end"
    )).alias("m")).select("ref_id", F.try_element_at("m", F.lit("autores")).alias("autores"), F.try_element_at("m", F.lit("keywords")).alias("keywords")),
    _WITH + "select ref_id, case when ref_id % 4 = 0 then a1 end autores, case when ref_id % 4 = 2 then seg end keywords from pieces",
)
_register(
    "nrm_13_authors",
    lambda s, d: corpus.pieces(s, d).select("ref_id", normalize.authors(F.array(F.struct(F.lit("Ana Maria").alias("given"), F.col("a1").alias("family")), F.struct(F.lit("X").alias("given"), F.lit(None).cast("string").alias("family")))).alias("value")),
    _WITH + "select ref_id, a1 || ', A.M.' as value from pieces",
)

# --- enrichment ------------------------------------------------------------------------------------------------


def _enriched(spark, sf_dir, policy, by_title=False):
    mapped = jsn_01_works(spark, sf_dir).withColumnRenamed("ref_id", "place of work")
    return pipelines.enrich(ref_01_parse(spark, sf_dir), mapped, policy, by_title, order="place of work")


_DOIS = "(select ref_id, seg, a1, i1, yr, case when ref_id % 3 = 0 then '10.' || reg || '/jms.' || yr || '.' || p1 when ref_id % 3 = 1 then '10.' || reg || '/jms' || p2 end doi from pieces)"
_FIRST_WORK = f"(select doi, min(ref_id) w from {_DOIS} where {corpus.WORK_FILTER} group by 1)"
_register(
    "mrg_01_reference",
    lambda s, d: _enriched(s, d, "reference").select("ref_id", "doi", "enriched", "publicista_editorial", "keywords"),
    _WITH + f"select c.ref_id, c.doi, w.w is not null enriched, case when w.w is not null then 'Sea Press' end publicista_editorial, case when w.w is not null then 'fish, ' || p.seg end keywords from {_DOIS} c left join {_FIRST_WORK} w on c.doi = w.doi left join pieces p on p.ref_id = w.w",
)
_MERGED = (
    _WITH + f", merged as (select p.*, w.w, q.a1 wa, q.i1 wi, q.seg wseg, q.yr wyr from pieces p join {_DOIS} c using (ref_id) "
    f"left join {_FIRST_WORK} w on c.doi = w.doi left join pieces q on q.ref_id = w.w), "
    "m as (select ref_id, w, coalesce(wyr, yr)::int ano, "
    f"case when w is not null then 'Observations on the ' || wseg || ' catch of stock ' || wa || ' revisited' else {_TITLE} end titulo_original, "
    f"case when w is not null then wa || ', ' || wi || '.M., Perez, A.' else {_AUTHORS} end autores from merged) "
)
_ARTICLE_TYPE = f"'{P.ARTICLE}'"
#: A text reference takes its work's title and authors if its own are poor or shorter, its year if it is one off at most.
_MERGED_X = _MERGED.rstrip() + (
    f", x as (select ref_id, w, {_TITLE} own_title, {_AUTHORS} own_authors, yr::int own_year, 'Observations on the ' || wseg || ' catch of stock ' || wa || ' revisited' title, "
    "wa || ', ' || wi || '.M., Perez, A.' authors, wyr::int work_year from merged) "
)
_BY_TITLE_RULE = (
    "case when w is not null and (own_title is null or length(own_title) < 20 or length(own_title) - length(replace(own_title, ',', '')) > 3 "
    "or length(title) > length(own_title)) then title else own_title end"
)
_BY_AUTHORS_RULE = "case when w is not null and (own_authors is null or length(own_authors) < 10 or length(authors) > length(own_authors)) then authors else own_authors end"
_BY_YEAR_RULE = "case when w is not null and (own_year is null or abs(work_year - own_year) <= 1) then work_year else own_year end"
_register(
    "mrg_03_title",
    lambda s, d: _enriched(s, d, "reference", True).select("ref_id", "titulo_original", "autores", "ano"),
    _MERGED_X + f"select ref_id, {_BY_TITLE_RULE} titulo_original, {_BY_AUTHORS_RULE} autores, {_BY_YEAR_RULE} ano from x",
)
_register(
    "mrg_08_pdf_reference",
    lambda s, d: _enriched(s, d, "pdf_reference").select("ref_id", "ano", "titulo_original", "tipo_documento"),
    _MERGED + f"select ref_id, ano, titulo_original, case when ref_id % 5 in (0, 2) then {_ARTICLE_TYPE} end tipo_documento from m",
)
_register(
    "mrg_09_update",
    lambda s, d: _enriched(s, d, "update").select("ref_id", "ano", "titulo_original", "peer_reviewed"),
    _MERGED + "select ref_id, ano, titulo_original, case when w % 4 = 0 then 'Sí' end peer_reviewed from m",
)


def src_17_title_author(spark, sf_dir):
    """Works by title and author; half the records spell the author in another way."""
    p = corpus.pieces(spark, sf_dir)
    title = F.expr("'Observations on the ' || seg || ' catch of stock ' || a1")
    works = p.select(F.expr("'10.' || reg || '/' || lpad(cast(ref_id as string), 9, '0')").alias("doi"), title.alias("titulo_original"), F.expr("a1 || ', ' || i1 || '.'").alias("autores"))
    records = p.select("ref_id", F.upper(title).alias("titulo_original"), F.expr("a1 || ', ' || i1 || case when ref_id % 2 = 0 then '.' else '' end").alias("autores"))
    return merge.title_author_match(records, works)


_register(
    "src_17_title_author",
    src_17_title_author,
    _PIECES + "select ref_id, work_doi from pieces join (select seg, i1, min('10.' || reg || '/' || lpad(ref_id::varchar, 9, '0')) work_doi from pieces group by 1, 2) using (seg, i1)",
)


def mrg_10_document(spark, sf_dir):
    mapped = jsn_01_works(spark, sf_dir).withColumnRenamed("ref_id", "place of work")
    docs = corpus.citations(spark, sf_dir).select("ref_id", extract.doi(F.col("text")).alias("doi"), F.lit("own").alias("keywords"))
    return merge.merge_document(merge.with_work(docs, mapped, by_title=False, order="place of work")).select("ref_id", "doi", "keywords", "publicista_editorial")


_register(
    "mrg_10_document",
    mrg_10_document,
    _WITH + f"select c.ref_id, c.doi, case when w.w is not null then 'fish, ' || p.seg else 'own' end keywords, case when w.w is not null then 'Sea Press' end publicista_editorial from {_DOIS} c left join {_FIRST_WORK} w on c.doi = w.doi left join pieces p on p.ref_id = w.w",
)
_register(
    "mrg_20_filled",
    lambda s, d: ref_01_parse(s, d).select("ref_id", merge.filled_fields(["doi", "ano", "link", "paginas", "volumen_edicion"]).alias("n")),
    _WITH + "select ref_id, (2 + (ref_id % 3 <> 2)::int + (ref_id % 3 = 1)::int + (ref_id % 2 = 0)::int)::int n from pieces",
)

# --- relational -----------------------------------------------------------------------------------------------


def _store(spark, sf_dir):
    """A document table: numbers, authors, years."""
    return corpus.pieces(spark, sf_dir).select(
        F.col("ref_id").alias("id"), (F.col("ref_id") + 1).cast("int").alias("numero_doc"), F.expr("a1 || ', ' || i1 || '.'").alias("autores"), F.col("yr").cast("int").alias("ano")
    )


_STORE = "(select ref_id id, (ref_id + 1)::int numero_doc, a1 || ', ' || i1 || '.' autores, yr::int ano from pieces)"
_register("rel_01_scan", lambda s, d: _store(s, d).orderBy("numero_doc"), _WITH + f"select * from {_STORE}")
_register("rel_02_page", lambda s, d: relational.page(_store(s, d), 100, 50), _WITH + f"select * from {_STORE} order by id limit 50 offset 100")
_register("rel_03_by_id", lambda s, d: relational.by_key(_store(s, d), "id", 77), _WITH + f"select * from {_STORE} where id = 77")
_register("rel_06_largest", lambda s, d: relational.largest(_store(s, d)), _WITH + f"select max(numero_doc) numero_doc from {_STORE}")
_register(
    "rel_07_numbers",
    lambda s, d: relational.assign_numbers(corpus.pieces(s, d).select("ref_id"), _store(s, d), ["ref_id"]),
    _WITH + f"select ref_id, ((select max(numero_doc) from {_STORE}) + row_number() over (order by ref_id))::int numero_doc from pieces",
)
_register("rel_08_count", lambda s, d: relational.count_rows(documents=_store(s, d)), _WITH + f"select 'documents' as name, count(*) n from {_STORE}")
_register("rel_14_without_blank", lambda s, d: relational.without_blank(corpus.citations(s, d).select("ref_id", F.when(F.col("ref_id") % 2 == 0, " \n").otherwise(F.col("text")).alias("t")), "t"), _WITH + "select ref_id, t from cites where ref_id % 2 = 1")
_register("rel_15_partitioned", lambda s, d: relational.partitioned(_store(s, d), F.col("ano") > 1995)[1], _WITH + f"select * from {_STORE} where not ano > 1995")
_register(
    "rel_16_export",
    lambda s, d: relational.export_frame(_store(s, d)).toDF(*[f"c{i}" for i in range(len(EXPORT_NAMES))]),
    _WITH + "select " + ", ".join(f"{c if c in ('numero_doc', 'autores', 'ano') else 'null::varchar'} c{i}" for i, c in enumerate(EXPORT_NAMES)) + f" from {_STORE}",
)
_register("rel_17_aligned", lambda s, d: relational.aligned(_store(s, d)), _WITH + "select (ref_id + 1)::int numero_doc, a1 || ', ' || i1 || '.' autores, yr::int ano, " + ", ".join(f"null::varchar {n}" for n in DOCUMENT.fieldNames()[3:]) + " from pieces")
_register("snk_05_sheet", lambda s, d: sinks.sheet_frame(_store(s, d)).select(F.col("`N° doc`").alias("n"), F.col("`Autor(es)`").alias("a"), F.col("DOI").alias("d")), _WITH + f"select numero_doc n, autores a, '' d from {_STORE}")
_register(
    "snk_06_json",
    lambda s, d: sinks.json_objects(_store(s, d)),
    _WITH + "select '{\"numero_doc\":' || numero_doc || ',\"autores\":\"' || autores || '\",\"ano\":' || ano || '" + "".join(f',\"{n}\":null' for n in DOCUMENT.fieldNames()[3:]) + f"}}' as value from {_STORE}",
)
_register(
    "agg_01_batch_summary",
    lambda s, d: aggregate.batch_summary(corpus.citations(s, d), F.col("ref_id") % 7 != 0, F.col("ref_id") % 5 == 0, "cust"),
    _WITH + "select cust, count(*) total, count(*) filter (ref_id % 7 <> 0 and ref_id % 5 <> 0) processed, count(*) filter (ref_id % 7 = 0 and ref_id % 5 <> 0) failed from cites group by 1",
)
_register(
    "agg_02_errors",
    lambda s, d: aggregate.error_counts(corpus.citations(s, d).withColumn("error", F.when(F.col("ref_id") % 7 == 0, "bad")), "error", "cust"),
    _WITH + "select cust, 'bad' error, count(*) n from cites where ref_id % 7 = 0 group by 1",
)
_register("agg_04_ratio", lambda s, d: corpus.citations(s, d).groupBy("cust").agg(aggregate.ratio(F.col("ref_id") % 2 == 0)), _WITH + "select cust, avg((ref_id % 2 = 0)::int) ratio from cites group by 1")

# --- rules of headers, models and whole reference jobs --------------------------------------------------


def mrg_14_header(spark, sf_dir):
    """TEI headers over extractions, each with fields missing in turn."""
    df = corpus.pieces(spark, sf_dir).select(
        "ref_id",
        F.expr("'Own ' || seg").alias("titulo_original"),
        F.expr("case when ref_id % 5 <> 0 then a1 end").alias("autores"),
        F.expr("case when ref_id % 2 = 0 then 'Own abstract' end").alias("resumen_abstract"),
        F.expr("case when ref_id % 3 = 0 then '10.1/own' end").alias("doi"),
        F.expr("case when ref_id % 7 <> 0 then cast(yr as int) end").alias("ano"),
        F.expr(
            "named_struct('title', case when ref_id % 2 = 0 then '  Head  ' || seg end, 'authors', case when ref_id % 3 = 0 then '' else 'Perez, ' || i2 end, "
            "'year', 1900, 'doi', '10.2/head', 'abstract', case when ref_id % 4 = 0 then '#_#x0048ead   abstract ' end)"
        ).alias("header"),
    )
    return merge.merge_header(df).drop("header")


_register(
    "mrg_14_header",
    mrg_14_header,
    _PIECES + "select ref_id, case when ref_id % 2 = 0 then 'Head ' || seg else 'Own ' || seg end titulo_original, "
    "case when ref_id % 3 <> 0 then 'Perez, ' || i2 when ref_id % 5 <> 0 then a1 end autores, "
    "case when ref_id % 4 = 0 then 'Head abstract' when ref_id % 2 = 0 then 'Own abstract' end resumen_abstract, "
    "case when ref_id % 3 = 0 then '10.1/own' else '10.2/head' end doi, case when ref_id % 7 <> 0 then yr::int else 1900 end ano from pieces",
)


def _with_model(spark, sf_dir):
    """Extractions and a model's answers: longer, shorter, missing, not numbers."""
    return corpus.pieces(spark, sf_dir).select(
        "ref_id",
        F.expr("case ref_id % 5 when 0 then null when 1 then 'ab' else 'A title of the ' || seg end").alias("titulo_original"),
        F.expr("case when ref_id % 2 = 0 then a1 end").alias("autores"),
        F.expr("case when ref_id % 3 = 0 then 1990 end").alias("ano"),
        F.expr("case when ref_id % 3 = 1 then '10.1/own' end").alias("doi"),
        F.expr("'own type'").alias("tipo_documento"),
        F.expr(f"case ref_id % 3 when 0 then '{P.THESIS}' when 1 then '{P.BOOK}' else '{P.ARTICLE}' end").alias("kind"),
        F.expr(
            "case when ref_id % 4 = 3 then cast(map() as map<string,string>) else map('titulo_original', 'A title of the ' || seg || "
            "case when ref_id % 2 = 0 then ' with many more words' else '' end, 'autores', 'Perez, ' || i2, 'ano', case when ref_id % 4 = 1 then 'unknown' else yr end, 'doi', '10.2/model') end"
        ).alias("llm"),
    )


_FIELDS = ["titulo_original", "autores", "ano"]
_MODEL = (
    _PIECES + ", x as (select *, case ref_id % 5 when 0 then null when 1 then 'ab' else 'A title of the ' || seg end own_title, "
    "case when ref_id % 2 = 0 then a1 end own_authors, case when ref_id % 3 = 0 then 1990 end own_year, ref_id % 4 <> 3 there, "
    "case when ref_id % 4 <> 3 then 'A title of the ' || seg || case when ref_id % 2 = 0 then ' with many more words' else '' end end title, "
    "case when ref_id % 4 <> 3 then 'Perez, ' || i2 end authors, case when ref_id % 4 in (0, 2) then yr::int end model_year from pieces) "
)
_register(
    "mrg_15_llm_exclusive",
    lambda s, d: merge.llm_exclusive(_with_model(s, d), "llm", "doi", "kind", {P.THESIS: True, P.BOOK: True}, _FIELDS).select("ref_id", *_FIELDS, "doi", "tipo_documento", "by_llm"),
    _MODEL + ", y as (select *, there and ref_id % 3 in (0, 1) by_llm from x) select ref_id, case when by_llm then title else own_title end titulo_original, "
    "case when by_llm then authors else own_authors end autores, case when by_llm then model_year else own_year end ano, "
    "case when by_llm and ref_id % 3 <> 1 then '10.2/model' when ref_id % 3 = 1 then '10.1/own' end doi, "
    f"case when by_llm then case ref_id % 3 when 0 then '{P.THESIS}' else '{P.BOOK}' end else 'own type' end tipo_documento, by_llm from y",
)
_register(
    "mrg_16_llm_complement",
    lambda s, d: merge.llm_complement(_with_model(s, d), "llm", F.when(F.col("ref_id") % 11 == 0, 1950), _FIELDS).select("ref_id", *_FIELDS),
    _MODEL + "select ref_id, coalesce(own_title, title) titulo_original, coalesce(own_authors, authors) autores, "
    "(case when model_year is null then own_year when own_year is null then model_year when ref_id % 11 = 0 then 1950 else model_year end)::int ano from x",
)


def str_07_references(spark, sf_dir):
    """Documents of references to records: split, parsed, those without title and authors gone."""
    c = corpus.pieces(spark, sf_dir).select("ref_id", F.expr("(ref_id div 100) * 4 + ref_id % 4").alias("doc"), F.expr(_YEAR_FIRST).alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref_id", "text"))), lambda s: rx.strip(s["text"])), " ")
    blobs = c.groupBy("doc").agg(F.concat(F.lit("Words before. REFERENCES "), joined, F.lit(" FUNDING none")).alias("text"))
    found = pipelines.references_of_documents(blobs, "doc", "text", AS_OF, compat=False)
    return found.select("doc", F.col("pos").cast("int").alias("pos"), "ano", "paginas", "autores")


_register(
    "str_07_references",
    str_07_references,
    _PIECES + f"select (ref_id // 100) * 4 + ref_id % 4 doc, (row_number() over (partition by (ref_id // 100) * 4 + ref_id % 4 order by ref_id) - 1)::int pos, yr::int ano, p1 || '-' || p2 paginas, {_AUTHORS} autores from pieces",
)
_constructed("ref_05_journal", lambda c: citation.journal(c, citation.title(c)), "case when ref_id % 5 in (0, 2) then 'J. Mar. Syst' end")


def jsn_03_container(spark, sf_dir):
    """Volume, issue, page, ISBN or ISSN and open access of records, stated or not."""
    record = F.expr(
        "to_json(named_struct('volume', case when ref_id % 2 = 0 then p1 end, 'issue', case when ref_id % 3 = 0 then p2 end, 'page', p1 || '-' || p2, "
        "'container-title', case when ref_id % 5 <> 0 then array('Sea  News', 'Other') end, 'ISBN', case when ref_id % 4 = 0 then array('978-' || reg, '2') end, "
        "'ISSN', case when ref_id % 2 = 0 then array('0717-' || reg) end, 'license', case ref_id % 3 when 0 then array(named_struct('URL', 'http://x')) when 1 then cast(array() as array<struct<URL:string>>) end))"
    )
    records = corpus.pieces(spark, sf_dir).select("ref_id", record.alias("record"))  # written once, not for each field
    return records.select("ref_id", works.mapped(F.col("record")).alias("w")).select(
        "ref_id", "w.volumen_edicion", "w.numero_articulo_capitulo_informe", "w.paginas", "w.isbn_issn", "w.acceso_abierto", "w.lugar_publicacion_entrega", "w.tipo_documento", "w.peer_reviewed"
    )


_register(
    "jsn_03_container",
    jsn_03_container,
    _PIECES + "select ref_id, case when ref_id % 2 = 0 then p1 end volumen_edicion, case when ref_id % 3 = 0 then p2 end numero_articulo_capitulo_informe, p1 || '-' || p2 paginas, "
    "case when ref_id % 4 = 0 then '978-' || reg when ref_id % 2 = 0 then '0717-' || reg end isbn_issn, case when ref_id % 3 = 0 then 'Sí' end acceso_abierto, "
    f"case when ref_id % 5 <> 0 then 'Sea News' end lugar_publicacion_entrega, case when ref_id % 5 <> 0 then '{P.ARTICLE}' end tipo_documento, case when ref_id % 5 <> 0 then 'Sí' end peer_reviewed from pieces",
)

# --- jobs --------------------------------------------------------------------------------------------------------


def _events(spark, sf_dir):
    """Four events of every user's job, from the events table."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    steps = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(s).alias("status")) for n, s in enumerate(("pending", "processing", "analyzing", "completed"))])
    rows = e.groupBy("user_id").agg(F.min("ts").alias("ts")).select("user_id", "ts", F.explode(steps).alias("x"))
    status = F.when((F.col("x.n") == 3) & (F.col("user_id") % 5 == 0), "failed").otherwise(F.col("x.status"))
    return rows.select(
        F.col("user_id").cast("string").alias("job_id"),
        (F.col("ts") + F.make_interval(secs=F.col("x.n"))).alias("event_time"),
        status.alias("status"),
        F.when(F.col("x.n") == 2, 55).cast("int").alias("progress"),
        F.when(status == "failed", "broken").alias("error"),
        F.when(status == "completed", F.col("user_id").cast("int")).alias("document_id"),
    )


_JOBS = (
    "select user_id::varchar job_id, case when user_id % 5 = 0 then 'failed' else 'completed' end status, case when user_id % 5 = 0 then 0 else 100 end progress, "
    "min(ts) + interval 1 second started_at, min(ts) + interval 3 second completed_at, case when user_id % 5 = 0 then 'broken' end error, case when user_id % 5 <> 0 then user_id::int end document_id from events group by user_id"
)
_register("str_02_job_table", lambda s, d: jobs.job_table(_events(s, d)), _JOBS)
_register(
    "str_09_job_status",
    lambda s, d: jobs.job_status(jobs.job_table(_events(s, d))).select("job_id", "message"),
    f"select job_id, case when status = 'failed' then 'Error: broken' else 'Procesamiento completado' end message from ({_JOBS})",
)
_register(
    "str_04_progress",
    lambda s, d: corpus.citations(s, d).select("ref_id", jobs.reference_progress(F.col("ref_id") % 10, F.lit(10)).alias("progress")),
    _WITH + "select ref_id, (30 + 60 * (ref_id % 10) // 10)::int progress from cites",
)
_register(
    "str_08_dead_letters",
    lambda s, d: jobs.routed(corpus.citations(s, d).select(F.col("cust").cast("string").alias("job_id"), (F.col("ref_id") % 4).cast("int").alias("attempt"), F.col("ref_id").cast("string").alias("file_key"), F.lit("f").alias("filename")))[1].select("job_id", "attempt"),
    _WITH + "select cust::varchar job_id, max(ref_id % 4)::int attempt from cites group by 1 having max(ref_id % 4) >= 3",
)
_register(
    "rel_05_job_documents",
    lambda s, d: relational.job_documents(jobs.job_table(_events(s, d)), _store(s, d)).select("job_id", "doc_numero_doc", "doc_ano"),
    _WITH + f"select job_id, numero_doc doc_numero_doc, ano doc_ano from ({_JOBS}) j left join {_STORE} s on j.document_id = s.numero_doc",
)


def queries() -> dict[str, Query]:
    return QUERIES | rules.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | rules.SQL
