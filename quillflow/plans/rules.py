"""Queries on the rules of merging and reading, over all their fields and cases.

Values and cases are made from the derived pieces by SQL that both engines run; what must come
out is stated by cases for each rule, not by the operator's expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fulltext, tei, works
from ..functions import patterns as P
from ..operators import merge, search
from ..sources import corpus
from ..sources.shared import new_path, spread
from ..streaming import keyed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_FROM = f" from ({corpus.PIECES})"

TEXT_FIELDS = [f for f in works.fields if f != "ano"]


def _register(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def _pieces(spark: SparkSession, sf_dir: str, **columns: str | Column) -> DataFrame:
    made = [(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]
    return corpus.pieces(spark, sf_dir).select("ref_id", *made)


def _value(said: str, field: str, cases: int, shift: int) -> str:
    """A text of a record in turn missing, empty, two letters, plain, longer, far longer."""
    return (
        f"case (ref_id + {shift}) % {cases} when 0 then null when 1 then '' when 2 then '{said[0]}{field[0]}' when 3 then '{said} {field} ' || seg "
        f"when 4 then '{said} {field} of the ' || seg else '{said} {field} of the ' || seg || ' in all its longer parts' end"
    )


def _there(c: str) -> str:
    return f"({c}) is not null and ({c}) <> ''"


# --- a work over a record: what each policy takes from it --------------------------------------

_OWN = {f: _value("own", f, 7, i) for i, f in enumerate(TEXT_FIELDS)}
_WORK = {f: _value("ext", f, 6, 2 * i) for i, f in enumerate(TEXT_FIELDS)}
_OWN_YEAR, _WORK_YEAR = "case when ref_id % 7 <> 0 then cast(yr as int) end", "case when ref_id % 5 <> 0 then cast(yr as int) + cast(ref_id % 3 as int) end"
_MATCHED = "ref_id % 8 <> 0"


def _with_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all fields with a work of all fields, or with none."""
    work = F.struct(*[F.expr(_WORK_YEAR if f == "ano" else _WORK[f]).alias(f) for f in works.fields])
    own = {f: _OWN_YEAR if f == "ano" else _OWN[f] for f in works.fields}
    return _pieces(spark, sf_dir, **own, work=F.when(F.expr(_MATCHED), work))


def _by_field(rule: Callable[[str, str, str], str]) -> str:
    """``rule(field, own, external)`` of every field, as one select."""
    parts = [rule(f, _OWN_YEAR if f == "ano" else _OWN[f], _WORK_YEAR if f == "ano" else _WORK[f]) for f in works.fields]
    return "select ref_id, " + ", ".join(f"{p} as {f}" for f, p in zip(works.fields, parts)) + _FROM


def _external_first(own: str, external: str) -> str:
    return f"case when {_MATCHED} and {_there(external)} then {external} else {own} end"


def _longer_title(own: str, external: str, least: int, commas: bool) -> str:
    poor = f"({own}) is null or ({own}) = '' or length({own}) < {least}"
    if commas:
        poor += f" or length({own}) - length(replace({own}, ',', '')) > 3"
    return f"case when {_MATCHED} and {_there(external)} and ({poor} or length({external}) > length({own})) then {external} else {own} end"


#: The nine fields that a reference of a PDF takes from its work.
_NINE = ["lugar_publicacion_entrega", "publicista_editorial", "volumen_edicion", "isbn_issn", "link", "peer_reviewed", "acceso_abierto", "resumen_abstract", "keywords"]


def _pdf_rule(field: str, own: str, external: str) -> str:
    if field == "ano":
        return f"case when {_MATCHED} and {external} is not null then {external} else {own} end"
    if field == "titulo_original":
        return _longer_title(own, external, 20, True)
    if field == "autores":
        return _longer_title(own, external, 10, False)
    return _external_first(own, external) if field in _NINE else own


_register("mrg_08_all_fields", lambda s, d: merge.merge_pdf_reference(_with_work(s, d)).drop("work", "enriched"), _by_field(_pdf_rule))


def _document_rule(keep_doi: bool) -> Callable[[str, str, str], str]:
    def rule(field: str, own: str, external: str) -> str:
        if field == "doi" and keep_doi:
            return f"case when {_there(own)} then {own} when {_MATCHED} then {external} else {own} end"
        if field in ("doi", "resumen_abstract", "keywords"):
            return _external_first(own, external)
        return f"case when {_MATCHED} then {external} else {own} end"

    return rule


_register("mrg_10_all_fields", lambda s, d: merge.merge_document(_with_work(s, d)).drop("work"), _by_field(_document_rule(False)))
_register("mrg_11_doi_kept", lambda s, d: merge.merge_document(_with_work(s, d), keep_extracted_doi=True).drop("work"), _by_field(_document_rule(True)))
_NAMED = f"{_MATCHED} and {_there(_WORK['autores'])}"
_register(
    "mrg_12_by_title",
    lambda s, d: merge.merge_document(_with_work(s, d), by_doi=False).drop("work"),
    _by_field(
        lambda f, own, external: f"case when {_NAMED} then {external} else {own} end"
        if f == "autores"
        else f"case when {_NAMED} and {_there(external)} then {external} else {own} end"
        if f == "doi"
        else own
    ),
)

# --- a model's answer beside an extraction ----------------------------------------------------------

_CORRECTED = ["lugar_publicacion_entrega", "volumen_edicion", "paginas", "keywords", "tipo_documento"]
_FILLED = ["titulo_original", "autores", "doi", "publicista_editorial", "isbn_issn"]
_WORDS = "'The catch of ' || seg || ' was compared over several seasons in the same waters"
_ABSTRACTS = [
    "null",
    "''",
    _WORDS + ".'",
    _WORDS + " and in two of the neighbouring stocks over the years.'",
    _WORDS + ", see http://www.example.org for more.'",
    "'Too few words.'",
    "repeat('catch ' || seg || ' ', 500)",
]


def _one_of(values: list[str], shift: int) -> str:
    cases = " ".join(f"when {i} then {v}" for i, v in enumerate(values))
    return f"case (ref_id + {shift}) % {len(values)} {cases} end"


_OWN_ABSTRACT, _MODEL_ABSTRACT = _one_of(_ABSTRACTS[:6], 0), _one_of(_ABSTRACTS, 0)
_SAID_YEAR = "case ref_id % 4 when 0 then 'unknown' when 1 then null else yr end"
_EARLIER = "case when ref_id % 3 = 0 then 1990 end"
_HEAD = "case when ref_id % 11 = 0 then 1950 end"
_MODEL = {f: _value("the model's".replace("'", ""), f, 6, i) for i, f in enumerate([*_CORRECTED, *_FILLED])}


def mrg_17_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [*_CORRECTED, *_FILLED, "resumen_abstract", "ano"]
    said = _MODEL | {"resumen_abstract": _MODEL_ABSTRACT, "ano": _SAID_YEAR}
    own = {f: _OWN.get(f) for f in fields} | {"resumen_abstract": _OWN_ABSTRACT, "ano": _EARLIER}
    answer = F.create_map(*[c for f in fields for c in (F.lit(f), F.expr(said[f]))])
    df = _pieces(spark, sf_dir, **own, llm=answer, head=_HEAD)
    return merge.llm_complement(df, "llm", F.col("head"), fields).drop("llm", "head")


def _complement_sql() -> str:
    def case(own: str, said: str, both: str) -> str:
        return f"case when not ({_there(said)}) then {own} when not ({_there(own)}) then {said} {both} else {own} end"

    parts = {}
    for f in _CORRECTED:
        own, said = _OWN[f], _MODEL[f]
        longer = f"length({said}) > length({own}) * 1.2::double"
        shorter = f"length({own}) > length({said}) * 1.2::double"
        parts[f] = case(own, said, f"when {longer} then {said} when {shorter} then {own} when length({own}) < 3 then {said}")
    for f in _FILLED:
        parts[f] = case(_OWN[f], _MODEL[f], "")
    own, said = _OWN_ABSTRACT, _MODEL_ABSTRACT
    valid = lambda c: f"(not contains({c}, 'http') and len(string_split({c}, ' ')) >= 10)"
    # A long abstract is cut at its last space before 5,000, which is in the last tenth here.
    start = f"substr({said}, 1, 5000)"
    cut = f"(case when length({said}) > 5000 then substr({said}, 1, 5000 - strpos(reverse({start}), ' ')) || '{P.TRUNCATED}' else {said} end)"
    better = f"when {valid(said)} and (not {valid(own)} or length({cut}) > length({own}) * 1.1::double) then {cut}"
    parts["resumen_abstract"] = case(own, said, better)
    year = f"try_cast({_SAID_YEAR} as int)"
    parts["ano"] = f"case when {year} is null then {_EARLIER} when {_EARLIER} is null then {year} else coalesce({_HEAD}, {year}) end"
    return "select ref_id, " + ", ".join(f"{v} as {k}" for k, v in parts.items()) + _FROM


_register("mrg_17_complement", mrg_17_complement, _complement_sql())

# --- TEI ---------------------------------------------------------------------------------------------

#: Each shape: (analytic part, monograph part, behind it, what comes out by field).
_NS = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><biblStruct>'
_AUTHOR = "<author><persName><forename>{a1}</forename><surname>{i1}son</surname></persName></author>"
_SHAPES = [
    (
        '<title level="a">On {seg}</title>' + _AUTHOR,
        '<title level="m">No</title><title level="j"> J. of {seg} </title><imprint><date when="{yr}-01-02"/><biblScope unit="volume">{p1}</biblScope><biblScope unit="page">3</biblScope><biblScope unit="page"> 9</biblScope></imprint>',
        '<idno type="DOI"> 10.1/{p1}</idno>',
        {"authors": "{i1}son, {a1}", "year": "{yr}", "title": "On {seg}", "journal": "J. of {seg}", "volume": "{p1}", "pages": "3-9", "doi": "10.1/{p1}"},
    ),
    (  # a chapter: the book is its journal; pages by attributes only are none
        '<title level="a">Part on {seg}</title><author><persName><surname>{a1}</surname></persName></author><author><orgName>Club</orgName></author>' + _AUTHOR,
        '<title level="m">The book of {seg}</title><imprint><biblScope unit="page" from="{p1}" to="{p2}"/><date>{yr}</date></imprint>',
        "",
        {"authors": "{a1}, {i1}son, {a1}", "year": "{yr}", "title": "Part on {seg}", "journal": "The book of {seg}"},
    ),
    (  # a book: its title is both
        "",
        '<title level="m">The book of {a1}</title><imprint><biblScope unit="page">{p1}-{p2}</biblScope></imprint>',
        '<idno type="ISSN">1</idno>',
        {"title": "The book of {a1}", "journal": "The book of {a1}", "pages": "{p1}-{p2}"},
    ),
    (  # the first date alone counts; scopes outside the monograph don't
        '<title level="a">Late {seg}</title>',
        '<title level="j"/><title level="m">Not this</title><imprint><date type="x">in press</date><date when="{yr}"/></imprint>',
        '<biblScope unit="volume">7</biblScope><biblScope unit="page">8</biblScope>',
        {"title": "Late {seg}"},
    ),
    (  # no text before a child is no title; no monograph is no journal
        '<title level="a"><hi>Bold</hi> words</title><title level="j">Outside</title>' + _AUTHOR,
        None,
        "",
        {"authors": "{i1}son, {a1}"},
    ),
    (  # a title that begins with text ends at its first child
        '<title>Half <hi>bold</hi></title><author><persName><forename>Only</forename></persName></author>',
        '<imprint><date when="{yr}"/><biblScope unit="volume"> </biblScope></imprint>',
        "",
        {"title": "Half", "year": "{yr}"},
    ),
]
_PARTS = ("a1", "i1", "seg", "yr", "p1", "p2")


def _filled(template: str) -> str:
    """A template's text as a SQL expression over the pieces."""
    text = "'" + template.replace("'", "''") + "'"
    for part in _PARTS:
        text = text.replace("{" + part + "}", f"' || {part} || '")
    return text


def _shape(shape: tuple) -> str:
    analytic, monograph, behind, _ = shape
    body = f"<analytic>{analytic}</analytic>" if analytic else ""
    body += f"<monogr>{monograph}</monogr>" if monograph is not None else ""
    return _filled(f"{_NS}{body}{behind}</biblStruct></TEI>")


_TEI_FIELDS = ["authors", "year", "title", "journal", "volume", "pages", "doi"]


def _expected(field: str) -> str:
    values = [_filled(s[3][field]) if field in s[3] else "null" for s in _SHAPES]
    chosen = _one_of(values, 0)
    return f"cast({chosen} as int)" if field == "year" else chosen


_register(
    "xml_02_structured",
    lambda s, d: _pieces(s, d, r=F.get(tei.references(F.expr(_one_of([_shape(x) for x in _SHAPES], 0))), F.lit(0))).select("ref_id", *[F.col(f"r.{f}") for f in _TEI_FIELDS]),
    "select ref_id, " + ", ".join(f'{_expected(f)} as "{f}"' for f in _TEI_FIELDS) + _FROM,
)

# --- works ----------------------------------------------------------------------------------------------

_RECORDS = [
    ('{"abstract": "<jats:p>On  {seg}</jats:p> #xE9 ", "subject": ["a  b", "{seg}"]}', "On {seg} é", "a b, {seg}"),
    ('{"abstract": {"value": " By {a1} ", "text": "no"}, "subject": []}', "By {a1}", None),
    ('{"abstract": {"value": "", "text": "<p>Text of {a1}</p>"}}', "Text of {a1}", None),
    ('{"abstracts": [{"value": "List of {seg}"}, {"value": "no"}], "subject": "x"}', "List of {seg}", None),
    ('{"abstract": "", "abstracts": [{"value": "unused"}]}', None, None),
    ('{"abstract": "<p> </p>", "subject": ["{a1}"]}', None, "{a1}"),
]
_register(
    "jsn_07_abstracts",
    lambda s, d: _pieces(s, d, r=_one_of([_filled(r[0]) for r in _RECORDS], 0)).select("ref_id", works.abstract(F.col("r")).alias("resumen_abstract"), works.keywords(F.col("r")).alias("keywords")),
    "select ref_id, " + ", ".join(f"{_one_of([_filled(r[i]) if r[i] else 'null' for r in _RECORDS], 0)} as {n}" for i, n in ((1, "resumen_abstract"), (2, "keywords"))) + _FROM,
)
_TYPES = ["journal-article", "book-chapter", "book", "report", "dissertation", "proceedings-article", "dataset", "monograph"]
_register(
    "jsn_05_types",
    lambda s, d: _pieces(s, d, r=_one_of([f"'{{\"type\": \"{t}\"}}'" for t in _TYPES] + ["'{\"container-title\": \"J\"}'", "'{\"type\": null}'"], 0)).select(
        "ref_id", works.kind(F.col("r")).alias("tipo_documento"), works.peer_reviewed(F.col("r")).alias("peer_reviewed")
    ),
    "select ref_id, "
    + _one_of(["'Artículo en revista científica'", "'Capítulo de libro'", "'Libro'", "'Informe técnico'", "'Tesis'", "'Artículo en actas'", "'Conjunto de datos'", "'Otro'", "'Artículo en revista científica'", "null"], 0)
    + " as tipo_documento, case when ref_id % 10 in (0, 8) then 'Sí' end as peer_reviewed" + _FROM,
)

# --- titles ---------------------------------------------------------------------------------------------

_META = "case ref_id % 4 when 0 then null when 1 then 'Untitled' when 2 then '10 letters' else 'Stated title of ' || seg end"
#: Without a stated title the running head is long enough to be one, and the title goes on in it.
_PAGE_TITLE = (
    "'Invest. Mar., Valpara' || chr(237) || 'so, ' || cast(ref_id % 97 + 1 as varchar) || ': ' || p1 || '-' || p2 || ', ' || yr "
    "|| ' Observations on the ' || seg || ' catch of stock ' || a1 || ' in coastal waters'"
)
_register(
    "src_13_meta_title",
    lambda s, d: _pieces(s, d, value=fulltext.title(F.expr(_META), F.expr(corpus.ARTICLE))),
    f"select ref_id, case when ref_id % 4 = 3 then {_META} else {_PAGE_TITLE} end as value" + _FROM,
)


# --- search by title and authors --------------------------------------------------------------------

#: A work of each part, and a record that asks for it: as it stands, in another order, cut, misspelt.
_WORK_TITLE = "'Catalogue of the ' || p_name || ' in ' || lower(p_type) || ' make, size s' || p_size || ', lot k' || (p_partkey % 997)"
_WORK_AUTHORS = "'Maker' || substr(p_brand, 7) || ', B., Perez' || (p_partkey % 7) || ', A.'"
_ASKED_TITLE = (
    f"case p_partkey % 5 when 0 then upper({_WORK_TITLE}) when 1 then 'Lot k' || (p_partkey % 997) || '; ' || lower(p_type) || ' make (' || p_name || '): catalogue' "
    "when 2 then 'The ' || p_name || ' in ' || lower(p_type) when 3 then 'Catalogue of the ' || p_name || 'x in ' || lower(p_type) || ' make, size s' || p_size "
    "else 'Something else about ' || p_name || ' altogether' end"
)
_ASKED_AUTHORS = "case when p_partkey % 4 = 0 then null else 'Maker' || substr(p_brand, 7) end"


def src_17_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet"))
    records = part.selectExpr("p_partkey", f"{_ASKED_TITLE} as titulo_original", f"{_ASKED_AUTHORS} as autores")
    held = part.selectExpr("'10.5/' || lpad(cast(p_partkey as string), 9, '0') as doi", f"{_WORK_TITLE} as titulo_original", f"{_WORK_AUTHORS} as autores")
    return search.search_works(records, held, hot=100).select("p_partkey", "work_doi", "score", "mass")


def _terms_sql(title: str, authors: str) -> str:
    words = lambda c: f"list_filter(regexp_split_to_array(lower(substr(coalesce({c}, ''), 1, 200)), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return (
        f"list_sort(list_distinct(list_transform({words(title)}, lambda w: 't' || w) || "
        f"list_transform(list_filter({words(authors)}, lambda w: length(w) > 1), lambda w: 'a' || w)))"
    )


_register(
    "src_17_search",
    src_17_search,
    f"""
with w as (select terms, min(doi) doi from (
  select {_terms_sql(_WORK_TITLE, _WORK_AUTHORS)} terms, '10.5/' || lpad(p_partkey::varchar, 9, '0') doi from part) group by 1),
q as (select p_partkey, {_terms_sql(_ASKED_TITLE, _ASKED_AUTHORS)} terms from part),
df as (select term, count(*) n from (select unnest(terms) term from w) group by 1),
weight as (
  select term, floor(case when starts_with(term, 'a') then 500 else 1000 end * ln(1 + (select count(*) from w)::double / greatest(coalesce(n, 1), 1)))::bigint g
  from (select distinct unnest(terms) term from q union select unnest(terms) from w) left join df using (term)),
wm as (select doi, terms, sum(g)::bigint m from (select doi, terms, unnest(terms) term from w) join weight using (term) group by 1, 2),
qs as (select terms, sum(g)::bigint mass from (select terms, unnest(terms) term from (select distinct terms from q)) join weight using (term) group by 1),
pairs as (
  select a.terms, b.doi, b.wterms, sum(g)::bigint score
  from (select terms, unnest(terms) term from qs) a join (select doi, terms wterms, unnest(terms) term from w) b using (term) join weight using (term) group by 1, 2, 3),
best as (
  select p.terms, p.doi, score, mass, row_number() over (partition by p.terms order by score desc, wm.m, p.doi) k
  from pairs p join qs on p.terms = qs.terms join wm on wm.doi = p.doi and wm.terms = p.wterms where 100 * score >= 50 * mass)
select p_partkey, doi work_doi, score, mass from q left join best on q.terms = best.terms and k = 1
""",
)


# --- job states of a stream -----------------------------------------------------------------------

#: Every event as one of its user's job, in no order of states.
_JOB_EVENTS = [
    "cast(user_id as string) as job_id",
    "ts as event_time",
    "case event_id % 5 when 0 then 'pending' when 1 then 'processing' when 2 then 'analyzing' when 3 then 'completed' else 'failed' end as status",
    "case when event_id % 3 = 0 then cast(event_id % 90 as int) end as progress",
    "case when event_id % 5 = 4 and event_id % 2 = 0 then 'broken ' || event_id end as error",
    "case when event_id % 5 = 3 then cast(event_id as int) end as document_id",
]


def str_03_stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, and the last state of each job that the stream gave."""
    path = f"{sf_dir}/events.parquet"
    stored = f"{sf_dir}/events.parque[t]"  # a stream takes a single file only by a pattern
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(stored).selectExpr(*_JOB_EVENTS)
    out = new_path(spark, "job-states")
    stream = keyed.job_states(events, kept_s=3650 * keyed.DAY, stalled_s=3650 * keyed.DAY)

    def batch(df: DataFrame, number: int) -> None:
        df.where("not gone").drop("gone").write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", new_path(spark, "job-states")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(out)
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in ("job_id", "batch")]), "batch")
    states = rows.groupBy("job_id").agg(last.alias("s")).select("job_id", "s.*")
    return states.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "completed_at")})


_register(
    "str_03_stream_states",
    str_03_stream_states,
    f"""
with e as (select *, {", ".join(_JOB_EVENTS)}, event_id % 5 + 1 n,
    case when event_id % 3 = 0 then event_id % 90 else -1 end p from events),
o as (select *, case status when 'completed' then 100 when 'failed' then 0 when 'processing' then coalesce(progress, 10)
    when 'analyzing' then coalesce(progress, 40) else coalesce(progress, 0) end shown,
    row_number() over (partition by job_id order by event_time desc, n desc, p desc) k,
    row_number() over (partition by job_id, error is null order by event_time desc, n desc, p desc) ke,
    row_number() over (partition by job_id, document_id is null order by event_time desc, n desc, p desc) kd from e)
select job_id, max(status) filter (k = 1) status, max(shown) filter (k = 1)::int progress,
  coalesce(max(event_time) filter (status = 'processing'), min(event_time) filter (status = 'analyzing')) started_at,
  max(event_time) filter (status in ('completed', 'failed')) completed_at,
  max(error) filter (ke = 1) error, max(document_id) filter (kd = 1)::int document_id
from o group by 1
""",
)
