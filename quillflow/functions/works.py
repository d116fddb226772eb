"""Records of an external metadata service, as JSON text, to bibliographic fields.

Fields that may be a string or a list are read as JSON and take their first element; a record
that can't be read gives nulls. ``fields`` lists what ``mapped`` returns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import normalize, rx
from . import patterns as P

PEOPLE = "array<struct<given string, family string>>"
fields = [
    "autores",
    "ano",
    "titulo_original",
    "doi",
    "link",
    "lugar_publicacion_entrega",
    "publicista_editorial",
    "volumen_edicion",
    "numero_articulo_capitulo_informe",
    "paginas",
    "isbn_issn",
    "idioma",
    "tipo_documento",
    "peer_reviewed",
    "acceso_abierto",
    "resumen_abstract",
    "keywords",
]


def _get(record: Column, path: str) -> Column:
    return rx.empty_to_null(F.get_json_object(record, path))


def _one(record: Column, name: str) -> Column:
    """A string, or the first element of a list."""
    def one(whole: Column) -> Column:
        return F.when(whole.startswith("["), F.get(F.from_json(whole, "array<string>"), F.lit(0))).otherwise(whole)

    return rx.let(_get(record, f"$.{name}"), one)


def authors(record: Column) -> Column:
    return normalize.authors(F.from_json(_get(record, "$.author"), PEOPLE))


def year(record: Column) -> Column:
    part = lambda kind: _get(record, f"$['published-{kind}']['date-parts'][0][0]").try_cast("int")
    return F.coalesce(part("print"), part("online"))


def title(record: Column) -> Column:
    return normalize.accents(normalize.text(_one(record, "title")))


def link(record: Column) -> Column:
    return F.coalesce(_get(record, "$.URL"), F.concat(F.lit("https://doi.org/"), _get(record, "$.DOI")))


def container(record: Column) -> Column:
    return normalize.text(_one(record, "container-title"))


def isbn_issn(record: Column) -> Column:
    return F.coalesce(_one(record, "ISBN"), _one(record, "ISSN"))


def kind(record: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in P.WORK_TYPES.items() for x in pair])
    return rx.let(
        _get(record, "$.type"),
        lambda stated: F.when(stated.isNotNull(), F.coalesce(F.try_element_at(known, stated), F.lit("Otro"))).when(
            _one(record, "container-title").isNotNull(), P.ARTICLE
        ),
    )


def peer_reviewed(record: Column) -> Column:
    return rx.let(
        _get(record, "$.type"),
        lambda stated: F.when((stated == "journal-article") | (stated.isNull() & _one(record, "container-title").isNotNull()), "Sí"),
    )


def open_access(record: Column) -> Column:
    return rx.let(_get(record, "$.license"), lambda licences: F.when(licences.isNotNull() & ~licences.isin("[]", "{}"), "Sí"))


def abstract(record: Column) -> Column:
    """The stated abstract, of an object its value or else its text; only where none is stated
    the first of a list. Without tags, normalised."""
    def value(stated: Column) -> Column:
        within = F.coalesce(_get(stated, "$.value"), _get(stated, "$.text"))
        own = F.when(stated.startswith("{"), within).otherwise(stated)
        return F.when(stated.isNull(), F.get_json_object(record, "$.abstracts[0].value")).otherwise(own)

    return normalize.text(normalize.without_tags(rx.let(F.get_json_object(record, "$.abstract"), value)))


def keywords(record: Column) -> Column:
    return normalize.text(F.array_join(F.from_json(_get(record, "$.subject"), "array<string>"), ", "))


def mapped(record: Column) -> Column:
    """All fields as one struct."""
    doi = _get(record, "$.DOI")
    made = [
        authors(record),
        year(record),
        title(record),
        doi,
        link(record),
        container(record),
        normalize.text(_get(record, "$.publisher")),
        _get(record, "$.volume"),
        _get(record, "$.issue"),
        _one(record, "page"),
        isbn_issn(record),
        F.lit(None).cast("string"),
        kind(record),
        peer_reviewed(record),
        open_access(record),
        abstract(record),
        keywords(record),
    ]
    return F.struct(*[c.alias(n) for c, n in zip(made, fields)])


def llm_fields(response: Column) -> Column:
    """The JSON object in a language model's answer as a map: null, "null" and "" become null,
    strings are normalised, a long abstract is cut; an unreadable answer is an empty map."""
    body = rx.first(response, r"(\{.*\})", 1, "s")
    read = F.coalesce(F.from_json(body, "map<string,string>"), F.expr("cast(map() as map<string,string>)"))
    short = F.transform_values(
        read,
        lambda k, v: F.when(k == "resumen_abstract", normalize.truncated(normalize.text(v))).otherwise(normalize.text(v)),
    )
    return F.transform_values(short, lambda k, v: F.when(F.lower(v) != "null", v))
