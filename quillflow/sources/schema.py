"""Tables of the bibliographic store: columns, export headings, length limits."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT = T.StringType()
DOCUMENT = T.StructType(
    [
        T.StructField("numero_doc", T.IntegerType()),
        T.StructField("autores", _TEXT),
        T.StructField("ano", T.IntegerType()),
        *[
            T.StructField(n, _TEXT)
            for n in (
                "titulo_original",
                "keywords",
                "resumen_abstract",
                "lugar_publicacion_entrega",
                "publicista_editorial",
                "volumen_edicion",
                "isbn_issn",
                "numero_articulo_capitulo_informe",
                "paginas",
                "doi",
                "link",
                "idioma",
                "tipo_documento",
                "tipo_documento_otro",
                "peer_reviewed",
                "acceso_abierto",
                "full_text_asociado_base_datos",
            )
        ],
    ]
)
#: References of object-store documents keep these columns only.
NARROW = ["numero_doc", "autores", "ano", "titulo_original", "lugar_publicacion_entrega", "publicista_editorial", "volumen_edicion", "isbn_issn", "paginas", "doi"]

# Headings of an export, in order, and what the columns hold at most.
EXPORT_NAMES = {
    "numero_doc": "N° doc",
    "autores": "Autor(es)",
    "ano": "Año",
    "titulo_original": "Título original",
    "keywords": "Keywords",
    "resumen_abstract": "Resumen/Abstract",
    "lugar_publicacion_entrega": "Lugar de publicación/entrega",
    "publicista_editorial": "Publicista/editorial",
    "volumen_edicion": "Volumen/edición",
    "isbn_issn": "ISBN/ISSN",
    "numero_articulo_capitulo_informe": "N° artículo/capítulo/informe",
    "paginas": "Páginas",
    "doi": "DOI",
    "link": "Link",
    "idioma": "Idioma",
    "tipo_documento": "Tipo documento",
    "tipo_documento_otro": "Tipo documento (Otro)",
    "peer_reviewed": "Peer-reviewed",
    "acceso_abierto": "Acceso abierto",
    "full_text_asociado_base_datos": "Full-text asociado a base de datos",
}
MAX_LENGTHS = {
    "volumen_edicion": 100,
    "isbn_issn": 50,
    "numero_articulo_capitulo_informe": 100,
    "paginas": 50,
    "doi": 255,
    "idioma": 50,
    "tipo_documento": 100,
    "tipo_documento_otro": 100,
    "peer_reviewed": 10,
    "acceso_abierto": 10,
    "full_text_asociado_base_datos": 10,
}

JOB_STATES = ["pending", "processing", "analyzing", "completed", "failed"]
JOB_EVENT = T.StructType(
    [
        T.StructField("job_id", _TEXT),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("status", _TEXT),
        T.StructField("progress", T.IntegerType()),
        T.StructField("error", _TEXT),
        T.StructField("document_id", T.IntegerType()),
    ]
)
MESSAGE = T.StructType([T.StructField(n, _TEXT) for n in ("job_id", "file_key", "filename")])
PAGE = T.StructType([T.StructField("page_no", T.IntegerType()), T.StructField("text", _TEXT)])
WORD = T.StructType([T.StructField("x0", T.DoubleType()), T.StructField("top", T.DoubleType()), T.StructField("text", _TEXT)])
