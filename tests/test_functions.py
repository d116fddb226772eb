"""Golden vectors and differential tests of the column functions."""

import datetime
import json
import re

import pytest
from pyspark.sql import functions as F

from quillflow.functions import citation, extract, fulltext, normalize, predicates, rx, tei, works
from quillflow.operators import aggregate, merge, relational, split
from quillflow.sources import pages, sinks
from quillflow.streaming import jobs

AS_OF = 2026


def apply(spark, make, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


CITATIONS = [
    (
        "Smith, J., Doe, A. (2023). Title of the article. Journal Name, 10(2), 123-145. https://doi.org/10.1234/example",
        ("10.1234/example", 2023, "Smith, J., Doe, A.", "Title of the article", "Journal Name", "123-145", "10(2)"),
    ),
    (
        "Aguilera, V., Escribano, R., and Herrera, L. (2009). High frequency responses of nanoplankton. J. Mar. Syst. 78, 124–135. doi: 10.1016/j.jmarsys.2009.04.005",
        ("10.1016/j.jmarsys.2009.04.005", 2009, None, "High frequency responses of nanoplankton", "J. Mar. Syst", "124–135", None),
    ),
    (
        "Guerrero A, Arana P. Size structure and sexual maturity of the golden crab. Lat. Am. J. Aquat. Res. 2009; 37: 347-360.",
        (None, 2009, "Guerrero, A, Arana, P", None, None, "347-360", None),
    ),
    ("Smith, J., 2020. Title. Journal, 10, 123-145.", (None, 2020, "Smith, J.", None, None, "123-145", None)),
    (
        "Smith, J. and Doe, A. (2023). Title of the article here. Mar. Ecol. 78, 1-9.",
        (None, 2023, None, "Title of the article here", "Mar. Ecol", "1-9", None),
    ),
    (
        "Machinery, J., Perez, B., 1997. Observations on the machinery catch of stock. J. Mar. Syst. 2, 2-13. https://doi.org/10.1001/jms13",
        ("10.1001/jms13", 1997, "Machinery, J., Perez, B.", None, None, "2-13", None),
    ),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CITATIONS)] + [(90, None), (91, ""), (92, "  ")], "i int, t string")
    return {r["i"]: r for r in citation.parse_citations(df, "t", AS_OF).collect()}


@pytest.mark.parametrize("i", range(len(CITATIONS)))
def test_citations(parsed, i):
    r, want = parsed[i], CITATIONS[i][1]
    got = (r["doi"], r["ano"], r["autores"], r["titulo_original"], r["lugar_publicacion_entrega"], r["paginas"], r["volumen_edicion"])
    for g, w, name in zip(got, want, ("doi", "year", "authors", "title", "journal", "pages", "volume")):
        if not (name == "authors" and w is None):
            assert g == w, name


def test_citation_nulls(parsed):
    for i in (90, 91, 92):
        assert all(parsed[i][f] is None for f in citation.FIELDS)


def test_apostrophes(spark):
    text = "D'Angelo, M. (2001). L'effet du vent sur la mer froide. Mar. Biol. 12, 3-9."
    assert apply(spark, citation.title, text) == ["Angelo, M. (2001). L"]
    assert apply(spark, lambda c: citation.title(c, False), text) == ["L'effet du vent sur la mer froide"]
    assert apply(spark, lambda c: citation.title(c, False), CITATIONS[5][0]) == ["Observations on the machinery catch of stock"]
    assert "Doe, A." in apply(spark, lambda c: citation.authors(c, False), CITATIONS[4][0])[0]


def test_normalisation_vectors(spark):
    assert apply(spark, normalize.spacing, "10.1038/s41586-020-1a McDonald 3D") == ["10.1038/s 41586-020-1 a Mc Donald 3 D"]
    assert apply(spark, normalize.initials, "J.M.P. Smith") == ["J. M.P. Smith"]
    assert apply(spark, normalize.without_running_heads, "Aguilera, V. (2009). X. Volume 12, 3-9. Perez, J. (2010). Y.") == ["Aguilera, V. (2009). X. "]
    assert apply(spark, normalize.text, None, "", "   ", "a#xE9;b\x02c\x1cd") == [None, None, None, "aé;bc d"]
    once = apply(spark, normalize.one_space, "a \u0085 b\r\n c ")
    assert once == ["a b c"] == apply(spark, normalize.one_space, *once)


NOISE = ["a b 1999 c", "x\u0085y\r\nz\n", "ÁRBOL Ñandú,Él J.M.", "٢٠٠٩ (2009). t", "pp. 3–9 p.4—5", "\u001c q\u001d r", "word 12word A1b", "ISSN 1234-567X ISBN 9781234567897", "doi:10.1234/abcdef. https://x.y/z)", ""]


def test_against_python(spark):
    """The Java dialect used here and Python's agree on awkward characters."""
    cases = [
        (lambda c: rx.sub(c, rx.SPACE + "+", "_"), lambda t: re.sub(r"\s+", "_", t)),
        (lambda c: rx.first(c, r"\b(19\d{2}|20[0-2]\d)\b"), lambda t: (re.search(r"\b(19\d{2}|20[0-2]\d)\b", t) or [None, None])[1]),
        (lambda c: rx.sub(c, r"([a-záéíóúñ])([A-ZÁÉÍÓÚÑ])", "$1 $2"), lambda t: re.sub(r"([a-záéíóúñ])([A-ZÁÉÍÓÚÑ])", r"\1 \2", t)),
        (lambda c: rx.first(c, r"(\d+[-–—]\d+)"), lambda t: (re.search(r"(\d+[-–—]\d+)", t) or [None, None])[1]),
        (rx.strip, str.strip),
        (lambda c: rx.before(c, r"\d"), lambda t: t[: m.start()] if (m := re.search(r"\d", t)) else None),
        (lambda c: rx.after(c, r"(\d)"), lambda t: t[m.end() :] if (m := re.search(r"\d", t)) else None),
    ]
    for make, plain in cases:
        assert apply(spark, make, *NOISE) == [plain(t) for t in NOISE]


def test_identifiers(spark):
    assert apply(spark, extract.doi, "see doi.org/10.1234/ab and DOI: 10.5555/longer.one.", "10.1234/abc 10.1234/abcdefgh", "10.1234/abc.", "none", None) == [
        "10.5555/longer.one",
        "10.1234/abcdefgh",
        "10.1234/abc",
        None,
        None,
    ]
    assert apply(spark, extract.isbn_issn, "ISBN 9781234567897", "ISBN: x ISSN 1234 567x", "isbn-13: 9781234567897") == ["9781234567897", "1234567x", "9781234567897"]
    assert apply(spark, lambda c: extract.year(c, 2020), "a 1999 b 2021, 2050", "2090 only") == [2021, 2090]


def test_heads(spark):
    text = "Invest. Mar., Valparaíso, 28: 39-52, 2000\nJ. Fish Biol."
    other = "J. Fish Biol., 45: 123-145, 1994\nx"
    assert apply(spark, fulltext.journal, text, other) == ["Invest. Mar., Valparaíso", None]
    assert apply(spark, fulltext.pages, text, other) == ["39-52", "123-145"]
    assert apply(spark, fulltext.volume, text, other) == ["28", "45"]
    assert apply(spark, lambda c: fulltext.year_from_header(c, AS_OF), text, other) == [2000, 1994]
    assert apply(spark, fulltext.kind, "INFORME FINAL", "a doctoral text", "Editorial board In: x", "the journal", "", None) == [
        "Informe técnico",
        "Tesis",
        "Capítulo de libro",
        "Artículo en revista científica",
        None,
        None,
    ]


def test_predicates(spark):
    good = "Perez, J. (2009). A study of many things in the sea. Mar. Biol. 3, 4-5."
    assert apply(spark, predicates.is_reference, good, "1234", "References " + good, good[:40], None) == [True, False, False, False, False]
    assert apply(spark, predicates.is_abstract, "word " * 12, "see www.site.org " + "word " * 12, "short", None) == [True, False, False, False]


def test_splitting(spark):
    one = "Perez, J. (2009). A study of many things in the cold sea. Mar. Biol. 3, 4-5. doi: 10.1234/abcdef"
    refs = [one.replace("Perez", n) for n in ("Perez", "Gomez", "Araya", "Munoz", "Silva", "Rojas", "Lagos")]
    text = "Intro. REFERENCES " + " ".join(refs) + " FUNDING none"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k long, t string")
    got = [r["reference"] for r in split.extract_references(df, "k", "t", compat=False).orderBy("pos").collect()]
    assert got == refs
    # No start known to compat fits behind "doi: 10.1234/abcdef": years cut, and too little is left of each piece.
    assert split.extract_references(df, "k", "t").count() == 0
    dotted = text.replace("abcdef", "abcdef.")
    got = [r["reference"] for r in split.extract_references(spark.createDataFrame([(1, dotted)], "k long, t string"), "k", "t").orderBy("pos").collect()]
    assert len(got) == 7 and all(g.startswith(r[:10]) for g, r in zip(got, refs))
    several = "Perez, J., Gomez, A.M. and Soto, P., 1997. Title of the one in the sea of the south. Mar. Biol. 3, 4-5. Lagos, B. (2001). Other title of the two. J. Fish 4, 5-9."
    got = [r["reference"] for r in split.extract_references(spark.createDataFrame([(1, several)], "k long, t string"), "k", "t", compat=False).orderBy("pos").collect()]
    assert [g[:9] for g in got] == ["Perez, J.", "Lagos, B."]
    lines = spark.createDataFrame([(1, "\n".join(refs) + "\n\nFunding x"), (2, None)], "k long, t string")
    assert [r["reference"] for r in split.by_lines(lines, "k", "t").orderBy("pos").collect()] == refs


@pytest.mark.parametrize("settings", [{}, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}, {"spark.sql.adaptive.enabled": "false"}])
def test_assign_numbers(spark, settings):
    settings = settings | {"spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 200000, 1, 8).selectExpr("id * 7919 % 200003 as k", "repeat(md5(string(id)), 7) as wide", "1 as `a.b`", "2 as _range")
        top = spark.createDataFrame([(None,), (17,)], "numero_doc int")
        got = relational.assign_numbers(rows, top, ["k"])
        assert got.columns == ["k", "wide", "a.b", "_range", "numero_doc"] and dict(got.dtypes)["numero_doc"] == "int"
        first = got.agg(F.count("*"), F.count_distinct("numero_doc"), F.min("numero_doc"), F.max("numero_doc")).first()
        assert tuple(first) == (200000, 200000, 18, 200017)
        pairs = got.orderBy("k").select("numero_doc").collect()
        assert [r[0] for r in pairs] == list(range(18, 200018))
        assert relational.assign_numbers(rows.limit(0), top, ["k"]).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_tei_and_json(spark):
    xml = (
        '<TEI xmlns="http://www.tei-c.org/ns/1.0"><biblStruct><analytic><title level="a">A longer title</title><author><persName>'
        "<forename>Ana</forename><surname>Perez</surname></persName></author></analytic><monogr><imprint><date when='2009-04'/>"
        '<biblScope unit="page">4</biblScope><biblScope unit="page">9</biblScope></imprint></monogr></biblStruct><bibl>Raw <i>text</i></bibl></TEI>'
    )
    refs = apply(spark, tei.references, xml, "", None)
    assert [(r["authors"], r["year"], r["title"], r["pages"], r["raw_text"]) for r in refs[0]] == [
        ("Perez, Ana", 2009, "A longer title", "4-9", None),
        (None, None, None, None, "Raw text"),
    ]
    assert refs[1] == [] and refs[2] is None
    texts = apply(spark, lambda c: F.transform(tei.references(c), tei.as_text), xml)[0]
    assert texts == ["Perez, Ana. (2009). A longer title. pp. 4-9", "Raw text"]
    record = json.dumps(
        {"DOI": "10.1/x", "title": ["á; T"], "author": [{"given": "Ana B", "family": "Perez"}, {"given": "X"}], "container-title": "J", "ISSN": ["1-2"], "published-online": {"date-parts": [[2011]]}, "published-print": {"date-parts": [[]]}, "license": [{}], "abstract": "<p>a  b</p>", "type": "other"}
    )
    w = apply(spark, works.mapped, record, "not json", None)
    r = w[0]
    assert (r["autores"], r["ano"], r["titulo_original"], r["link"], r["lugar_publicacion_entrega"], r["isbn_issn"], r["tipo_documento"], r["acceso_abierto"], r["resumen_abstract"]) == (
        "Perez, A.B.", 2011, "á T", "https://doi.org/10.1/x", "J", "1-2", "Otro", "Sí", "a b",
    )
    assert w[1]["titulo_original"] is None and w[2]["ano"] is None
    llm = apply(spark, works.llm_fields, 'x {"a": "v\\u0001", "b": "null", "c": null, "d": 3} y', "no json", None)
    assert llm[0] == {"a": "v", "b": None, "c": None, "d": "3"} and llm[1] == {}


def test_merge_rules(spark):
    df = spark.createDataFrame([(1, "Short", "A", 2000, "10.1/A"), (2, "A title that is long enough", "Perez, J., Gomez, A.", 1990, None), (3, None, None, None, "10.9/none")], "id long, titulo_original string, autores string, ano int, doi string")
    record = json.dumps({"DOI": "10.1/a", "title": ["A much longer external title"], "author": [{"given": "Z", "family": "Zeta"}], "published-print": {"date-parts": [[2001]]}, "publisher": "P"})
    other = json.dumps({"DOI": "10.2/b", "title": ["A title, that is long: enough"], "publisher": "Q", "published-print": {"date-parts": [[2005]]}})
    w = spark.createDataFrame([(record,), (record,), (other,)], "r string").select(works.mapped(F.col("r")).alias("w")).select("w.*")
    got = {r["id"]: r for r in merge.merge_reference(merge.with_work(df, w)).collect()}
    assert len(got) == 3
    assert (got[1]["titulo_original"], got[1]["autores"], got[1]["ano"], got[1]["enriched"]) == ("A much longer external title", "Zeta, Z.", 2001, True)
    assert (got[2]["publicista_editorial"], got[2]["ano"], got[2]["autores"]) == ("Q", 1990, "Perez, J., Gomez, A.")
    assert got[3]["enriched"] is False
    updated = {r["id"]: r for r in merge.merge_update(merge.with_work(df, w)).collect()}
    assert updated[1]["tipo_documento"] is None and updated[2]["ano"] == 2005
    assert merge.with_work(df.limit(0), w).count() == 0 and merge.with_work(df, w.limit(0)).where("work is not null").count() == 0


def test_numbers_and_exports(spark, tmp_path):
    new = spark.range(100).select((F.col("id") * 7 % 101).alias("k"))
    old = spark.createDataFrame([(5,), (None,)], "numero_doc int")
    got = relational.assign_numbers(new, old, ["k"]).orderBy("k").collect()
    assert [r["numero_doc"] for r in got] == list(range(6, 106))
    assert relational.assign_numbers(new.limit(1), old.limit(0), ["k"]).first()["numero_doc"] == 1
    df = spark.createDataFrame([(2, 'a "q", b\nline'), (1, None)], "numero_doc int, autores string")
    sinks.csv_file(df, str(tmp_path / "x.csv"))
    raw = (tmp_path / "x.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfN\xc2\xb0 doc,Autor(es)") and raw.count(b"\n") == 4
    sinks.json_file(df, str(tmp_path / "x.json"))
    back = json.loads((tmp_path / "x.json").read_text())
    assert [r["numero_doc"] for r in back] == [1, 2] and len(back[0]) == 20
    sinks.append(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    with pytest.raises(PermissionError):
        sinks.clear(spark, documents=str(tmp_path / "t"))
    assert sinks.clear(spark, True, documents=str(tmp_path / "t")).first()["after"] == 0
    assert aggregate.error_list(df.withColumn("e", F.lit(None).cast("string")).withColumn("k", F.lit(1)), "k", "e").first()["errors"] is None


def test_files_and_pages(spark, tmp_path):
    for name, size in (("a.pdf", 10), ("b.PDF", 10), ("c.pdf", 2000), ("d.txt", 5)):
        (tmp_path / name).write_bytes(b"x" * size)
    found = pages.pdf_files(spark, str(tmp_path), 1000).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in found] == ["a.pdf"]
    keys = pages.upload_keys(spark.createDataFrame([("x.pdf",)], "n string"), "n").first()["file_key"]
    assert re.fullmatch(r"uploads/[0-9a-f-]{36}\.pdf", keys)


EVENTS = [
    ("a", 0, "pending", None, None, None),
    ("a", 1, "processing", None, None, None),
    ("a", 2, "analyzing", 55, None, None),
    ("a", 3, "completed", None, None, 7),
    ("b", 0, "pending", None, None, None),
    ("b", 5, "analyzing", None, None, None),
    ("b", 6, "failed", 80, "broken", None),
    ("c", 0, "processing", 20, None, None),
]


def event_rows():
    start = datetime.datetime(2024, 1, 1)
    return [(j, start + datetime.timedelta(seconds=s), *rest) for j, s, *rest in EVENTS]


def test_job_states(spark, tmp_path):
    schema = "job_id string, event_time timestamp, status string, progress int, error string, document_id int"
    events = spark.createDataFrame(event_rows(), schema)
    view = {r["job_id"]: r for r in jobs.job_table(events).collect()}
    got = {k: (r["status"], r["progress"], r["error"], r["document_id"], r["started_at"] and r["started_at"].second) for k, r in view.items()}
    assert got == {"a": ("completed", 100, None, 7, 1), "b": ("failed", 0, "broken", None, 5), "c": ("processing", 20, None, None, 0)}
    messages = {r["job_id"]: r["message"] for r in jobs.job_status(jobs.job_table(events)).collect()}
    assert messages == {"a": "Procesamiento completado", "b": "Error: broken", "c": "Procesando... 20%"}
    for i, half in enumerate((EVENTS[:4], EVENTS[4:])):
        part = [r for r in event_rows() if r[0] in {h[0] for h in half}]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    q = jobs.job_stream(jobs.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("job_view").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    streamed = {r["job_id"]: (r["status"], r["progress"], r["error"], r["document_id"]) for r in spark.sql("select * from job_view").collect()}
    assert streamed == {k: v[:4] for k, v in got.items()}


def test_worker(spark, tmp_path):
    rows = [("j1", "k1", "f"), ("j1", "k1", "f"), ("j2", "k2", "g"), (None, "k", "x")]
    sinks.send(spark.createDataFrame(rows, "job_id string, file_key string, filename string"), str(tmp_path / "in"))
    q = jobs.work(jobs.read_inbox(spark, str(tmp_path / "in")), lambda df: df.withColumn("done", F.lit(True)), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(r["job_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["j1", "j2"]
    again = spark.createDataFrame([("j1", "k1", "f"), ("j3", "k3", "h")], "job_id string, file_key string, filename string")
    sinks.send(again, str(tmp_path / "in"))  # j1 is delivered again
    q = jobs.work(jobs.read_inbox(spark, str(tmp_path / "in")), lambda df: df.withColumn("done", F.lit(True)), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(r["job_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["j1", "j2", "j3"]


def test_title_author_match(spark):
    records = spark.createDataFrame(
        [(1, "Perez, A.", "Fish of the  Sea"), (2, "Gomez, B", "fish of the sea"), (3, None, "Fish of the sea"), (4, "X", "Other"), (5, "Y", None), (6, "Perez, A.", "Fish of the  Sea")],
        "ref_id int, autores string, titulo_original string",
    )
    works = spark.createDataFrame(
        [("10.1/b", "Perez, A.", "Fish of the sea"), ("10.1/a", "Perez, A.", "Fish of the sea"), ("10.1/c", "Gomez, B.", "Fish of the sea"), ("10.1/d", None, "Fish of the sea"), ("10.1/e", "Z", None)],
        "doi string, autores string, titulo_original string",
    )
    got = {r["ref_id"]: r["work_doi"] for r in merge.title_author_match(records, works).collect()}
    assert got == {1: "10.1/a", 2: "10.1/c", 3: "10.1/d", 6: "10.1/a"}


def test_small_tables(spark, tmp_path):
    jobs_ = spark.createDataFrame([("a", 1), ("b", 7), ("c", None)], "job_id string, document_id int")
    docs = spark.createDataFrame([(1, "x" * 300, "Perez, J."), (2, "10.1/x", None)], "numero_doc int, doi string, autores string")
    assert [r["job_id"] for r in relational.unreferenced(jobs_, docs).collect()] == ["b"]
    assert relational.cleared(docs).count() == 0 and relational.cleared(docs).columns == docs.columns
    wide = relational.aligned(docs)
    found = [tuple(r) for r in relational.length_violations(wide).collect()]
    assert found == [(1, "doi", 300)]
    names = spark.createDataFrame([("a.pdf",), ("B.PDF",), ("c.txt",), (None,)], "n string")
    assert [r[0] for r in pages.pdf_names(names, "n").collect()] == ["a.pdf"]
    assert {r[0] for r in pages.pdf_names(names, "n", ignore_case=True).collect()} == {"a.pdf", "B.PDF"}
    messages = spark.createDataFrame([("k1", "f1"), ("k2", "f2")], "file_key string, filename string")
    made = jobs.new_jobs(messages).collect()
    assert len({r["job_id"] for r in made}) == 2 and {(r["status"], r["progress"], r["job_type"]) for r in made} == {("pending", 0, "pdf")}
    sinks.append(docs.withColumn("keywords", F.lit("k")), str(tmp_path / "narrow"), narrow=True)
    assert {r["keywords"] for r in spark.read.parquet(str(tmp_path / "narrow")).collect()} == {None}
    sinks.write_csv(docs, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert len(back.columns) == 20 and back.count() == 2
    try:
        import openpyxl
    except ImportError:
        with pytest.raises(RuntimeError):
            sinks.excel_file(docs, str(tmp_path / "x.xlsx"))
    else:
        sinks.excel_file(docs, str(tmp_path / "x.xlsx"))
        assert openpyxl.load_workbook(tmp_path / "x.xlsx")["Documentos"].max_row == 3
