"""Cases of the third review: equal keys in joins, one pass over XML, shares of the work."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillflow.operators import merge


def test_first_of_works_with_one_doi(spark):
    """Of works with one DOI that first by the stated column is taken, whatever its title."""
    rows = [(2, "10.1/A", "Alpha"), (1, "10.1/a", "Zulu"), (3, "10.1/a", "Beta"), (4, "10.2/b", "Other")]
    works = spark.createDataFrame(rows, "place int, doi string, titulo_original string")
    records = spark.createDataFrame([(1, "10.1/a"), (2, "10.2/B"), (3, "10.3/c")], "ref_id int, doi string")
    found = merge.with_work(records, works, by_title=False, order="place")
    assert found.schema["work"].dataType.fieldNames() == ["doi", "titulo_original"]
    assert {r.ref_id: r.work and r.work.titulo_original for r in found.collect()} == {1: "Zulu", 2: "Other", 3: None}
    plain = merge.with_work(records, works.drop("place"), by_title=False).where(F.col("ref_id") == 1).first()
    assert plain.work.titulo_original == "Alpha"


def _struct(authors: int, pages: int) -> str:
    people = "".join(f"<author><persName><forename>{'F' * k}</forename><surname>Name{k}</surname></persName></author>" for k in range(authors))
    scopes = "".join(f'<biblScope unit="page">{k}</biblScope>' for k in range(pages))
    return (
        f'<biblStruct><analytic><title level="m">No</title><title level="a"> On <i>x</i></title>{people}<author>none</author></analytic>'
        f'<monogr><title/><title level="j"/><imprint><date>2001 AD</date>{scopes}<biblScope unit="volume"> 7 </biblScope></imprint></monogr></biblStruct>'
    )


def test_references_with_few_and_many_authors(spark):
    """Up to a few authors and one page scope come with the other paths, more by calls of their own."""
    from quillflow.functions import tei

    for authors, pages in ((0, 0), (1, 1), (2, 2), (3, 3), (4, 1), (9, 6)):
        df = spark.createDataFrame([(_struct(authors, pages) + "<bibl>a &amp; b</bibl><bibl> plain </bibl><bibl n='1'>c</bibl>",)], "x string")
        refs = df.select(tei.references(F.col("x")).alias("r")).first().r
        names = ", ".join(f"Name{k}, {'F' * k}" if k else "Name0" for k in range(authors)) or None
        first = refs[0]
        assert (first.authors, first.year, first.title, first.journal, first.volume) == (names, 2001, "On", None, "7")
        assert first.pages == ("-".join(str(k) for k in range(pages)) or None)
        assert [r.raw_text for r in refs[1:]] == ["a & b", "plain", "c"]


def test_xml_is_read_in_few_passes(spark):
    """The plan of a reference list parses an element for all fields together, not for each."""
    from quillflow.functions import tei

    df = spark.createDataFrame([("",)], "x string").select(tei.good_quality(tei.references(F.col("x"))))
    assert df._jdf.queryExecution().analyzed().toString().count("xpath_") < 12


def test_questions_are_not_broadcast(spark):
    """Questions repeated for each part of a list, and their best works, never go through the driver."""
    from quillflow.operators import search

    works = spark.createDataFrame([("10.1/a", "The red catch", "Perez, A."), ("10.1/b", "The blue stock", "Diaz, B.")], "doi string, titulo_original string, autores string")
    records = spark.createDataFrame([(1, "Red catch", "Perez"), (2, "Stock blue", None)], "id int, titulo_original string, autores string")
    found = search.search_works(records, works, hot=1)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.work_doi for r in found.collect()} == {1: "10.1/a", 2: "10.1/b"}


def test_shares_follow_the_size_of_the_source(spark, tmp_path):
    """A table's derived rows are dealt to as many tasks as its files call for, not left to a join."""
    from quillflow.sources import corpus, shared

    orders = spark.range(3000).selectExpr("id as o_orderkey", "id % 50 as o_custkey", "timestamp'2001-02-03 04:05:06' as o_orderdate")
    customer = spark.range(50).selectExpr("id as c_custkey", "cast(id % 25 as int) as c_nationkey", "'BUILDING' as c_mktsegment")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    customer.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    size = sum(f.stat().st_size for f in (tmp_path / "orders.parquet").glob("*.parquet"))
    before, shared.SHARE_BYTES = shared.SHARE_BYTES, max(1, size // 20)
    try:
        dealt = corpus.pieces(spark, str(tmp_path))
        assert dealt.rdd.getNumPartitions() >= 20
        counts = [len(p) for p in dealt.select("ref_id").rdd.glom().collect()]
        assert sum(counts) == 3000 and max(counts) <= 300
    finally:
        shared.SHARE_BYTES = before
