"""Cases of the fourth review."""

from __future__ import annotations

import duckdb


def test_title_query_and_sql_where_works_share_a_doi(spark, tmp_path):
    """Citations of one DOI with other years and authors than its first work's: the SQL states the rules too."""
    from quillflow.plans import registry

    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    con = duckdb.connect()
    con.sql(f"create table customer as select i::bigint c_custkey, (i % 25)::int c_nationkey, {segments}[1 + i % 5] c_mktsegment from range(50) r(i)")
    # The DOIs of keys 18,000 apart are alike.
    con.sql(
        "create table orders as select (i % 40 + 18000 * (i // 40))::bigint o_orderkey, ((i * 7 + i // 40) % 50)::bigint o_custkey, "
        "(timestamp '1995-06-01' + to_days((i // 40 * 300)::int)) o_orderdate from range(240) r(i)"
    )
    for name in ("customer", "orders"):
        con.sql(f"copy {name} to '{tmp_path}/{name}.parquet' (format parquet)")
    for query in ("mrg_03_title", "mrg_08_pdf_reference", "mrg_09_update"):
        rows = registry.queries()[query](spark, str(tmp_path)).collect()
        said = con.sql(registry.oracle_sql()[query])
        assert sorted(map(str, (tuple(r[c] for c in said.columns) for r in rows))) == sorted(map(str, said.fetchall())) and len(rows) == 240
    own = {(r.ref_id, r.ano) for r in registry.queries()["mrg_03_title"](spark, str(tmp_path)).collect()}
    first = {k % 18000: y for k, y in own if k < 18000}
    assert {y - first[k % 18000] for k, y in own if (k - k // 18000 * 18000) % 6 == 0} >= {0, 2, 3}  # not all of the work's year


def test_long_texts_are_cut_by_few_passes(spark):
    """At a space in the last tenth or at the limit, by characters and not bytes; the text is cut once in the plan."""
    from pyspark.sql import functions as F

    from quillflow.functions import normalize
    from quillflow.functions import patterns as P

    def expected(t, limit):
        if t is None or len(t) <= limit:
            return t
        space = t[:limit].rfind(" ")
        return t[: space if space > int(limit * 0.9) else limit] + P.TRUNCATED

    texts = [None, "", "a", " ", "x" * 50, "x" * 51, "é" * 50, "é" * 51, "漢 " * 40, "x" * 45 + " " + "y" * 20, "x" * 46 + " " + "y" * 20, "é" * 46 + " 漢" + "y" * 20]
    texts += ["x" * 49 + " " + "y", "x" * 50 + " ", " " * 60, "😀" * 47 + " b c", "x y" + "z" * 60, "ab " * 16 + "é" * 3]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for limit in (50, 51, 10):
        made = df.select("t", normalize.truncated(F.col("t"), limit).alias("v"))
        assert [r.v for r in made.collect()] == [expected(t, limit) for t in texts]
    plan = made._jdf.queryExecution().analyzed().toString()
    assert plan.count("substring(") <= 2 and plan.count("reverse(") == 0


def test_reference_lists_are_read_without_xpath(spark):
    """No call of an XPath function for each element; elements that can't be read, that end at once or
    that declare namespaces take nothing from the others of their list."""
    from pyspark.sql import functions as F

    from quillflow.functions import tei

    one = "<biblStruct{a}><analytic><title level='a'>Title {t}</title><author/><author><persName><surname>S{t}</surname></persName></author></analytic>{r}</biblStruct>"
    good = [one.format(a=a, t=i, r="<date>2001-02</date>") for i, a in enumerate(("", " xml:id='b1'", ' xmlns="http://x"', ' n="a>b"'))]
    bad = ["<biblStruct><a></biblStruct>", "<biblStruct>&nbsp;</biblStruct>", "<biblStruct><!-- </biblStruct>", "<biblStruct/>", "<bibl/>", "<bibl>a < b</bibl>"]
    lists = [None, "", good[0], good[0] * 3, "".join(good), bad[0] + good[0] + bad[1] + good[1], "".join([*bad[3:5], *good, bad[5], "<bibl>x<!-- n -->y</bibl>"]), good[2] + bad[2]]
    lists += [good[0] * 7 + "<bibl>raw</bibl>" * 3, good[0] * 6 + "<bibl>raw</bibl>" * 4, "<bibl>" + "long " * 30000 + "</bibl>"]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, x string").coalesce(1)
    refs = df.select("i", tei.references(F.col("x")).alias("r")).withColumn("good", tei.good_quality(F.col("r")))
    assert "xpath" not in refs._jdf.queryExecution().analyzed().toString()
    got = {r.i: r for r in refs.collect()}
    assert [None if r.r is None else len(r.r) for _, r in sorted(got.items())] == [None, 0, 1, 3, 4, 2, 5, 1, 10, 10, 1]
    assert [(r.title, r.authors, r.year) for r in got[4].r] == [(f"Title {i}", f"S{i}", 2001) for i in range(4)]
    assert got[6].r[-1].raw_text == "xy" and got[10].r[0].raw_text == ("long " * 30000).strip()
    df = spark.createDataFrame([("<biblStruct><title level='a'>A title long enough</title><date when='1999'/></biblStruct>" * n + "<bibl>raw</bibl>" * (10 - n),) for n in range(11)], "x string")
    assert [r[0] for r in df.select(tei.good_quality(tei.references(F.col("x")))).collect()] == [n >= 7 for n in range(11)]
