"""The registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quillflow.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


SAMPLE = ["nrm_02_text_spacing", "ext_doi", "ref_01_parse_core", "agg_03_citations_by_year", "pdf_06_abstract", "spl_08_lines", "xml_01_references", "jsn_01_works", "mrg_01_reference", "rel_07_numbers", "rel_05_job_documents", "str_02_job_table", "src_12_column_text"]


@pytest.mark.parametrize("name", SAMPLE)
def test_sql(spark, tables, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = tables.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall()) and got


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(r["n"] > 0 for r in rows)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_extractors_find_something(spark):
    from pyspark.sql import functions as F

    parsed = registry.queries()["ref_01_parse"](spark, SF)
    counts = parsed.agg(*[F.count(c).alias(c) for c in parsed.columns]).first().asDict()
    assert all(n > 0 for c, n in counts.items() if c != "isbn_issn"), counts
