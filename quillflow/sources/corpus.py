"""Derived inputs: citations, pages, works, TEI and the like from orders and customers.

The prose of the test tables holds no years, identifiers or authors, so bibliographic text is
made from other columns by SQL that other engines run as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import dealt

#: One row for each order: the pieces that texts are made of.
PIECES = """
select o_orderkey as ref_id, o_custkey as cust, c_nationkey as nation,
  upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) as a1,
  lower(c_mktsegment) as seg,
  chr(cast(65 + c_nationkey as int)) as i1, chr(cast(65 + o_orderkey % 26 as int)) as i2,
  cast(year(o_orderdate) as varchar(4)) as yr,
  cast(o_orderkey % 400 + 1 as varchar(8)) as p1, cast(o_orderkey % 400 + 12 as varchar(8)) as p2,
  cast(1000 + o_orderkey % 9000 as varchar(8)) as reg
from orders join customer on o_custkey = c_custkey
"""
#: The citation of each row of PIECES.
CITATION = """
a1 || ', ' || i1 || '.' || case when ref_id % 4 = 0 then '' else ', Perez, ' || i2 || '.' end
|| case when ref_id % 5 in (0, 2) then ' (' || yr || '). ' when ref_id % 5 = 1 then ', ' || yr || '. '
        when ref_id % 5 = 3 then ', ' || yr || ', ' else '. ' end
|| 'Observations on the ' || seg || ' catch of stock ' || a1 || '. J. Mar. Syst. '
|| cast(ref_id % 97 + 1 as varchar(8))
|| case when ref_id % 2 = 0 then '(' || cast(ref_id % 6 + 1 as varchar(8)) || ')' else '' end
|| ', ' || p1 || '-' || p2 || case when ref_id % 5 = 4 then '. ' || yr || '; ' else '. ' end
|| case when ref_id % 3 = 0 then 'doi: 10.' || reg || '/jms.' || yr || '.' || p1 || '.'
        when ref_id % 3 = 1 then 'https://doi.org/10.' || reg || '/jms' || p2 else '' end
"""
#: A page of a journal article: running head, title, authors, abstract, keywords.
ARTICLE = """
'Invest. Mar., Valpara' || chr(237) || 'so, ' || cast(ref_id % 97 + 1 as varchar(8)) || ': ' || p1 || '-' || p2 || ', ' || yr || chr(10)
|| 'Observations on the ' || seg || ' catch of stock ' || a1 || ' in coastal waters' || chr(10)
|| a1 || ', ' || i1 || '., Perez, ' || i2 || '.' || chr(10)
|| 'Abstract: We describe the ' || seg || ' catch of stock ' || a1 || ' over several seasons and compare it with the catch of other stocks in the same waters.' || chr(10)
|| 'Keywords: ' || seg || ',catch,stock ' || a1 || chr(10) || 'Introduction' || chr(10)
|| case when ref_id % 4 = 0 then 'Technical report of the ' || seg || ' survey' when ref_id % 4 = 1 then 'A thesis of the faculty'
        when ref_id % 4 = 2 then 'A book of the publisher' else 'The journal of the region, Vol. 3' end
|| chr(10) || 'ISSN 0717-' || cast(1000 + ref_id % 9000 as varchar(4)) || case when ref_id % 3 = 0 then chr(10) || 'https://doi.org/10.' || reg || '/inv.' || p1 || '.mar' else '' end
"""
#: External records have the DOI of these citations; all others have one that no citation states.
WORK_FILTER = "ref_id % 3 <> 2 and ref_id % 2 = 0"
WORK_DOI = f"""
'10.' || reg || case when not ({WORK_FILTER}) then '/other' || ref_id when ref_id % 3 = 0 then '/jms.' || yr || '.' || p1 else '/jms' || p2 end
"""


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    joined = orders.select("o_orderkey", "o_custkey", "o_orderdate").join(customer.select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return dealt(joined, orders).selectExpr(*_select_list(PIECES))


def _select_list(sql: str) -> list[str]:
    """The expressions between select and from, cut at top-level commas."""
    body = sql.strip().removeprefix("select").rsplit("from orders", 1)[0]
    parts, depth, last = [], 0, 0
    for i, ch in enumerate(body):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(body[last:i].strip())
            last = i + 1
    return [*parts, body[last:].strip()]


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, cust, text)"""
    return pieces(spark, sf_dir).select("ref_id", "cust", F.expr(CITATION).alias("text"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, text): one page of an article."""
    return pieces(spark, sf_dir).select("ref_id", F.expr(ARTICLE).alias("text"))


def work_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, doi, record): external metadata as JSON, one for each citation."""
    p = pieces(spark, sf_dir)
    doi = F.expr(WORK_DOI)
    part = F.array(F.array(F.col("yr").cast("int")))
    record = F.to_json(
        F.struct(
            doi.alias("DOI"),
            F.array(F.expr("'Observations on the ' || seg || ' catch of stock ' || a1 || ' revisited'")).alias("title"),
            F.array(F.struct(F.expr("i1 || 'ose Maria'").alias("given"), F.col("a1").alias("family")), F.struct(F.lit("Ana").alias("given"), F.lit("Perez").alias("family"))).alias("author"),
            F.struct(part.alias("date-parts")).alias("published-print"),
            F.when(F.col("ref_id") % 4 == 0, F.lit('["Journal of Marine Systems"]')).alias("container-title"),
            F.lit("Sea Press").alias("publisher"),
            F.when(F.col("ref_id") % 4 == 0, "journal-article").otherwise("book").alias("type"),
            F.lit("<jats:p>On  catches</jats:p>").alias("abstract"),
            F.array(F.lit("fish"), F.col("seg")).alias("subject"),
        )
    )
    return p.select("ref_id", doi.alias("doi"), record.alias("record"))
