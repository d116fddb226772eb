"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from quillflow.llm import queries
from quillflow.llm.common import table, written

from .test_operators import base, contaminated, ids_of, similar_groups

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test-stage")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
    start = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    ids = {n: [r["doc_id"] for r in d.select("doc_id").collect()] for n, d in kept.items() if n != "packing"}
    good = [d for d, t in start.items() if base(t)[0] >= 20 and 100 * base(t)[4] <= 30 * base(t)[0]]
    assert set(ids["quality rules"]) <= set(good) and len(ids["quality rules"]) >= 0.95 * len(good)
    assert set(ids["quality classifier"]) <= set(ids["quality rules"])
    judged = sorted((r["doc_id"], r["text"]) for r in kept["quality classifier"].collect())
    groups = similar_groups([t for _, t in judged])
    assert sorted(ids["SimHash near-dedup"]) == sorted({judged[g][0] for g in groups})
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    clean = [r["doc_id"] for r in kept["SimHash near-dedup"].collect() if not contaminated(r["text"], items, 10)[1]]
    assert sorted(clean) == sorted(ids["benchmark decontamination"])
    pieces = kept["packing"].collect()
    tokens = Counter()
    for r in pieces:
        tokens[r["doc_id"]] += r["length"]
        assert len(np.frombuffer(r["ids"], "<u4")) == r["length"]
    assert tokens == Counter({r["doc_id"]: len(ids_of(r["text"])) + 1 for r in kept["benchmark decontamination"].collect()})


ODD = ["score", "_score", "fp", "row", "runs", "n_hit", "items", "kept", "kept_columns", "clean_text", "id", "stay", "a.b", "labelled", "t", "host"]


def odd_rows(spark):
    docs = table(spark, SF, "documents")
    first = docs.orderBy("doc_id").limit(3)
    rows = [(None, None, None, None, None), (None, "", "en", "s", 0), (9001, None, "en", "s", None), (9002, " \n ", "en", None, 3), (None, "ä " * 40, "de", None, 80), (9003, "w " * 40000, "en", "s", 80000)]
    odd = spark.createDataFrame(rows, docs.schema)
    changed = first.withColumn("text", F.concat("text", F.lit(" and more")))  # ties of ids
    every = docs.unionByName(odd).unionByName(odd).unionByName(first).unionByName(changed)
    return every.select("*", *[F.lit(i).alias(n) for i, n in enumerate(ODD)])


def test_stages_of_odd_rows(spark):
    docs = written(odd_rows(spark), "odd")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), "odd-stage")
        texts = Counter((r["doc_id"], r["text"]) for r in docs.collect())
        if name == "packing":
            assert out.agg(F.sum("length")).first()[0] == sum(n * (len(ids_of(t)) + 1) for (_, t), n in texts.items())
            continue
        assert out.columns == columns
        found = Counter((r["doc_id"], r["text"]) for r in out.collect())
        for (d, t), n in found.items():
            before = texts.get((d, t), 0)
            if name == "quality rules" and not before:
                before = sum(k for (e, u), k in texts.items() if e == d and u and set(t.split("\n")) < set(u.split("\n")))
            assert n <= before and (name == "SimHash near-dedup" or n == before), (name, d)
        if name == "quality rules":
            assert all(len((t or "").split()) >= 20 for _, t in found)
        if name == "SimHash near-dedup":
            judged = [(d, t) for (d, t) in texts]
            groups = similar_groups([t for _, t in judged])
            best = {}
            for g, (d, t) in zip(groups, judged):
                best.setdefault(g, []).append((d is None, d or 0))
            assert sorted((d is None, d or 0) for d, _ in found.elements()) == sorted(min(v) for v in best.values())
        if name == "benchmark decontamination":
            items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
            assert found == Counter({k: n for k, n in texts.items() if not contaminated(k[1], items, 10)[1]})
        nothing = stage(spark, docs.limit(0), SF)
        assert nothing.count() == 0


def test_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert names["pipeline"] is corpus_pipeline.run
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert len(corpus_pipeline.STAGES) == 5


def test_queries_run(spark):
    for name, query in queries.QUERIES.items():
        df = query(spark, SF)
        assert df.count() > 0, name
    assert queries.op10_simhash(spark, SF).where(F.length("fingerprint") != 16).count() == 0
