"""The text helpers against the plain forms that they stand for, on random texts."""

import random

from pyspark.sql import functions as F

from quillflow.functions import extract, normalize, predicates, rx
from quillflow.functions import patterns as P
from quillflow.plans import registry

SF = "/root/testdata/sf0.001"
PIECES = [*rx.BLANKS, *"aBzÉñ19,.,.  \n#x-", "​", "Abc,Def,Ghi", "doi: 10.1234/ab.cdef", "#x41", "#_#x0041", "Volume 12 of\n", "Article 7", "ARTİCLE 7 x", "FONDECYT", "www.a.org ", "sin fines de lucro", "http", " word", "a.b "]


def texts(n=3000):
    draw = random.Random(5)
    return ["".join(draw.choices(PIECES, k=draw.randrange(60))) for _ in range(n)]


def plain_strip(c):
    return rx.sub(c, r"^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z", "")


def plain_spaces(c):
    return plain_strip(rx.sub(c, r"[\s\x1C-\x1F]+", " "))


def plain_spacing(c):
    letters = P.UPPER + P.LOWER
    c = rx.sub(c, f"([{P.LOWER}])([{P.UPPER}])", "$1 $2")
    c = rx.sub(c, rf"(\d)([{letters}])", "$1 $2")
    return rx.sub(c, rf"([{letters}])(\d)", "$1 $2")


def plain_text_spacing(c):
    c = normalize.author_list(normalize.author_comma(plain_spacing(c)))
    return plain_spaces(normalize.concatenated_words(normalize.initials(c)))


def plain_heads(c):
    for p in P.RUNNING_HEADS:
        c = rx.sub(c, p, "", "i")
    return c


def plain_abstract(c):
    words = F.filter(F.split(c, rx.pattern(rx.SPACE + "+")), lambda w: w != "")
    dotted = F.filter(words, lambda w: w.contains(".") & (F.length(w) < 20))
    footer = rx.has(c, "|".join(f"(?:{p})" for p in predicates.FOOTERS), "iu")
    return (F.length(plain_strip(c)) >= 10) & ~footer & (F.size(words) >= 10) & (F.size(dotted) <= F.size(words) * 0.3)


def plain_doi(c):
    return F.coalesce(extract.doi_from_url(c), extract.doi_from_label(c), extract.doi_bare_longest(c), extract.doi_bare_raw(c))


def test_blanks_are_those_of_the_pattern(spark):
    every = spark.range(1, 0x110000).where("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    found = [r["c"] for r in every.where(rx.has(F.col("c"), rx.SPACE)).collect()]
    assert "".join(sorted(found)) == rx.BLANKS


def test_same_as_the_plain_forms(spark):
    df = spark.createDataFrame([(t,) for t in [*texts(), None, ""]], "t string")
    t = F.col("t")
    pairs = {
        "strip": (rx.strip(t), plain_strip(t)),
        "one_space": (normalize.one_space(t), plain_spaces(t)),
        "spacing": (normalize.spacing(t), plain_spacing(t)),
        "text_spacing": (normalize.text_spacing(t), plain_text_spacing(t)),
        "running heads": (normalize.without_running_heads(t), plain_heads(t)),
        "doi": (extract.doi(t), plain_doi(t)),
        "abstract": (predicates.is_abstract(t), F.coalesce(plain_abstract(t), F.lit(False))),
    }
    for name, (a, b) in pairs.items():
        other = df.select("t", a.alias("a"), b.alias("b")).where("not (a <=> b)").limit(3).collect()
        assert not other, (name, other)


def plan_of(query, spark):
    return query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_a_record_is_written_once(spark):
    assert plan_of(registry.jsn_03_container, spark).count("StructsToJsonEvaluator") == 1


def test_ends_are_cut_without_a_search(spark):
    assert r"\z" not in plan_of(lambda s, d: s.range(1).select(normalize.text_spacing(F.col("id").cast("string"))), spark)
