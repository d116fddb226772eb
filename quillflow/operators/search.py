"""The work that fits a title and authors best, by an inverted index over their words.

Works and questions become sets of terms, and equal sets are one. A term weighs more the fewer
works hold it. A work that holds all of a question's known terms can't be beaten, and stands on
the list of the rarest of them; only what finds none goes on. A work must share a stated part of
a question's weight; so it must hold one of the question's heaviest terms, and only the lists of
those are read. Lists of frequent terms are read last, and only for questions whose best find the
rest of their terms could still beat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import ship, written

LONGEST = 200  # characters of a title or of authors that are searched
PERCENT = 50
HOT = 1000
PART = 8192  # works of a list, or questions that read it, that one group of rows has about
_ITEM = "array<struct<term:string,weight:bigint,n:bigint>>"


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.substring(c, 1, LONGEST)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def terms_of(title: Column, authors: Column) -> Column:
    """The sorted set of title words (``t`` before them) and author words of two letters or more
    (``a`` before them); empty where there are none."""
    nothing = F.array().cast("array<string>")
    said = F.transform(F.coalesce(_words(title), nothing), lambda w: F.concat(F.lit("t"), w))
    names = F.filter(F.coalesce(_words(authors), nothing), lambda w: F.length(w) > 1)
    return F.array_sort(F.array_distinct(F.concat(said, F.transform(names, lambda w: F.concat(F.lit("a"), w)))))


def _weight(term: Column, n: Column, total: int) -> Column:
    """Thousandths of the log of how rare a term is, author words by half; a word that no work
    holds weighs as if one did."""
    rare = F.log(1 + F.lit(total) / F.greatest(n, F.lit(1)))
    return F.floor(F.when(term.startswith("a"), 500).otherwise(1000) * rare).cast("long")


def _weighed(sets: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(id, term, weight, n) of every term of ``sets`` (id, terms)."""
    n = F.coalesce(F.col("n"), F.lit(0).cast("long"))
    each = sets.select("id", F.explode("terms").alias("term")).join(counts, "term", "left")
    return each.select("id", "term", _weight(F.col("term"), n, total).alias("weight"), n.alias("n"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b)


def _prefix(items: Column, percent: int) -> Column:
    """The heaviest terms, down to where the rest alone can't reach the part of the mass."""
    heavy = F.reverse(F.array_sort(F.transform(items, lambda x: F.struct(x["weight"].alias("weight"), x["term"].alias("term"), x["n"].alias("n")))))
    start = F.struct(_sum(items["weight"]).alias("rest"), F.array().cast(_ITEM).alias("kept"))
    least = percent * _sum(items["weight"])

    def step(acc: Column, x: Column) -> Column:
        one = F.array(F.struct(x["term"].alias("term"), x["weight"].alias("weight"), x["n"].alias("n")))
        kept = F.when(100 * acc["rest"] >= least, F.concat(acc["kept"], one)).otherwise(acc["kept"])
        return F.struct((acc["rest"] - x["weight"]).alias("rest"), kept.alias("kept"))

    return F.aggregate(heavy, start, step, lambda acc: acc["kept"])


class _Part:
    """The works of a part of a list, of which the first of equally good ones is the best."""

    def __init__(self) -> None:
        self.works: list[tuple[int, str]] = []
        self.places: dict[str, list[int]] = {}
        self.read: dict[str, int | np.ndarray] = {}

    def add(self, terms: list[str], mass: int, work: str) -> None:
        for t in terms:
            self.places.setdefault(t, []).append(len(self.works))
        self.works.append((mass, work))

    def _bits(self, term: str) -> int:
        if term not in self.read:
            held = np.zeros(len(self.works), np.uint8)
            held[self.places.get(term, [])] = 1
            self.read[term] = int.from_bytes(np.packbits(held, bitorder="little").tobytes(), "little")
        return self.read[term]

    def _held(self, term: str) -> np.ndarray:
        if term not in self.read:
            self.read[term] = np.array(self.places.get(term, []), np.int64)
        return self.read[term]

    def whole(self, terms: list[str]) -> int | None:
        """The place of the best work that holds all the terms."""
        left = (1 << len(self.works)) - 1
        for t in terms:
            left &= self._bits(t)
            if not left:
                return None
        return (left & -left).bit_length() - 1

    def best(self, terms: list[str], weights: list[int]) -> tuple[int, int]:
        """The place of the best work and what it shares."""
        shared = np.zeros(len(self.works), np.int64)
        for t, w in zip(terms, weights):
            shared[self._held(t)] += w
        at = int(shared.argmax())
        return at, int(shared[at])


def _texts(values: pa.Array) -> list[str | None]:
    """Strings that repeat much, each made once."""
    coded = values.dictionary_encode()
    known = [*coded.dictionary.to_pylist(), None]
    return [known[i] for i in coded.indices.fill_null(len(known) - 1).to_numpy().tolist()]


def _searched(batches: Iterator[pa.RecordBatch], whole: bool, percent: int) -> Iterator[pa.RecordBatch]:
    """(key, lack, work_mass, work) of the best of each part for each question that reads it; rows
    are sorted by part, its works before its questions."""
    group, held = None, _Part()
    for batch in batches:
        col = {n: batch.column(n) for n in batch.schema.names}
        part, share, key, mass = (col[n].fill_null(-1).to_numpy().tolist() for n in ("part", "share", "key", "mass"))
        term, work = _texts(col["term"]), col["work"].to_numpy(zero_copy_only=False)
        ends, names = col["names"].offsets.to_numpy().tolist(), _texts(col["names"].values)
        weight_ends, weights = col["weights"].offsets.to_numpy().tolist(), col["weights"].values.to_numpy().tolist()
        out: list[tuple] = []
        for i, k in enumerate(key):
            if (term[i], part[i], share[i]) != group:
                group, held = (term[i], part[i], share[i]), _Part()
            own = names[ends[i] : ends[i + 1]]
            if k < 0:
                held.add(own, mass[i], work[i])
            elif held.works:
                heavy = weights[weight_ends[i] : weight_ends[i + 1]]
                at, score = (held.whole(own), sum(heavy)) if whole else held.best(own, heavy)
                if at is not None and score > 0 and 100 * score >= percent * mass[i]:
                    out.append((k, -score, *held.works[at]))
        columns = list(zip(*out)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "lack", "work_mass", "work"])


def _round(asked: DataFrame, works: DataFrame, percent: int, whole: bool) -> DataFrame:
    """(key, best) of questions (key, mass, names, weights, lists): the best work on the lists of
    the terms ``lists``, or with ``whole`` the best of those that hold all names. A long list is
    read in parts of about ``PART`` works, the questions going to each, and so are those of many
    questions; only each question's best leaves a part. Questions are never broadcast."""
    left = asked.select("key", "mass", "names", "weights", F.explode("lists").alias("x")).select("key", "mass", "names", "weights", "x.term", "x.n")
    wanted = left.groupBy("term").agg(F.ceil(F.max("n") / F.lit(PART)).cast("long").alias("parts"), F.ceil(F.count("*") / F.lit(PART)).cast("long").alias("shares"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    left = left.join(wanted, "term").select(
        "term", every("parts").alias("part"), F.pmod(F.xxhash64("key"), "shares").alias("share"), "key", "mass", nothing("string", "work"), "names", "weights"
    )
    right = works.select("work", "names", "work_mass", F.explode("names").alias("term")).join(wanted, "term").select(
        "term", F.pmod(F.xxhash64("work"), "parts").alias("part"), every("shares").alias("share"), nothing("long", "key"), F.col("work_mass").alias("mass"), "work", "names", F.array().cast("array<bigint>").alias("weights")
    )
    ship(asked.sparkSession)
    group = ["term", "part", "share"]
    met = left.unionByName(right).repartition(*group).sortWithinPartitions(*group, F.col("key").asc_nulls_first(), "mass", "work")
    found = met.mapInArrow(lambda batches: _searched(batches, whole, percent), "key long, lack long, work_mass long, work string")
    return found.groupBy("key").agg(F.min(F.struct("lack", "work_mass", "work")).alias("best"))


def best_works(questions: DataFrame, works: DataFrame, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """(terms, work_doi, score, mass) of the best work for each different set of ``terms``.

    The best shares the most weight with the question, at least ``percent`` of its mass; of
    equal ones that with the least mass of its own, then the smallest DOI. ``works`` has the
    columns titulo_original, autores and doi; works without DOI or words aren't found. First works
    that hold all of a question's known terms are looked for. For questions that find none
    the lists of terms of at most ``hot`` works are read; a question goes on to longer lists only
    where terms not yet read weigh as much as its best find shares. The result is that of a
    comparison of all with all.
    """
    terms = terms_of(F.col("titulo_original"), F.col("autores"))
    index = works.where("doi is not null").select(terms.alias("terms"), "doi").groupBy("terms").agg(F.min("doi").alias("work"))
    # One DOI may stand on several sets of words, so works are told apart by numbers. Empty sets go
    # when they are written: a filter before that would make all sets twice.
    index = written(index.select(F.monotonically_increasing_id().alias("id"), "terms", "work"), "search-works").where(F.size("terms") > 0)
    total = index.count()
    counts = written(index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")), "search-terms")
    masses = _weighed(index, counts, total).groupBy("id").agg(F.sum("weight").alias("work_mass"))
    lists = written(index.join(masses.hint("merge"), "id").select("work", F.col("terms").alias("names"), "work_mass"), "search-index")

    different = questions.select("terms").distinct()
    different = written(different.select(F.monotonically_increasing_id().alias("id"), "terms"), "search-asked").where(F.size("terms") > 0)
    items = F.array_sort(F.collect_list(F.struct("term", "weight", "n"))).alias("items")
    weighed = _weighed(different, counts, total).groupBy("id").agg(items, F.sum("weight").alias("mass"))
    known = F.filter("items", lambda x: x["n"] > 0)
    weighed = weighed.withColumns({"known": known, "prefix": _prefix(F.col("items"), percent)})
    rarest = F.array_min(F.transform("known", lambda x: F.struct(x["n"].alias("n"), x["term"].alias("term"))))
    asked = weighed.join(different.hint("merge"), "id").select(
        F.col("id").alias("key"), "terms", "mass", F.col("known.term").alias("names"), F.col("known.weight").alias("weights"),
        F.array(F.struct(rarest["term"].alias("term"), rarest["n"].alias("n"))).alias("rarest"),
        F.filter("prefix", lambda x: x["n"].between(1, hot)).alias("rare"), F.filter("prefix", lambda x: x["n"] > hot).alias("long"),
    )
    asked = written(asked, "search-questions")
    able = asked.where((F.size("names") > 0) & (100 * _sum(F.col("weights")) >= percent * F.col("mass")))
    question = ["key", "mass", "names", "weights"]
    whole = written(_round(able.select(*question, F.col("rarest").alias("lists")), lists, percent, True), "search-found")
    rest = written(able.join(whole.hint("merge"), "key", "left_anti"), "search-questions")
    found = written(_round(rest.select(*question, F.col("rare").alias("lists")), lists, percent, False), "search-found")
    unread = _sum(F.col("weights")) - _sum(F.col("rare")["weight"])
    more = rest.where(F.size("long") > 0).join(found.hint("merge"), "key", "left")
    more = more.where(F.col("best").isNull() | (-F.col("best.lack") <= unread)).select(*question, F.col("long").alias("lists"))
    last = written(_round(more, lists, percent, False), "search-found")
    both = whole.unionByName(found).unionByName(last).groupBy("key").agg(F.min("best").alias("best"))
    return both.join(asked.select("key", "terms", "mass").hint("merge"), "key").select("terms", F.col("best.work").alias("work_doi"), (-F.col("best.lack")).alias("score"), "mass")


def search_works(records: DataFrame, works: DataFrame, percent: int = PERCENT, hot: int = HOT, authors: bool = True) -> DataFrame:
    """``records`` with work_doi, score and mass of the work that fits title and authors (or the
    title alone) best; null where none shares ``percent`` of the question's weight.

    Case, order of words and marks don't count; a misspelt or missing word costs its weight. Null
    titles and authors have no words; repeated records are asked once; empty tables find nothing.
    """
    own = F.col("autores") if authors and "autores" in records.columns else F.lit(None).cast("string")
    asked = records.withColumn("terms", terms_of(F.col("titulo_original"), own))
    return asked.join(best_works(asked, works, percent, hot).hint("merge"), "terms", "left").select(*records.columns, "work_doi", "score", "mass")
