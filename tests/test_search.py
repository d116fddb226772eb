"""Title and author search against a comparison of all with all."""

import math
import random
import re
from collections import Counter

import pytest

from quillflow.operators import merge, search

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau ñandú 漢字".split()


def terms(title, authors):
    words = lambda c: [w for w in re.split(r"[\W_]+", (c or "")[:200].lower()) if w]
    return tuple(sorted({"t" + w for w in words(title)} | {"a" + w for w in words(authors) if len(w) > 1}))


def brute(records, works, percent):
    index = {}
    for doi, title, authors in works:
        t = terms(title, authors)
        if doi is not None and t:
            index[t] = min(index.get(t, doi), doi)
    df = Counter(w for t in index for w in t)
    weight = lambda w: math.floor((500 if w[0] == "a" else 1000) * math.log(1 + len(index) / max(df[w], 1)))
    out = []
    for key, title, authors in records:
        asked = terms(title, authors)
        mass = sum(map(weight, asked))
        found = [(-sum(weight(w) for w in asked if w in t), sum(map(weight, t)), doi) for t, doi in index.items()]
        found = [f for f in found if asked and f[0] < 0 and -100 * f[0] >= percent * mass]
        out.append((key, *((min(found)[2], -min(found)[0], mass) if found else (None, None, None))))
    return Counter(out)


@pytest.mark.parametrize("hot,percent", [(1, 50), (5, 50), (1000, 50), (4, 90), (4, 10)])
def test_search(spark, hot, percent):
    rng = random.Random(hot + percent)
    title = lambda: " ".join(rng.choices(WORDS, weights=range(1, len(WORDS) + 1), k=rng.randint(1, 7)))
    author = lambda: rng.choice([None, "", "Perez, J.", "Gomez, A., Perez, J.", "Li, X"])
    works = [(f"10.1/{i:03}", title(), author()) for i in range(150)]
    works += [(f"10.2/{i:03}", "Editorial", "Perez, J.") for i in range(40)] + [("10.1/000", "Editorial", None), (None, "Alpha beta", None), ("10.3/1", None, None), ("10.3/2", " .,", "")]
    records = [(i, title().upper(), author()) for i in range(120)]
    records += [(200 + i, " ".join(rng.sample(works[i][1].split(), k=-(-len(works[i][1].split()) * 2 // 3))) + rng.choice(["", " mispelt"]), works[i][2]) for i in range(60)]
    records += [(300, "EDITORIAL", None), (301, None, None), (302, "", "Perez"), (303, "editorial", "Perez"), (304, "x" * 300, None), (305, "nowhere found", None), records[0], records[0]]
    df = spark.createDataFrame(records, "ref_id long, titulo_original string, autores string").repartition(3)
    held = spark.createDataFrame(works, "doi string, titulo_original string, autores string").repartition(3)
    out = search.search_works(df, held, percent, hot)
    assert out.columns == ["ref_id", "titulo_original", "autores", "work_doi", "score", "mass"]
    assert Counter((r["ref_id"], r["work_doi"], r["score"], r["mass"]) for r in out.collect()) == brute(records, works, percent)
    assert search.search_works(df, held.limit(0)).where("work_doi is not null").count() == 0
    assert search.search_works(df.limit(0), held).count() == 0
    alone = search.search_works(df.drop("autores"), held, percent, hot).where("ref_id = 300").collect()[0]
    assert alone["work_doi"] == "10.1/000"


def test_works_by_search(spark):
    """Records without a DOI's work find theirs by a title that is cut, misspelt or reordered."""
    works = [(f"10.1/W{i}", f"Notes on the {a} of {b} in cold waters", "Perez, J.", "P") for i, (a, b) in enumerate(zip(WORDS[:8], WORDS[8:16]))]
    held = spark.createDataFrame(works, "doi string, titulo_original string, autores string, publicista_editorial string")
    rows = [(1, "10.1/w3", "Something else entirely"), (2, None, "NOTES ON THE ALPHA OF IOTA"), (3, "10.9/none", "Cold waters: notes on beta, of kapppa"), (4, None, "gamma"), (5, None, None)]
    records = spark.createDataFrame(rows, "ref_id long, doi string, titulo_original string")
    got = {r["ref_id"]: r["work"] and r["work"]["doi"] for r in merge.with_work(records, held, "search").collect()}
    assert got == {1: "10.1/W3", 2: "10.1/W0", 3: "10.1/W1", 4: None, 5: None}
    assert {r["work"] and r["work"]["doi"] for r in merge.with_work(records, held).collect()} == {"10.1/W3", None}


def test_questions_that_a_work_holds_whole(spark, monkeypatch):
    """They are settled on the list of their rarest term, however long; lists in several parts give
    the same, and only the other questions read the lists of their heavy terms."""
    rng = random.Random(7)
    title = lambda: " ".join(rng.sample(WORDS[:12], k=5)) + " lot"
    works = [(f"10.1/{i:03}", title(), "Perez, J.") for i in range(200)]
    records = [(i, " ".join(rng.sample(works[i][1].split(), k=4)) + (" unheardof" if i % 9 == 0 else ""), None) for i in range(60)]
    records += [(100 + i, works[i][1] + " rho sigma", "Gomez") for i in range(20)]
    works += [("10.2/1", "rho", None), ("10.2/2", "sigma Gomez", "Gomez")]
    asked, plain = [], search._round
    monkeypatch.setattr(search, "PART", 16)
    monkeypatch.setattr(search, "_round", lambda q, *rest: (asked.append(q.count()), plain(q, *rest))[1])
    df = spark.createDataFrame(records, "ref_id long, titulo_original string, autores string")
    held = spark.createDataFrame(works, "doi string, titulo_original string, autores string").repartition(3)
    out = search.search_works(df, held, 50, 5)
    assert Counter((r["ref_id"], r["work_doi"], r["score"], r["mass"]) for r in out.collect()) == brute(records, works, 50)
    assert asked[0] >= 60 and max(asked[1:]) <= 20
