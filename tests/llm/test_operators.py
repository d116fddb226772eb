"""Operators against brute force on small tables with nulls, ties, repeats and odd names."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillflow.llm import (
    bpe,
    components,
    decontaminate,
    directcodes,
    factorization,
    files,
    licences,
    packing,
    quality,
    queries,
    rollup,
    simhash,
    urlfilter,
    warc,
)
from quillflow.llm.common import new_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, fp string, score string, n_hit string, host string, row string"


def make_texts(n=60, seed=3):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 80))) for _ in range(n)]
    texts += [texts[0], texts[1], texts[0] + " end", None, "", "  \n\t ", "x", "a\n\nb\na\na", "é ß 漢字 " * 30, "w " * 5000]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "q", "q", "q", "q", "q", "q") for i, t in enumerate(make_texts())]
    rows += [rows[0], (None, "lost words here", None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EXTRA)


def tokenizer():
    return bpe.encoder(bpe.default_path()).tokenizer


def ids_of(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library():
    odd = ["", " ", "  a", "a  b", "a \n b", " a ", "it's 12 é x y  z", "<|endoftext|> x", "a\tb \tc", "\n\n x", "x\x1c y", "a. b, c.d e!? f'", "ж. ж,"]
    enc = bpe.Encoder(bpe.default_path())
    for texts in (odd, odd, make_texts()):
        assert [a.tolist() for a in enc.encode(texts)] == [ids_of(t) for t in texts]


def test_encoder_added_tokens():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())  # its flags as they come
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a  <|endoftext|>\n", None, "", "a <|endoftext b"]
    got = [a.tolist() for a in bpe.Encoder(bpe.default_path()).encode(texts)]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got[1] == [50256]


# --- quality -------------------------------------------------------------------------------


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {p for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(hit),
    )


def test_quality_base(spark, docs, empty):
    out = quality.assess(docs, keep=["doc_id", "text", "n_words"])
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["_n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base(r["text"])
        assert r["base_failed"] == (r["_n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["_n_words"])
    assert quality.assess(empty).count() == 0 and quality.assess(empty, with_text=False).count() == 0
    plain = quality.assess(docs, keep=["doc_id", "text", "n_words"], with_text=False)
    assert plain.columns == [c for c in out.columns if c != "clean_text"]
    assert Counter(plain.collect()) == Counter(out.drop("clean_text").collect())
    assert quality.apply_rules(docs).columns == docs.columns


def test_quality_lines(spark):
    rng = random.Random(1)
    own = lambda: " ".join(rng.choices(WORDS, k=40))
    rows = [(i, f"{own()}\nSite  MENU {i % 10}\n{own()}", "h") for i in range(12)]
    rows += [(20 + i, rows[0][1], "h") for i in range(12)]  # copies are one document
    rows += [(50, "Site menu 7\nfew words", "h"), (51, "site menu 1\n" + own(), "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.assess(df, min_docs=5, share=0.1).collect()}
    assert all("MENU" not in got[i]["clean_text"] and got[i]["n_removed_lines"] == 1 and got[i]["kept"] for i in range(12))
    assert got[20]["n_removed_lines"] == 1 and got[20]["kept"]
    assert not got[50]["kept"] and got[51]["n_removed_lines"] == 0
    limits = quality.frequent_lines(df, "text", "source", 5, 0.1).collect()
    assert [r["n_docs"] for r in limits] == [13]


def test_quality_longest_line(spark):
    rng = random.Random(2)
    passage = " ".join(rng.choices(WORDS, k=60))
    rows = [(i, f"{' '.join(rng.choices(WORDS, k=30))}\n{passage}", "h") for i in range(9)]
    rows += [(20 + i, rows[0][1], "h") for i in range(3)]  # copies are one document
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [r["n_docs"] for r in quality.frequent_lines(df, "text", "source", 5, 0.1).collect()] == [9]
    for r in quality.assess(df, min_docs=5, share=0.1).collect():
        assert r["n_removed_lines"] == 1 and passage not in r["clean_text"] and r["n_words_left"] == 30 and r["kept"]


def test_quality_limits(spark):
    rng = random.Random(3)
    own = lambda k: " ".join(rng.choices(WORDS, k=k))
    passage, few, menu = own(60), own(60), "site menu of all pages"
    rows = [(i, f"{own(30)}\n{menu}" + (f"\n{passage}" if i < 4 else "") + (f"\n{few}" if i < 3 else ""), "big") for i in range(60)]
    rows += [(100 + i, own(30), "big") for i in range(12000)]  # the share of the host does not count
    rows += [(20000 + i, f"{own(30)}\n{passage}", None) for i in range(4)]
    rows += [(30000 + i, f"{own(30)}\n{menu}\n{passage}", "other") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["n_removed_lines"], r["clean_text"]) for r in quality.assess(df, keep=["doc_id"]).collect()}
    short = {r["doc_id"]: (r["n_removed_lines"], r["n_words_left"]) for r in quality.assess(df, keep=["doc_id"], with_text=False).collect()}
    assert short == {k: (n, len(t.split())) for k, (n, t) in got.items()}
    assert len(got) == len(rows)
    for i, text, host in rows:
        gone = {"big": {menu, passage}, None: {passage}, "other": set()}[host]
        left = [x for x in text.split("\n") if x not in gone]
        assert got[i] == (text.count("\n") + 1 - len(left), "\n".join(left))


# --- licences ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def licence_model(spark):
    return licences.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_licences(spark, licence_model):
    model = licence_model
    cases = [(f, t) for f, ts in licences.TEMPLATES.items() for t in ts]
    plain = [*licences.OTHER, "alpha beta gamma.", None, "", "Nothing here is of note\nto any reader."]
    mixed = "Some words first. Released under the MIT License. And more behind it.\nLicensed under CC BY-NC-ND 4.0.\nAll rights reserved."
    df = spark.createDataFrame(list(enumerate([*[t for _, t in cases], *plain, mixed])), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.scan(df, model).collect()}
    right = sum(f in {x["family"] for x in got[i]["licences"] if x["confirmed"]} for i, (f, _) in enumerate(cases))
    assert right >= 0.97 * len(cases)
    assert not any(x["confirmed"] for i in range(len(cases), len(cases) + len(plain)) for x in got[i]["licences"])
    assert [x["family"] for x in got[len(cases) + len(plain)]["licences"] if x["confirmed"]] == ["MIT", "CC-BY-NC-ND", "All-rights-reserved"]
    # The probability that Spark computes is that of the features counted in Python.
    found = licences.buckets_of(licences.words_of(cases[0][1]))
    x = np.array(model.any_weights)[found].sum() / np.sqrt(len(found)) + model.any_bias
    p = 1 / (1 + np.exp(-(x * model.slope + model.offset)))
    assert abs(got[0]["licences"][0]["probability"] - p) < 1e-3


def test_licences_not_trained_on(spark, licence_model):
    import textwrap

    apache = "Licensed to the Foundation under one or more agreements. Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
    cases = [
        ("MIT", "The code in this folder is released under the MIT license."),
        ("MIT", licences.TEMPLATES["MIT"][1] + "\n\n" + licences.TEMPLATES["MIT"][3]),
        ("GPL", "This file is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
        ("AGPL", "The server is licensed under the GNU Affero General Public License, version 3."),
        ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License."),
        ("BSD", licences.TEMPLATES["BSD"][1] + "\n\n" + licences.TEMPLATES["BSD"][2]),
        ("Apache-2.0", apache),
        ("CC-BY-SA", "The article is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        ("CC-BY-NC-ND", "The photographs are licensed under CC BY-NC-ND 4.0."),
        ("CC-BY-ND", "These pages are licensed under CC BY-ND 4.0."),
        ("MPL-2.0", "The following file is subject to the terms of the Mozilla Public License, v. 2.0."),
        ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
        ("Unlicense", licences.TEMPLATES["Unlicense"][0]),
        ("All-rights-reserved", "Copyright (c) 2020 by the society. All rights reserved."),
    ]
    plain = [
        "A hunting license is needed in the general area of the lake.",
        "The house was sold under the terms of a contract from 1920.",
        "The version of the song that they published was free.",
        "The museum is open to the public and free of charge.",
        "The warranty of the car covers the motor for any purpose.",
        "He was given permission to copy the notice on the door.",
        "Under this rule all members have the same rights.",
        "The software was modified by the second group of students.",
    ]
    wrapped = [(f, "\n\n".join(textwrap.fill(p, w) for p in t.split("\n\n"))) for f, t in cases for w in (60, 72)]
    every = [*cases, *wrapped, *[(None, t) for t in plain]]
    df = spark.createDataFrame([(i, "Words before.\n\n" + t + "\n\nWords behind it.") for i, (_, t) in enumerate(every)], "doc_id long, text string")
    got = {r["doc_id"]: {x["family"] for x in r["licences"] if x["confirmed"]} for r in licences.scan(df, licence_model).collect()}
    hits = [(f, got[i]) for i, (f, _) in enumerate(every) if f is not None]
    recall = sum(f in g for f, g in hits) / len(hits)
    wrong = [(f, g) for f, g in hits if g - {f}] + [g for i, (f, _) in enumerate(every) if f is None and (g := got[i])]
    assert recall >= 0.9, [h for h in hits if h[0] not in h[1]]
    assert len(wrong) <= 2, wrong


def test_licences_of_the_tables(spark, licence_model, docs, empty):
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = {"version 3.": "GPL", "All rights reserved.": "All-rights-reserved", "CC BY-NC 4.0.": "CC-BY-NC", "the MIT License.": "MIT", "License, Version 2.0.": "Apache-2.0"}
    for r in licences.scan(corpus, licence_model).collect():
        lines = (r["text"] or "").split("\n")
        want = {f for end, f in planted.items() if any(x.endswith(end) and re.match("This work is|All rights|Licensed under|Released under", x) for x in lines)}
        assert {x["family"] for x in r["licences"] if x["confirmed"]} >= want, r["doc_id"]
    out = licences.scan(docs.withColumn("licences", F.lit(1)), licence_model)
    assert out.columns == [*docs.columns, "licences", "n_paragraphs", "_licences"] and out.count() == docs.count()
    assert licences.scan(empty, licence_model).count() == 0 and not licences.train(empty).families == ()
    blocks = spark.createDataFrame([(1, "a\n \t\nb\nc\n\n\n\nd"), (2, None), (3, " \n\n ")], "doc_id long, text string")
    assert [r["n_paragraphs"] for r in licences.scan(blocks, licence_model).orderBy("doc_id").collect()] == [3, 0, 0]


# --- rollups ---------------------------------------------------------------------------------------


def test_rollups(spark, docs):
    store = new_path(spark, "store")
    counts = rollup.bpe_counts(docs).unionByName(rollup.word_counts(docs))
    assert rollup.totals(spark, store).count() == 0
    assert rollup.commit(spark, store, "one", rollup.signed(counts, 1))
    assert not rollup.commit(spark, store, "one", rollup.signed(counts, 1))
    want = Counter()
    for r in docs.collect():
        want[r["source"], r["lang"], "byte_bpe_50k"] += len(ids_of(r["text"]))
        want[r["source"], r["lang"], "words"] += len((r["text"] or "").split())
    got = {(r["source"], r["lang"], r["tokenizer"]): r["n_tokens"] for r in rollup.totals(spark, store).collect()}
    assert got == dict(want)
    gone = counts.where("doc_id = 3")
    assert rollup.commit(spark, store, "two", rollup.revised(gone.withColumn("n_revised", F.lit(7).cast("long"))))
    assert rollup.commit(spark, store, "three", rollup.signed(counts, -1))
    left = rollup.totals(spark, store).agg(F.sum("n_docs"), F.sum("n_tokens")).first()
    old = sum(r["n_tokens"] for r in gone.collect())
    assert tuple(left) == (0, 14 - old)
    with pytest.raises(ValueError):
        rollup.commit(spark, store, "../x", counts)


def test_rollup_revision(spark, docs, empty):
    once = rollup.without_repeated_lines()
    counts = rollup.bpe_counts(docs, revision=once).unionByName(rollup.word_counts(docs, revision=once))
    want = Counter()
    for r in docs.collect():
        new = None if r["text"] is None else "\n".join(dict.fromkeys(r["text"].split("\n")))
        want[r["doc_id"], "byte_bpe_50k", len(ids_of(r["text"])), len(ids_of(new))] += 1
        want[r["doc_id"], "words", len((r["text"] or "").split()), len((new or "").split())] += 1
    assert Counter((r["doc_id"], r["tokenizer"], r["n_tokens"], r["n_revised"]) for r in counts.collect()) == want
    assert rollup.bpe_counts(empty, revision=once).count() == 0 and rollup.word_counts(empty, revision=once).count() == 0


def test_rollup_commits(spark):
    store = new_path(spark, "store")
    row = lambda n: spark.createDataFrame([("a", None, "t", 1, n), ("b", "x", "t", 1, None)], rollup.DELTA)
    sums = lambda: sorted(((r["source"], r["n_docs"], r["n_tokens"]) for r in rollup.totals(spark, store).collect()))
    assert not rollup.compact(spark, store)
    assert rollup.commit(spark, store, "one", row(5))
    # A writer that broke before its rename, and one that wrote while the other published.
    row(100).write.parquet(f"{store}/_temporary-broken")
    row(100).write.parquet(f"{store}/_temporary-late")
    assert not rollup._publish(spark, f"{store}/_temporary-late", f"{store}/batch-one")
    assert sums() == [("a", 1, 5), ("b", 1, 0)]
    assert rollup.commit(spark, store, "none", row(1).limit(0))
    assert rollup.compact(spark, store) and not rollup.compact(spark, store)
    assert sums() == [("a", 1, 5), ("b", 1, 0)]
    assert rollup.commit(spark, store, "two", row(7)) and not rollup.commit(spark, store, "one", row(9))
    assert sums() == [("a", 2, 12), ("b", 2, 0)]
    assert rollup.compact(spark, store) and sums() == [("a", 2, 12), ("b", 2, 0)]
    assert rollup.commit(spark, store, "back", rollup.signed(row(12).withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0))), -1))
    assert sums() == [("a", 1, 0), ("b", 1, 0)]


# --- packing -----------------------------------------------------------------------------------------


def test_differencing():
    rng = random.Random(2)
    for n, k in ((1, 1), (5, 2), (40, 6), (300, 40)):
        sizes = [rng.randint(1, 256) for _ in range(n)]
        slots = packing.difference(sizes, k)
        assert sorted(i for s in slots for i in s) == list(range(n))
        if n >= 5 * k:
            sums = [sum(sizes[i] for i in s) for s in slots]
            assert max(sums) - min(sums) <= 30
    assert packing.deal([600, 600, 600], 1024) and len(packing.deal([600, 600, 600], 1024)) == 3


def test_packing(spark, docs, empty):
    long_texts = spark.createDataFrame([(900 + i, " ".join(make_texts(40, i)[:40])) for i in range(12)], "doc_id long, text string")
    df = docs.select("doc_id", "text", F.lit(1).alias("start"), F.lit(2).alias("a.b")).unionByName(
        long_texts.selectExpr("doc_id", "text", "1 as start", "2 as `a.b`")
    ).repartition(2)
    rows = packing.pack(df, windows=4).collect()
    want, total = Counter(), 0
    for r in df.collect():
        want[r["doc_id"], tuple(ids_of(r["text"]) + [0])] += 1
        total += len(ids_of(r["text"])) + 1
    parts, windows = {}, {}
    for r in rows:
        ids = tuple(np.frombuffer(r["ids"], "<u4").tolist())
        assert len(ids) == r["length"] > 0
        parts.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 1024
    # Every id of every row lies in one piece, repeated rows included.
    for (doc, n), pieces in parts.items():
        texts = {t: k for (d, t), k in want.items() if d == doc and len(t) == n}
        cells, expected = Counter(), Counter()
        for start, ids in pieces:
            cells.update((start + i, x) for i, x in enumerate(ids))
        for t, k in texts.items():
            expected.update({(i, x): k for i, x in enumerate(t)})
        assert cells == expected
    assert sum(r["length"] for r in rows) == total
    tasks = df.rdd.getNumPartitions()
    assert len(windows) <= total / 1024 * 1.05 + 2 * tasks
    assert packing.pack(empty).count() == 0 and packing.pack(df.limit(0)).count() == 0


def test_window_count_rises():
    rng = random.Random(11)
    for sizes in ([700] * 9, [513] * 5, [1000, 30, 30, 900, 200, 124], [rng.randint(300, 800) for _ in range(60)], [1024] * 3, [1]):
        slots = packing.deal(sizes, 1024)
        assert sorted(i for s in slots for i in s) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in s) <= 1024 for s in slots)
        assert len(slots) >= -(-sum(sizes) // 1024)
    assert len(packing.deal([700] * 9, 1024)) == 9 > -(-6300 // 1024)


# --- archives --------------------------------------------------------------------------------------------


def test_archives(spark):
    rng = random.Random(4)
    bodies = ["<p>" + " ".join(rng.choices(WORDS, k=300)) + "</p>" for _ in range(6)] + ["", None]
    rows = [(i, f"http://h/{i}" if i % 5 else None, bodies[i % 8] if i % 3 else f"own {i} é") for i in range(60)]
    rows += [rows[1], (None, "x", bodies[1]), (None, "x", bodies[1]), (None, None, None), (None, "y", "z"), (61, "u v\n", bodies[0])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    where = new_path(spark, "warc")
    listed = warc.write_archives(pages, where, roll_bytes=2000)
    assert len(listed) > 4 and files.manifest(where) == listed
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    got = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_digest"], r["payload_bytes"]) for r in warc.read_archives(spark, where).collect())
    want, seen = Counter(), set()
    for p, _, h in rows:
        again = p is not None and (p != first[h or ""] or (p, h) in seen)
        seen.add((p, h))
        body = (h or "").encode()
        want[p, "revisit" if again else "response", first[h or ""] if again else None, warc.digest(body), len(body)] += 1
    assert got == want
    other = new_path(spark, "warc")
    warc.write_archives(pages, other, roll_bytes=2000)
    read = lambda d: [files.open_fs(files.join(d, f["name"]))[0].open_input_stream(files.open_fs(files.join(d, f["name"]))[1], compression=None).read() for f in files.manifest(d)]
    assert read(where) == read(other)
    ids = [r["headers"]["warc-record-id"] for d in [where] for f in files.manifest(d) for r in warc.parse(files.open_fs(files.join(d, f["name"]))[0].open_input_stream(files.open_fs(files.join(d, f["name"]))[1], compression=None))]
    assert len(ids) == len(set(ids)) == len(rows)
    with pytest.raises(TypeError):
        warc.write_archives(pages.withColumn("page_id", F.col("page_id").cast("string")), new_path(spark, "warc"))
    odd = pages.select(F.col("page_id").alias("a.b"), "url", "html", F.lit(1).alias("step"), F.lit(2).alias("spread"), F.lit(3).alias("refers_to"))
    elsewhere = new_path(spark, "warc")
    warc.write_archives(odd, elsewhere, page_id="a.b")
    assert warc.read_archives(spark, elsewhere).count() == len(rows)
    nothing = new_path(spark, "warc")
    assert warc.write_archives(pages.limit(0), nothing) == [] and warc.read_archives(spark, nothing).count() == 0


# --- token files --------------------------------------------------------------------------------------------


def test_codes_round_trip():
    rng = np.random.default_rng(1)

    class Source:
        def __init__(self, raw):
            self.raw = raw

        def read_at(self, size, offset):
            return self.raw[offset : offset + size]

    for n, top in ((1, 10), (600, 200), (5000, 70000), (3000, 1 << 31)):
        ids = rng.integers(0, top, n)
        reader = directcodes.Reader(Source(directcodes.to_bytes(np.array([4]), np.array([0, n]), ids)))
        assert reader.tokens().tolist() == ids.tolist()
        for i in rng.integers(0, n, 200):
            assert reader.token(int(i)) == ids[i]


def test_token_files(spark, docs, empty):
    where = new_path(spark, "ids")
    listed = directcodes.write_files(docs, where, file_tokens=900)
    assert len(listed) > 3
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    ids = [ids_of(r["text"]) + [2] for r in rows]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    got = directcodes.read_files(spark, where).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in got] == [(r["doc_id"], starts[i], len(ids[i])) for i, r in enumerate(rows)]
    assert [zlib.crc32(r["ids"]) for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    flat = sum(ids, [])
    for i in (0, 1, 899, 900, len(flat) // 2, len(flat) - 1):
        assert directcodes.token_at(spark, where, i) == flat[i]
    with pytest.raises(TypeError):
        directcodes.write_files(docs.withColumn("doc_id", F.col("doc_id").cast("string")), new_path(spark, "ids"))
    some = [(None, "a"), (None, "b"), (-(1 << 63), "c"), (0, "d"), (None, None), (0, "d")]
    least = new_path(spark, "ids")
    directcodes.write_files(spark.createDataFrame(some, "`a.b` long, text string"), least, doc_id="a.b")
    got = directcodes.read_files(spark, least).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, None, -(1 << 63), 0, 0]
    nothing = new_path(spark, "ids")
    assert directcodes.write_files(empty, nothing) == [] and directcodes.read_files(spark, nothing).count() == 0


# --- decontamination -------------------------------------------------------------------------------------------


def contaminated(text, items, window):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, t in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        size = min(window, len(own))
        wanted = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in wanted:
                hit |= set(range(i, i + size))
                found.add(item)
    return len(words), len(hit), sorted(x for x in found if x is not None)


@pytest.mark.parametrize("short", [False, True])
def test_decontamination(spark, docs, short):
    rng = random.Random(9)
    own = [" ".join(rng.choices(WORDS, k=25)) for _ in range(6)]
    items = [(1, own[0]), (2, own[1]), (3, own[0]), (4, None), (5, ""), (6, "Alpha-beta GAMMA" if short else own[2]), (10, own[3][:60])]
    items += [(7, "rho pi"), (8, "漢字")] if short else []
    texts = [f"{own[5]} {own[0].upper()} tail", own[1][10:90], f"{own[2]}, {own[2]}", own[4], own[3] + ". " + own[0]]
    rows = [(100 + i, t) for i, t in enumerate(texts)] + [(r["doc_id"], r["text"]) for r in docs.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("x")).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(df, bench)
    assert got.columns == ["doc_id", "text", "n_words", "_n_words", "n_hit", "items", "spans", "contaminated"]
    rows = got.collect()
    assert len(rows) == df.count() and any(r["contaminated"] for r in rows)
    for r in rows:
        assert (r["_n_words"], r["n_hit"], sorted(r["items"])) == contaminated(r["text"], items, 10), r
    clean = decontaminate.decontaminate(df, bench.limit(0)).where("contaminated").count()
    assert clean == 0 and decontaminate.decontaminate(df.limit(0), bench).count() == 0


# --- urls -----------------------------------------------------------------------------------------------------


def test_urls(spark):
    page = '<link rel="canonical" href="{}"><p>x</p>'
    rows = [
        (1, "http://a.com/en/1", None),
        (2, "https://b.org/x?q=1#f", page.format("http://a.com/en/1")),  # alias of a blocked url
        (3, "http://c.org/", '<META http-equiv="refresh" content="0; url=https://b.org/x?q=1">'),
        (4, "http://ok.example.com/en/7/z", page.format("http://d.org/")),
        (5, "http://d.org/", page.format("http://a.com/en/2")),  # blocked and allowed aliases
        (6, "HTTP://NET.NET/de/8", None),
        (7, "http://x.example.net/de/88", None),
        (8, None, page.format("http://a.com/en/1")),
        (9, "no scheme", ""),
        (9, "no scheme", ""),
        (10, "http://free.io", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(0))
    rules = spark.createDataFrame(
        [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), (None, "/", "block")],
        "host string, path string, verdict string",
    )
    got = urlfilter.judge(pages, rules)
    assert got.columns == ["page_id", "url", "html", "host", "_host", "path", "rule", "verdict"] and got.count() == len(rows)
    by = {r["page_id"]: (r["_host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()}
    assert by[1] == ("a.com", "/en/1", "com/en/", "block")
    assert by[2] == ("b.org", "/x", None, "block") and by[3][3] == "block"
    assert by[4][2:] == ("example.com/en/7", "allow") and by[5][3] == "allow"
    assert by[6] == ("net.net", "/de/8", "net/de/", "allow") and by[7][2:] == ("example.net/de/8", "block")
    assert by[8] == ("", "", None, "allow") and by[9] == by[8] and by[10] == ("free.io", "", None, "allow")
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
    known = spark.createDataFrame([("http://free.io", "http://a.com/en/9")], "a string, b string")
    assert {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages, rules, known).collect()}[10] == "block"


def test_url_links(spark):
    from urllib.parse import urldefrag, urljoin

    page = "http://A.org/x/y?q=1"
    link = '<link rel="canonical" href="{}">'
    addresses = ["/en/7", "//b.com/en/7", "z", "./z", "../z?k=1", "../../../z/.", "?k=2", "http://c.com/v?url=http://d.com/", "/v?url=http://d.com/", "mailto:x@y.z", "#top", ""]
    rows = [(page, link.format(t)) for t in addresses]
    rows += [("http://e.com", link.format("en/1")), ("http://f.com/", f'<LINK title="{"x" * 5000}" rel=canonical href=/far>'), ("http://g.com/a", "<meta http-equiv='refresh' content='0; URL=/b'>")]
    want = {("A.org", t): urldefrag(urljoin(page, t))[0] for t in addresses[:9]}
    want = sorted(("a.org/x/y?q=1", u.split("://", 1)[1].replace("A.org", "a.org")) for u in want.values())
    want += [("e.com", "e.com/en/1"), ("f.com/", "f.com/far"), ("g.com/a", "g.com/b")]
    df = spark.createDataFrame(rows, "url string, html string")
    assert sorted(map(tuple, urlfilter.links_of(df).collect())) == sorted(want)


def test_url_links_of_html(spark):
    """Entities, base, quoted marks, comments, scripts and ports, as a browser reads them."""
    link = '<link rel="canonical" href="{}">'
    cases = {
        "http://a.io/1": (link.format("http://b.info/q?a=1&amp;b=2"), "b.info/q?a=1&b=2"),
        "http://a.io/2": (link.format("/q?x=&#233;&#x2F;&lt;&bogus;&#1114112;"), "a.io/q?x=\u00e9/<&bogus;&"),
        "http://a.io/d/3": ('<BASE target=x><base href="http://B.org:80/e/f"><base href="/no">' + link.format("g?h"), "b.org/e/g?h"),
        "http://a.io/d/4": ("<base href='../up/'>" + link.format("x"), "a.io/up/x"),
        "http://a.io/5": ('<link title="a>b" rel="x canonical" data-href="/no" href=" /yes ">', "a.io/yes"),
        "http://a.io/6": ("<!-- " + link.format("/no") + " -->" + link.format("/six"), "a.io/six"),
        "http://a.io/7": ("<script>'" + link.format("/no") + "'</script><!-- " + link.format("/no"), None),
        "https://a.io:443/8": (link.format("//c.io:443/x"), "c.io/x"),
        "http://a.io:80/9": (link.format("https://c.io:80/x"), "c.io:80/x"),
        "http://a.io/10": ('<meta content="5; url=/ten" HTTP-EQUIV=refresh><meta name=refresh content="0;url=/no">', "a.io/ten"),
        "http://a.io/11": ("<link rel=canonical href=/eleven title='" + "y" * 200_000 + "'>", "a.io/eleven"),
        "http://a.io/12": ("<link rel=canonical><link href=/no><link rel='canonicalx' href='/no'>", None),
    }
    df = spark.createDataFrame([(u, h) for u, (h, _) in cases.items()], "url string, html string")
    node = lambda u: u.split("://")[1].replace("a.io:443/", "a.io/").replace("a.io:80/", "a.io/")
    want = {node(u): b for u, (_, b) in cases.items() if b is not None}
    want["a.io/2"] = "a.io/q?x=\u00e9/<&bogus;&"
    assert {r["a"]: r["b"] for r in urlfilter.links_of(df).collect()} == want


def test_rules_of_one_host(spark):
    """Many rules of a host: each place meets those that fit, the longest wins."""
    rules = spark.range(20_000).selectExpr("'hot.com' as host", "concat('/p', id) as path", "if(id % 2 = 0, 'block', 'allow') as verdict")
    places = spark.createDataFrame([("a.hot.com", "/p12/x"), ("hot.com", "/p"), ("hot.com", "/p19999"), ("cold.com", "/p1")], "host string, path string")
    got = {(r["host"], r["path"]): (r["rule"], r["decision"]) for r in urlfilter.match_rules(places, rules).collect()}
    assert got == {("a.hot.com", "/p12/x"): ("hot.com/p12", "block"), ("hot.com", "/p19999"): ("hot.com/p19999", "allow")}


def test_url_rows_of_sql(spark):
    """The registered SQL and the query over one table of made links."""
    import duckdb

    link = lambda t, rel='rel="canonical"': f'<p><link {rel} href="{t}"></p>'
    rows = [("http://a.com/en/1", None), ("http://x.io/1", link("http://A.com/en/1#f")), ("http://x.io/2", link("/1")), ("http://x.io/3", link("2"))]
    rows += [("http://y.io/d/1", link("../d/./2")), ("http://y.io/d/2", link("//b.com/en/5")), ("http://y.io/d/3?q", link("?q=2")), ("http://y.io/d/3?q=2", link("http://b.com/en/5"))]
    rows += [("http://z.io/1", link("http://a.com/en/1", 'rel="alternate canonical"')), ("http://z.io/2", '<link data-href="http://q.io/" rel=canonical href="/1">')]
    rows += [("http://z.io/3", link("http://a.com/en/1", 'rel="canonical-not"')), ("http://z.io/4", link("http://a.com/en/1", 'data-rel="canonical"'))]
    rows += [("http://w.io/1", f'<link title="{"x" * 9000}" rel="canonical" href="http://a.com/en/9">'), ("http://w.io/2", "<meta http-equiv='Refresh' content='3; URL=/1'>")]
    rows += [("http://v.io/1", link("mailto:a@b.c")), ("http://v.io/2", link("#top")), ("http://v.io/3", link("http://ok.example.com/en/7")), ("http://v.io/4", link("http://a.com/en/77") + link("/3"))]
    rows += [(f"http://c.io/{i}", link(str(i + 1))) for i in range(30)] + [("http://c.io/30", link("http://a.com/en/30"))]
    rows += [(f"http://h{i}.io/", link("http://hub.org/es/1")) for i in range(40)]
    rows += [(None, link("http://a.com/en/1")), ("no scheme", link("/1")), ("http://a.net/de/1", ""), ("http://b.example.net/de/88", "x"), rows[1]]
    where = new_path(spark, "pages")
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"{where}/pages.parquet")
    got = queries.op8_url_filters(spark, where)
    found = Counter(map(tuple, got.collect()))
    db = duckdb.connect()
    db.sql(f"create view pages as select * from '{where.removeprefix('file://')}/pages.parquet/*.parquet'")
    want = db.sql(queries.ORACLES["op8_url_filters"])
    assert found == Counter(want.select(*got.columns).fetchall())
    verdicts = {r["page_id"]: r["verdict"] for r in got.collect()}
    blocked = {rows[i][0] for i, v in verdicts.items() if v == "block"}
    assert {"http://x.io/3", "http://y.io/d/1", "http://y.io/d/3?q", "http://z.io/1", "http://z.io/2", "http://w.io/2", "http://c.io/0", "http://h7.io/"} <= blocked
    assert not {"http://z.io/3", "http://z.io/4", "http://v.io/1", "http://v.io/2", "http://v.io/3", "http://v.io/4", "no scheme"} & blocked


def test_url_hub(spark):
    """A hub of 100,000 aliases, a chain, empty rules and a page of many megabytes."""
    n = 100_000
    pages = spark.range(0, n, 1, 8).selectExpr("id as page_id", "concat('http://h', id, '.io/') as url", "'<link rel=canonical href=http://hub.org/es/1>' as html")
    far = spark.createDataFrame([(n, "http://far.io/", "<p>" + "x " * 2_000_000 + '</p><link rel="canonical" href="http://h5.io/">')], pages.schema)
    rules = spark.createDataFrame([("org", "/es/", "block")], "host string, path string, verdict string")
    got = urlfilter.judge(pages.unionByName(far), rules, keep=["page_id"])
    assert {(r["verdict"], r["count"]) for r in got.groupBy("verdict").count().collect()} == {("block", n + 1)}
    assert urlfilter.judge(far, rules.limit(0), keep=["page_id"]).collect()[0]["verdict"] == "allow"


# --- classifier -------------------------------------------------------------------------------------------------


def test_machine_identity():
    rng = np.random.default_rng(0)
    m = factorization.Machine(np.sort(rng.random((factorization.STATISTICS, factorization.BINS)), axis=1))
    m.linear[:] = rng.normal(size=m.linear.shape)
    found = [factorization.features(t, 5) for t in ("a b c a", None, "Long words! # here | and there")]
    index, value, starts = m.rows(found)
    for score, lo, hi in zip(m.scores(found), starts, starts[1:]):
        i, x = index[lo:hi], value[lo:hi]
        z = m.bias + (m.linear[i] * x).sum() + sum(
            float(m.vectors[i[a]] @ m.vectors[i[b]] * x[a] * x[b]) for a, b in itertools.combinations(range(len(i)), 2)
        )
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-4


def test_classifier_held_out(spark, docs, empty):
    sf = "/root/testdata/sf0.1"
    corpus, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    machine = factorization.train(corpus, labels)
    scored = factorization.score(corpus, machine, keep=["doc_id"]).join(labels, "doc_id")
    held = scored.where(factorization.held_out(F.col("doc_id"))).select("score", "quality").collect()
    right = sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in held)
    good = [r["score"] for r in held if r["quality"] == 1]
    poor = [r["score"] for r in held if r["quality"] == 0]
    order = sum((g > p) + 0.5 * (g == p) for g in good for p in poor) / (len(good) * len(poor))
    assert right / len(held) > 0.9 and order > 0.9
    out = factorization.score(docs, machine)
    assert out.columns == [*docs.columns, "_score"] and out.count() == docs.count()
    assert all(0 <= r["_score"] <= 1 for r in out.collect())
    assert factorization.score(empty, machine).count() == 0
    nothing = factorization.train(corpus, labels.limit(0))
    assert factorization.score(docs, nothing).count() == docs.count()


# --- near-duplicates -----------------------------------------------------------------------------------------------


def plain_fingerprint(text, n=4):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((1 << b) for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(points, radius):
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(points, 2):
        if (a ^ b).bit_count() <= radius:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in points}


def test_vantage_tree():
    rng = random.Random(8)
    for centre_count, near in ((600, 0), (5, 150), (200, 3)):
        points = set()
        for _ in range(centre_count):
            c = rng.getrandbits(64)
            points.add(c)
            for _ in range(near):
                p = c
                for b in rng.sample(range(64), rng.randint(1, 9)):
                    p ^= 1 << b
                points.add(p)
        points = sorted(points)
        forest = simhash.Forest(np.array(points, np.uint64), 4)
        forest.grow(np.arange(len(points)))
        got = {}
        for p, k in zip(points, forest.label.tolist()):
            got.setdefault(k, set()).add(p)
        want = {}
        for p, k in classes(points, 4).items():
            want.setdefault(k, set()).add(p)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
        a, _ = forest.edges()
        assert len(a) == len(points) - len(got)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000, i) for i in range(1001, 1080)]
    edges += [(i, i + 1) for i in range(2000, 2040)] + [(5, 5), (None, 3), edges[0]]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    assert got == {x: find(x) for x in root}
    assert components.connected_components(df.limit(0)).count() == 0


def test_near_duplicates(spark, docs, empty):
    texts = make_texts()
    long_text = " ".join(random.Random(1).choices(WORDS, k=900))
    more = [(200 + i, long_text.replace("alpha", "omega", i)) for i in range(4)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = df.collect()
    prints = {(r["doc_id"], r["text"]): plain_fingerprint(r["text"]) for r in rows}
    by = classes(sorted(set(prints.values())), 4)
    least = {}
    for (d, _), p in prints.items():
        if d is not None:
            least[by[p]] = min(least.get(by[p], d), d)
    want = Counter((d, prints[d, t], least.get(by[prints[d, t]])) for d, t in ((r["doc_id"], r["text"]) for r in rows))
    got = Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == want and len(texts) > 60
    assert simhash.near_duplicates(empty).count() == 0
    named = simhash.near_duplicates(docs, keep=["fp", "text", "doc_id"])
    assert named.columns == ["fp", "text", "doc_id", "_fp", "root", "component_id"]
    assert Counter((r["doc_id"], r["_fp"]) for r in named.collect()) == Counter(
        (r["doc_id"], r["fp"]) for r in simhash.near_duplicates(docs).collect()
    )


@pytest.mark.parametrize("limit", [100000, 40])
def test_links_of_large_shards(spark, limit):
    rng = random.Random(6)
    points = {0}
    for centre, near in ((rng.getrandbits(64), 150), (rng.getrandbits(64), 60), (5, 40)):
        for _ in range(near):
            p = centre
            for b in rng.sample(range(64), rng.randint(0, 9)):
                p ^= 1 << b
            points.add(p)
    points |= {rng.getrandbits(64) for _ in range(300)}
    points |= {(7 << 50) + i * 4096 + rng.getrandbits(10) for i in range(300)}  # most blocks are equal
    signed = [(int(np.uint64(p).view(np.int64)),) for p in points]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), 4, limit=limit).collect()
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for r in edges:
        a, b = r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1
        assert (a ^ b).bit_count() <= 4
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {p: find(p) for p in points} == classes(sorted(points), 4)


def plain_sets(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or (frozenset([tuple(words)]) if words else frozenset())


def similar_groups(texts):
    sets = [plain_sets(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if (not a and not b) or len(a & b) >= 0.8 * len(a | b) > 0:
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("limit", [1_000_000, 3000])
def test_similar_documents(spark, limit):
    rng = random.Random(12)
    texts = make_texts()
    for n, copies in ((60, 3), (200, 4), (300, 60)):
        words = [f"w{rng.randint(0, 400)}" for _ in range(n)]
        texts.append(" ".join(words))
        for _ in range(copies):
            changed = list(words)
            for i in rng.sample(range(n), rng.randint(1, max(2, n // 40))):
                changed[i] = f"v{rng.randint(0, 10**6)}"
            texts.append(" ".join(changed).upper() if rng.random() < 0.5 else " ".join(changed))
    want = similar_groups(texts)
    assert len({w for w in want}) < len(texts) - 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["root"] for r in simhash.similar_documents(df, limit=limit).collect()}
    first = {}
    for i in range(len(texts)):
        first.setdefault(got[i], i)
    assert [first[got[i]] for i in range(len(texts))] == want


def test_repeated_phrases(spark):
    """A phrase sixty times over moves the fingerprint, not the set of shingles: no pair is lost."""
    rng = random.Random(4)
    rows = []
    for i in range(40):
        text = " ".join(f"w{rng.randrange(5000)}" for _ in range(80))
        phrase = " ".join(f"p{i}x{k}" for k in range(5))
        rows += [(2 * i, text), (2 * i + 1, f"{text} " + " ".join([phrase] * 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2]))
    assert [r["doc_id"] for r in simhash.keep_one(df).orderBy("doc_id").collect()] == [2 * i for i in range(40)]



def test_keep_one(spark, docs, empty):
    rows = docs.collect()
    groups = similar_groups([r["text"] for r in rows])
    least = {}
    for g, r in zip(groups, rows):
        if r["doc_id"] is not None:
            least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect())
    assert ids == sorted((least.get(g) is None, least.get(g)) for g in set(groups))
    assert simhash.keep_one(empty).count() == 0
    odd = docs.select("doc_id", "text", F.lit(1).alias("row"), F.lit(2).alias("id"), F.lit(3).alias("row_key"), F.lit(4).alias("a.b"))
    assert simhash.keep_one(odd).columns == odd.columns and simhash.keep_one(odd).count() == len(ids)


def test_digests_are_stated_ones():
    assert warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def plain_classes(points, radius):
    """The least point that links of at most ``radius`` bits reach, for points of any width."""
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(points, 2):
        if (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count() <= radius:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in points}


@pytest.mark.parametrize("limit", [100000, 40])
def test_candidates_are_what_the_trees_join(spark, limit):
    rng = random.Random(21)
    points = [bytes(32), b"\xff" * 32]  # all bits differ
    for near in (120, 60, 1, 1, 0, 0):
        centre = rng.getrandbits(256)
        for _ in range(near + 1):
            p = centre
            for b in rng.sample(range(256), rng.randint(0, 90)):
                p ^= 1 << b
            points.append(p.to_bytes(32, "little"))
    points += [rng.randbytes(32) for _ in range(150)]
    df = spark.createDataFrame([(bytearray(p), False) for p in points], "print binary, tiny boolean").repartition(3)
    blocks, common = simhash.tree_blocks(len(points))
    assert blocks.shape == (1, 0) and common == 1
    edges = [(bytes(r["a"]), bytes(r["b"])) for r in simhash.candidates(df, blocks, common, limit).collect()]
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {p: find(p) for p in points} == plain_classes(sorted(points), simhash.RADIUS)


def test_wide_prints():
    """A bit of the wide fingerprint is the majority's over the different, mixed hashes; sets of
    similarity 0.8 lie within the radius and share a path of some tree."""
    rng = random.Random(2)
    assert simhash.wide_print(np.zeros(0, np.uint64)) == bytes(32)
    for n in (1, 4, 300, 700):
        hashes = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
        own = np.frombuffer(simhash.wide_print(hashes), "<u8")
        for k, word in enumerate(own.tolist()):
            mixed = []
            for h in hashes.tolist():
                m = (h ^ int(simhash._SEEDS[0][k])) * (int(simhash._SEEDS[1][k]) | 1) & (1 << 64) - 1
                m = (m ^ m >> 32) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
                mixed.append(m ^ m >> 29)
            assert word == sum((1 << b) for b in range(64) if 2 * sum(m >> b & 1 for m in mixed) > n)
    for size, common, tiny in ((5, 4, True), (14, 13, False), (90, 80, False)):
        other = size if size == 90 else common
        left, right = [], []
        for _ in range(1000):
            hashes = np.array([rng.getrandbits(64) for _ in range(2 * size)], np.uint64)
            left.append(simhash.wide_print(hashes[:size]))
            right.append(simhash.wide_print(np.concatenate([hashes[:common], hashes[size : size + other - common]])))
        a, b = (np.unpackbits(simhash._words(p).view(np.uint8), axis=1, bitorder="little") for p in (left, right))
        assert ((a != b).sum(1) <= simhash.RADIUS).mean() > 0.999
        for n in (5_000, 400_000):
            blocks, every = simhash.tree_blocks(n)
            used = blocks if tiny else blocks[:every]
            shared = np.any([(a[:, k] == b[:, k]).all(1) for k in used], axis=0)
            assert shared.mean() > 0.99 and len(blocks) >= every > 1


def test_pairs_that_least_hashes_missed(spark):
    """Pairs of similarity 0.8 of which none shared a band of least shingle hashes."""
    rows = []
    for i in (12, 407, 1585, 2356, 2463, 3639, 5567):
        rng = random.Random(i)
        w = [f"w{rng.randrange(5000)}" for _ in range(104)]
        rows += [(2 * i, " ".join(w[:94])), (2 * i + 1, " ".join(w[:84] + [f"x{k}" for k in range(10)]))]
    assert similar_groups([t for _, t in rows]) == [k - k % 2 for k in range(14)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == [d for d, _ in rows[::2]]


@pytest.mark.parametrize("limit", [1_000_000, 3000])
def test_similar_documents_below_many_paths(spark, limit):
    """Paths of several bits: each tree holds a part of the pairs, all trees hold them all."""
    rng = random.Random(13)
    texts = make_texts()
    for n, copies in [(60, 3), (200, 4), (300, 60)] + [(80, 1)] * 60:
        words = [f"w{rng.randint(0, 4000)}" for _ in range(n)]
        texts.append(" ".join(words))
        for _ in range(copies):
            changed = list(words)
            for i in rng.sample(range(n), rng.randint(1, max(1, n // 60))):
                changed[i] = f"v{rng.randint(0, 10**6)}"
            texts.append(" ".join(changed))
    want = similar_groups(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert simhash.tree_blocks(200, fill=8)[0].shape[1] == 5
    got = {r["doc_id"]: r["root"] for r in simhash.similar_documents(df, limit=limit, fill=8).collect()}
    first = {}
    for i in range(len(texts)):
        first.setdefault(got[i], i)
    assert [first[got[i]] for i in range(len(texts))] == want
