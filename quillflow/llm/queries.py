"""The operators' queries: thin digests of each operator's own output, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversations,
    decontaminate,
    directcodes,
    factorization,
    licences,
    packing,
    quality,
    resampling,
    rollup,
    secrets,
    simhash,
    url_sql,
    urlfilter,
    warc,
)
from .common import new_path, table, written

#: host, path, verdict
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
QUALITY_LIMIT = 0.3


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), keep=["doc_id"], with_text=False)


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of each document: paragraphs, statements found, confirmed families."""
    docs = table(spark, sf_dir, "documents")
    found = licences.scan(docs, licences.train(docs), keep=["doc_id"])
    confirmed = F.filter("licences", lambda x: x["confirmed"])
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("licences").cast("long").alias("n_statements"),
        F.size(confirmed).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(confirmed["family"])), ",").alias("families"),
    )


def op3_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches, one of them committed twice: all documents inserted under
    two tokenizer versions, poor documents deleted, toxic ones revised to unrepeated lines."""
    docs, store = table(spark, sf_dir, "documents"), new_path(spark, "rollups")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    once = rollup.without_repeated_lines()
    counts = rollup.bpe_counts(docs, revision=once).unionByName(rollup.word_counts(docs, revision=once))
    # Merged at every size: ids and counts only, no text.
    counts = written(counts.join(labels.hint("merge"), "doc_id", "left"), "token-counts")
    rollup.commit(spark, store, "load", rollup.signed(counts, 1))
    rollup.commit(spark, store, "poor", rollup.signed(counts.where("quality = 0"), -1))
    rollup.commit(spark, store, "revision", rollup.revised(counts.where("toxic = 1 and quality = 1")))
    rollup.commit(spark, store, "load", rollup.signed(counts, 1))
    return rollup.totals(spark, store)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "start",
        "length",
        packing.ids_crc32(F.col("ids")).alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), directory)
    return warc.read_archives(spark, directory).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = new_path(spark, "token-files")
    directcodes.write_files(table(spark, sf_dir, "documents"), directory)
    return directcodes.read_files(spark, directory).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]
    )
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules, keep=["page_id"])


def url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter over all pages with made links of every kind, as the table itself has none."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    linked = table(spark, sf_dir, "pages").selectExpr("page_id", f"{url_sql.LINKED_URL} as url", f"{url_sql.LINKED_HTML} as html")
    return urlfilter.judge(linked, rules, keep=["page_id"])


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = factorization.train(docs, table(spark, sf_dir, "labels"))
    return factorization.score(docs, machine, keep=["doc_id"]).select(
        "doc_id",
        factorization.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_LIMIT).cast("int").alias("predicted"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "doc_id",
        *[secrets.n_of(F.col("base"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
        "n_live",
        "n_example",
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every original conversation after damage and repair; without rows after damage zeros, an
    empty audit and the hash of nothing."""
    stated = table(spark, sf_dir, "conversations")
    audits, repaired = conversations.repair(conversations.damage(stated))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = [F.lit(0).cast("long").alias(c) for c in counts]
    rows = (
        stated.select(F.col("conv_id").alias("conv"), *nothing, F.lit("").alias("audit")).distinct()
        .unionByName(audits)
        .unionByName(conversations.digests(repaired), allowMissingColumns=True)
    )
    none = hashlib.sha256(b"").hexdigest()
    return rows.groupBy(F.col("conv").alias("conv_id")).agg(
        *[F.max(c).alias(c) for c in [*counts, "audit"]], F.coalesce(F.max("repaired_sha256"), F.lit(none)).alias("repaired_sha256")
    )


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resampling.resample(docs, target, keep=["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_licence_scan,
        op3_token_rollups,
        op4_packing,
        op5_warc,
        op6_token_files,
        op7_decontamination,
        op8_url_filters,
        op9_quality_classifier,
        op10_simhash,
        op11_secret_scan,
        op12_conversation_repair,
        op13_importance_resampling,
        url_aliases,
    )
}

_OP1 = r"""
with d as (
  select row_number() over () rid, doc_id, source, text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda w: w <> '') w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) l
  from documents),
n as (
  select *, list_transform(l, lambda x: trim(regexp_replace(regexp_replace(lower(x), '[ \x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g'), ' ')) nl
  from d),
ex as (select rid, source, unnest(list_distinct(nl)) line, text document from n),
often as (
  select e.source, line, count(distinct document) n_docs
  from ex e group by 1, 2),
above as (
  select source, line from often
  where n_docs > case when len(string_split(line, ' ')) >= 30 then 3 else 50 end),
cut as (
  select rid, pos, line from (select rid, source, unnest(string_split(text, chr(10))) line,
                                     generate_subscripts(string_split(text, chr(10)), 1) pos from n where text is not null) x
  where regexp_matches(line, '[^ \x09-\x0D]') and exists (
    select 1 from above a where a.source is not distinct from x.source and
      a.line = trim(regexp_replace(regexp_replace(lower(x.line), '[ \x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g'), ' '))),
cuts as (
  select rid, count(*) n_removed,
         sum(len(list_filter(regexp_split_to_array(line, '[ \x09-\x0D]+'), lambda w: w <> ''))) words_removed
  from cut group by 1),
g as (
  select rid, i, array_to_string(w[i:i+7], ' ') gram
  from (select rid, w, unnest(range(1, len(w) - 6)) i from d where len(w) >= 8)),
r as (
  select rid, count(distinct p) n from (
    select g.rid, unnest(range(g.i, g.i + 8)) p
    from g join (select rid, gram from g group by 1, 2 having count(*) > 1) k using (rid, gram))
  group by 1),
s as (
  select n.doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
         (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(r.n, 0)::bigint n_repeat_words,
         coalesce(c.n_removed, 0)::bigint n_removed_lines, (len(w) - coalesce(c.words_removed, 0))::bigint n_words_left
  from n left join r using (rid) left join cuts c using (rid)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       n_removed_lines, n_words_left,
       not base_failed and not (n_removed_lines > 0 and n_words_left < 10) kept
from b
"""

_OP5 = r"""
with h as (select page_id, coalesce(html, '') html from pages),
x as (select page_id, sha1(html) h, strlen(html)::bigint payload_bytes from h),
f as (select h, min(page_id) first_id from x group by 1),
b as (
  select x.page_id, payload_bytes, first_id,
    array_to_string(list_transform(range(1, 41), lambda j: substr(
      '0000000100100011010001010110011110001001101010111100110111101111',
      (4 * (strpos('0123456789abcdef', substr(x.h, j, 1)) - 1) + 1)::bigint, 4)), '') bits
  from x join f using (h))
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + 16 * substr(bits, 5 * i + 1, 1)::int + 8 * substr(bits, 5 * i + 2, 1)::int + 4 * substr(bits, 5 * i + 3, 1)::int
     + 2 * substr(bits, 5 * i + 4, 1)::int + substr(bits, 5 * i + 5, 1)::int)::bigint, 1)), '') payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end record_type,
  case when page_id <> first_id then first_id end refers_to
from b
"""

_OP7 = r"""
with d as (
  select row_number() over () rid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') w from documents),
b as (
  select item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') w from benchmark),
bw as (
  select distinct item_id, size, array_to_string(w[i:i+size-1], ' ') g
  from (select item_id, w, least(10, len(w)) size, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from b where len(w) > 0)),
dw as (
  select rid, size, i, array_to_string(w[i:i+size-1], ' ') g
  from (select rid, w, size, unnest(range(1, len(w) - size + 2)) i
        from d, (select distinct size from bw) where len(w) >= size)),
m as (select rid, item_id, i, dw.size from dw join bw on dw.size = bw.size and dw.g = bw.g),
hit as (select rid, count(distinct p) n from (select rid, unnest(range(i, i + size)) p from m) group by 1),
it as (select rid, count(*) n, string_agg(item_id, ',' order by item_id) ids
       from (select distinct rid, item_id::varchar item_id from m) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(hit.n, 0)::bigint n_hit, coalesce(it.n, 0)::bigint n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(hit.n, 0) > 0 contaminated
from d left join hit using (rid) left join it using (rid)
"""

_OP11 = r"""
with d as (select row_number() over () rid, doc_id, source, lang, coalesce(text, '') text from documents),
k(kind, name, least, grp) as (values (0, 'assign', 6, 2), (1, 'access', 1, 0), (2, 'hex', 1, 0), (3, 'owned', 20, 0)),
cut as (
  select rid, kind, name, least, source, lang, text, whole, vals, string_split_regex(text, pattern) gaps
  from (
    select d.*, k.*, case kind when 0 then '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'
        when 1 then 'AKIA[A-Z0-9]{16,}' when 2 then '[0-9a-f]{24,}' else '[A-Za-z0-9+/_=-]+' end pattern,
      case kind when 0 then regexp_extract_all(text, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+')
        when 1 then regexp_extract_all(text, 'AKIA[A-Z0-9]{16,}') when 2 then regexp_extract_all(text, '[0-9a-f]{24,}')
        else regexp_extract_all(text, '[A-Za-z0-9+/_=-]+') end whole,
      case kind when 0 then regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)
        when 1 then regexp_extract_all(text, 'AKIA[A-Z0-9]{16,}') when 2 then regexp_extract_all(text, '[0-9a-f]{24,}')
        else regexp_extract_all(text, '[A-Za-z0-9+/_=-]+') end vals
    from d cross join k
    where case kind when 3 then regexp_matches(text, '[A-Za-z0-9+/_=-]{20}') else true end)
  where len(whole) > 0),
each as (
  select rid, kind, name, least, source, lang, text, generate_subscripts(whole, 1) i, unnest(whole) w, unnest(vals) v, unnest(gaps[1:len(whole)]) g from cut),
placed as (
  select *, sum(length(g) + length(w)) over (partition by rid, kind order by i)::bigint stop from each),
spans as (
  select *, stop - length(w) start from placed where length(v) >= least),
candidates as (
  select rid, kind, name, source, lang, v, start, stop,
    len(list_distinct(string_split(v, ''))) >= 8 and (kind < 3 or ((regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]'))
      or 4 * length(regexp_replace(v, '[^0-9]', '', 'g')) >= length(v)) and length(regexp_replace(v, '[^/]', '', 'g')) <= 2) drawn
  from spans
  where kind < 3 or (regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]')
    and not regexp_matches(substr(text, greatest(start - 1, 1), least(start, 2)), '^[A-Za-z0-9][.]$')
    and not regexp_matches(substr(text, stop + 1, 2), '^[.][A-Za-z0-9]$'))),
holders as (
  select v, sum(r) n_repositories, count(*) n_owners from (
    select v, source, count(*) r from (select distinct v, source, lang from candidates) group by v, source) group by v),
marked as (
  select c.*, n_owners <= 2 and n_repositories <= 4 and drawn live from candidates c join holders using (v)),
kept as (
  select * from marked m where kind < 3 or not exists (
    select 1 from marked b where b.rid = m.rid and b.kind < 3 and b.start < m.stop and m.start < b.stop)),
said as (
  select rid, count(*) filter (kind = 0) n_assign, count(*) filter (kind = 1) n_access, count(*) filter (kind = 2) n_hex,
    string_agg(name || ':' || start || ':' || stop, ',' order by start, kind) filter (kind < 3) base,
    string_agg(name || ':' || start || ':' || stop, ',' order by start, kind) filter (kind < 3 or live) spans,
    count(*) filter (live) n_live, count(*) filter (not live) n_example
  from kept group by 1)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex,
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, coalesce(n_live, 0) n_live, coalesce(n_example, 0) n_example
from d left join said using (rid)
"""

#: The checksum of a word's bytes: eight shifts for each bit pattern, from the polynomial alone.
_OP13 = r"""
with crc(t) as (
  select list(list_reduce(list_prepend(b::ubigint, range(8)::ubigint[]), lambda c, _: case when c % 2 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) order by b)
  from range(256) r(b)),
d as (
  select row_number() over () rid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') w from documents),
b as (
  select list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') w from benchmark),
dw as (select rid, unnest(w) word from d),
bw as (select unnest(w) word from b),
hashed as (
  select word, xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint,
      list_transform(range(1, length(hex(encode(word))) + 1, 2), lambda j:
        (16 * (strpos('0123456789ABCDEF', substr(hex(encode(word)), j, 1)) - 1) + strpos('0123456789ABCDEF', substr(hex(encode(word)), j + 1, 1)) - 1)::ubigint)),
      lambda c, x: xor(c >> 8, t[((xor(c, x) & 255) + 1)::bigint]))) % 10000 bucket
  from (select word from dw union select word from bw), crc),
n as (
  select bucket, sum(s)::bigint s, sum(t)::bigint t from (
    select bucket, count(*) s, 0 t from dw join hashed using (word) group by 1
    union all select bucket, 0, count(*) from bw join hashed using (word) group by 1) group by 1),
gain as (
  select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000) / ((s + 1)::double * (sum(t) over () + 10000))))::bigint g from n),
weighed as (select rid, sum(g)::bigint weight from dw join hashed using (word) join gain using (bucket) group by 1),
scored as (
  select rid, doc_id, len(w)::bigint n_features, coalesce(weight, 0)::bigint weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint score
  from (select *, list_reduce(list_transform(range(1, 9), lambda j: (strpos('0123456789abcdef', substr(sha256('2024:' || coalesce(doc_id::varchar, '')), j, 1)) - 1)::bigint),
    lambda a, x: 16 * a + x)::double h from d) left join weighed using (rid)),
drawn as (
  select rid, row_number() over (order by score desc, doc_id) r from scored where n_features >= 20)
select doc_id, n_features, weight, score,
  case when r <= (select count(*) * 10 // 100 from drawn) then r end::bigint as "rank"
from scored left join drawn using (rid)
"""

ORACLES: dict[str, str] = {
    "op11_secret_scan": _OP11,
    "op13_importance_resampling": _OP13,
    "op1_quality_rules": _OP1,
    "op5_warc": _OP5,
    "op7_decontamination": _OP7,
    "op8_url_filters": url_sql.judged(),
    "url_aliases": url_sql.judged(url_sql.LINKED_PAGES),
}
