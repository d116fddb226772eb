"""Secret scans with corpus-wide ownership: who else holds a candidate tells what it is.

Texts are matched once; candidates leave them as places, lengths and 128-bit hashes of their
values. The hashes are aggregated to distinct repositories and owners over all documents. What
many owners hold is a copied example; what stays with few and looks random is taken for live,
and such tokens count as spans also where no keyword stands before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, written

KINDS = ["assign", "access", "hex", "owned"]
OWNED = KINDS.index("owned")
#: Fixed patterns, in the order of KINDS; greedy runs need their least length only once. The
#: last are whole runs of token characters with a digit and a letter, but no parts of dotted names.
PATTERNS = [
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "(AKIA[A-Z0-9]{16,})",
    "([0-9a-f]{24,})",
    r"(?<![A-Za-z0-9+/_=-])(?<![A-Za-z0-9]\.)(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])([A-Za-z0-9+/_=-]{20,}+)(?!\.[A-Za-z0-9])",
]
VALUE_GROUP = [2, 1, 1, 1]
LEAST_VALUE = [6, 1, 1, 1]


def _value_hash(value: Column) -> Column:
    return F.unhex(F.substring(F.sha2(value, 256), 1, 32))


def _random(value: Column, kind: int, least_chars: int) -> Column:
    """Whether a value looks drawn: enough different characters and, without a keyword or prefix
    beside it, letters of both cases or a quarter digits, and two slashes at most."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= least_chars
    if kind != OWNED:
        return varied
    without = lambda chars: F.length(F.regexp_replace(value, chars, ""))
    mixed = (value.rlike("[a-z]") & value.rlike("[A-Z]")) | (4 * without("[^0-9]") >= F.length(value))
    return varied & mixed & (without("[^/]") <= 2)


def _matches(text: Column, kind: int, least_chars: int) -> Column:
    """The matches of one pattern in order: kind, number, code points since the last match, own
    code points, value's code points, hash of the value, whether it looks drawn."""
    pattern = PATTERNS[kind]
    whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, VALUE_GROUP[kind]))
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(gaps, F.arrays_zip(whole.alias("w"), value.alias("v")), lambda g, m: F.struct(g.alias("g"), m["w"].alias("w"), m["v"].alias("v")))
    rows = F.transform(
        F.filter(both, lambda m: m["w"].isNotNull()),
        lambda m, k: F.struct(
            F.lit(kind).alias("kind"),
            k.alias("k"),
            F.length(m["g"]).cast("long").alias("gap"),
            F.length(m["w"]).cast("long").alias("length"),
            F.length(m["v"]).alias("n_value"),
            _value_hash(m["v"]).alias("value"),
            _random(m["v"], kind, least_chars).alias("random"),
        ),
    )
    return F.when(text.rlike(pattern), rows)


def ownership(candidates: DataFrame, value: str, owner: list[str], repository: list[str]) -> DataFrame:
    """(value, n_repositories, n_owners) over all candidates; nulls are an owner of their own,
    and repositories are told apart within their owner.

    Repeated holders of a value are combined before they are shuffled, so a value that a third
    of all documents hold costs its holders, not its places.
    """
    holders = candidates.select(value, *[F.col(f"`{c}`") for c in (*owner, *repository)]).distinct()
    by_owner = holders.groupBy(value, *[F.col(f"`{c}`") for c in owner]).agg(F.count("*").alias("r"))
    return by_owner.groupBy(value).agg(F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"))


def scan(
    docs: DataFrame,
    keep: list[str] | None = None,
    text: str = "text",
    owner: tuple[str, ...] = ("source",),
    repository: tuple[str, ...] = ("source", "lang"),
    most_owners: int = 2,
    most_repositories: int = 4,
    least_chars: int = 8,
) -> DataFrame:
    """Every row with its secrets: columns ``keep`` (all), then base, spans, n_live, n_example.

    ``base`` and ``spans`` are arrays of (start, kind, end) in code points by start, then kind as
    in KINDS; ``spans`` holds the base and, beyond it, live tokens (kind ``owned``) that overlap
    no base span. A value is live if at most ``most_owners`` owners and ``most_repositories``
    repositories hold it anywhere and it looks drawn (``least_chars`` different characters; tokens
    also by their digits and cases), else an example; ``n_live`` and ``n_example`` count base and
    tokens by that.

    Null and empty texts have none; null owners are one owner; repeated rows are scanned each
    and are no further owners; an empty table gives no rows. All of a text is read; the work on
    a document's matches is linear in them. Added columns get underscores in front where they
    clash. A value in a third of all rows is one key of a merge join that Spark splits where skewed.
    """
    names = docs.columns if keep is None else keep
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    nothing = F.array().cast("array<struct<kind:int,k:int,gap:bigint,length:bigint,n_value:int,value:binary,random:boolean>>")
    found = F.concat(*[F.coalesce(_matches(F.col("body"), k, least_chars), nothing) for k in range(len(KINDS))])
    own = [f"owner {i}" for i in range(len(owner))]
    repo = [f"repository {i}" for i in range(len(repository))]
    source = docs.select(
        *[F.col(f"`{c}`").alias(f"kept {i}") for i, c in enumerate(names)],
        *[F.col(f"`{c}`").alias(n) for c, n in zip(owner, own)],
        *[F.col(f"`{c}`").alias(n) for c, n in zip(repository, repo)],
        body.alias("body"),
    )
    kept = [F.col(f"`kept {i}`") for i in range(len(names))]
    slim = written(source.select(*kept, *own, *repo, F.monotonically_increasing_id().alias("row"), found.alias("found")), "secret-rows")

    running = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = slim.where(F.size("found") > 0).select("row", *own, *repo, F.inline("found"))
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(running))
    least = F.element_at(F.array(*[F.lit(n) for n in LEAST_VALUE]), F.col("kind") + 1)
    rows = rows.where(F.col("n_value") >= least).select("row", "kind", (F.col("end") - F.col("length")).alias("start"), "end", "value", "random", *own, *repo)
    candidates = written(rows, "secret-candidates")

    holders = ownership(candidates, "value", own, repo)
    live = (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories) & F.col("random")
    marked = candidates.join(holders.hint("merge"), "value").select("row", "kind", "start", "end", live.alias("live"))
    at = Window.partitionBy("row").orderBy("start", "kind")
    is_base = F.col("kind") != OWNED
    before = F.max(F.when(is_base, F.col("end"))).over(at.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(F.when(is_base, F.col("start"))).over(at.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(behind, F.col("end")) >= F.col("end"))
    counted = marked.withColumn("counts", is_base | clear).where("counts")
    span = F.struct("start", "kind", "end")
    results = counted.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(is_base, span))).alias("base"),
        F.array_sort(F.collect_list(F.when(is_base | F.col("live"), span))).alias("spans"),
        F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.count(F.when(~F.col("live"), 1)).alias("n_example"),
    )
    no_spans = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    values = {"base": no_spans, "spans": no_spans, "n_live": F.lit(0).cast("long"), "n_example": F.lit(0).cast("long")}
    bare = slim.where(F.size("found") == 0).select(*kept, *[v.alias(n) for n, v in values.items()])
    hit = slim.where(F.size("found") > 0).join(results.hint("merge"), "row", "left").select(*kept, *[F.coalesce(F.col(n), v).alias(n) for n, v in values.items()])
    out = bare.unionByName(hit)
    labels = []
    for n in values:
        labels.append(free_name(docs.select(*[F.col(f"`{c}`") for c in names]), n))
    return out.toDF(*names, *labels)


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def n_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
