"""SimHash near-duplicates: vantage-point trees over the fingerprints, then components.

A vantage-point tree sends a fingerprint to the branch that its Hamming distance from the
node's vantage point selects; by the triangle inequality a neighbour within radius r lies in a
branch whose distances differ by r at most. Over all 64 bits distances crowd at 32 and a
search for radius 4 enters nearly every branch, so the upper levels of the distributed trees
stand on bit blocks: ``max_bits`` differing bits leave at least one of ``max_bits + 1`` blocks
untouched, and in the tree of that block the radius is 0. Each level's branches are the rings of
equal distance from a vantage point (the block's zero and its single bits, so that a path of
rings is the block's value), a search enters one branch at each level, and the path is the
shard's key. Shards that are still large are split again by blocks of their other bits.

Within a shard full distances count (``neighbours`` deals out those of any size): a tree whose
vantage point is a fingerprint of the shard and whose radius is the median distance;
fingerprints within ``max_bits`` of the boundary are compared across it, pairs that the bounds
rule out are not. Equal fingerprints are one from the start.

For a similarity of shingle sets (``similar_documents``) the same trees stand over wider
fingerprints, WIDTH bits over the different shingles, so that a repeated phrase does not move
them. At 0.8 some 39 of 256 bits differ, of unlike texts 128: RADIUS lies between. No set of
blocks is untouched for sure then, so there are as many trees (each with other bits) as leave
a pair of that similarity apart in all of them with probability MISS at most; up to FILL
fingerprints one tree holds all. What the trees link is a candidate, and links are exact
comparisons of the sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, mapped, scratch, ship, written
from .components import connected_components
from .neighbours import forest, plain_forest, sizes_of

SEED = 42
LEAF = 256  # fingerprints compared all with all
AT_ONCE = 1 << 16  # distances computed at a time
SHARD = 8192  # fingerprints in one task's shard
#: For each byte: its bits in eight lanes of a 64-bit word.
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of the lower-cased (A-Z) text's word shingles; 0 where there is no word."""
    h = shingle_hashes(text, words)
    return majority(h) if len(h) else 0


def with_fingerprint(docs: DataFrame, words: int = 4, text: str = "text", name: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and the fingerprint as a signed 64-bit ``name``."""
    keep = docs.columns if keep is None else keep
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(at).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array(fps.view(np.int64))], [*batch.schema.names[:at], name]
            )

    return mapped(docs, keep, [F.col(f"`{text}`")], run, T.StructType().add(name, "long"))


class Forest:
    """Labels of the points of one shard; linked points get the same label."""

    def __init__(self, points: np.ndarray, radius: int, label: np.ndarray | None = None):
        self.points, self.radius = points, radius
        self.label = np.arange(len(points)) if label is None else label.copy()
        self.found: list[tuple[int, int]] = []

    def link(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if a != b:
            self.label[self.label == max(a, b)] = min(a, b)
            self.found.append((i, j))

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.points[left] ^ self.points[right])

    def compare(self, left: np.ndarray, right: np.ndarray) -> None:
        """All of left with all of right, in blocks; only pairs not yet joined matter."""
        step = max(1, min(LEAF, AT_ONCE // max(1, len(right))))
        for lo in range(0, len(left), step):
            part = left[lo : lo + step]
            near = self.apart(part[:, None], right[None, :]) <= self.radius
            near &= self.label[part][:, None] != self.label[right][None, :]
            for k in np.flatnonzero(near.any(1)):
                other = right[near[k]]
                while len(other := other[self.label[other] != self.label[part[k]]]):
                    self.link(part[k], other[0])

    def grow(self, idx: np.ndarray) -> None:
        """Links all pairs among ``idx`` by a vantage-point tree."""
        stack = [idx]
        while stack:
            idx = stack.pop()
            if len(idx) <= LEAF:
                self.compare(idx, idx)
                continue
            distance = self.apart(idx, idx[0]).astype(np.int64)
            for i in idx[distance <= self.radius]:
                self.link(i, idx[0])
            limit = int(np.median(distance))
            inner = distance <= limit
            if inner.all():  # ties up to the end: the ring itself is the outer branch
                inner = distance < limit
            if not inner.any() or inner.all():
                self.compare(idx, idx)
                continue
            limit = int(distance[inner].max())
            stack += [idx[inner], idx[~inner]]
            self.cross(idx[inner & (distance > limit - self.radius)], idx[~inner & (distance <= limit + self.radius)])

    def cross(self, left: np.ndarray, right: np.ndarray) -> None:
        """Pairs across a boundary, pruned once more from a vantage point of the left side."""
        if len(left) <= LEAF or len(right) <= LEAF:
            return self.compare(left, right)
        d1 = self.apart(left, left[0]).astype(np.int64)
        d2 = self.apart(right, left[0]).astype(np.int64)
        if max(d1.max() - d2.min(), d2.max() - d1.min()) <= self.radius:  # no ring rules any out
            return self.compare(left, right)
        for ring in np.unique(d1):
            self.compare(left[d1 == ring], right[np.abs(d2 - ring) <= self.radius])

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the ends of the links that joined something."""
        ends = np.array(self.found, np.int64).reshape(-1, 2)
        return ends[:, 0], ends[:, 1]


class WideForest(Forest):
    """As ``Forest``, over fingerprints of several 64-bit words (a row each)."""

    def __init__(self, points: np.ndarray, radius: int, label: np.ndarray | None = None):
        super().__init__(points, radius, label)
        self.lanes = np.ascontiguousarray(points.T)

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        *most, last = (np.bitwise_count(lane[left] ^ lane[right]) for lane in self.lanes)
        return np.add(sum(most[1:], most[0]), last, dtype=np.uint16)  # three words fit in a byte


def _bit_search(radius: int, items: np.ndarray, payloads: list, labels: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _grown(Forest(items.view(np.uint64), radius, labels), items, left)


def _print_search(radius: int, items: np.ndarray, payloads: list, labels: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _grown(WideForest(_words(items), radius, labels), items, left)


def _grown(points: Forest, items: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if left.all():
        points.grow(np.arange(len(items)))
    else:
        points.cross(np.flatnonzero(left), np.arange(len(items)))
    return points.edges()


def _blocks(bits: int, skip: tuple[int, int], n: int) -> list[list[tuple[int, int]]]:
    """``n`` blocks of the bits outside ``skip``, each as ranges of bits."""
    free = [i for i in range(bits) if not skip[0] <= i < skip[1]]
    cuts = [len(free) * k // n for k in range(n + 1)]
    found = []
    for lo, hi in zip(cuts, cuts[1:]):
        own, ranges = free[lo:hi], []
        for i in own:
            if ranges and ranges[-1][1] == i:
                ranges[-1] = (ranges[-1][0], i + 1)
            else:
                ranges.append((i, i + 1))
        found.append(ranges)
    return found


def _value(ranges: list[tuple[int, int]]):
    """The bits of the ranges as one long."""
    value, at = F.lit(0).cast("long"), 0
    for lo, hi in ranges:
        bits = F.shiftrightunsigned(F.col("item"), lo).bitwiseAND((1 << (hi - lo)) - 1)
        value, at = value.bitwiseOR(F.shiftleft(bits, at)), at + hi - lo
    return value


def links(fingerprints: DataFrame, max_bits: int = 4, fp: str = "fp", limit: int = SHARD) -> DataFrame:
    """(a, b): a forest over distinct fingerprints that joins just those that links join."""
    n = max_bits + 1
    blocks = _blocks(64, (0, 0), n)
    one = F.lit(1).alias("weight")
    paths = F.array(*[F.struct(F.lit(k).alias("tree"), _value(b).alias("path")) for k, b in enumerate(blocks)])
    members = (
        fingerprints.select(F.col(fp).alias("item"))
        .select("item", F.explode(paths).alias("shard"))
        .select(F.expr("shard.path * 64 + shard.tree").alias("key"), "item", one)
    )
    # Of a key for each value of a block: at most (max_bits + 1) * 2 ** (64 / (max_bits + 1)).
    large = sizes_of(members).where(F.col("n") > limit).select("key")
    if large.limit(1).count():
        again = []
        for k, b in enumerate(blocks):
            below = F.array(
                *[
                    F.struct(F.lit(m).alias("tree"), _value(c).alias("path"))
                    for m, c in enumerate(_blocks(64, (b[0][0], b[0][1]), n))
                ]
            )
            again.append(F.when(F.pmod("key", F.lit(64)) == k, below))
        split = members.join(large, "key", "left_semi").select("item", "key", F.explode(F.coalesce(*again)).alias("below"))
        split = split.select(F.xxhash64("key", "below.tree", "below.path").alias("key"), "item", one)
        members = members.join(large, "key", "left_anti").select("key", "item", "weight").unionByName(split)
    return forest(members, partial(_bit_search, max_bits), limit)


def near_duplicates(
    docs: DataFrame,
    words: int = 4,
    max_bits: int = 4,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (by default ``doc_id``) of every row, fp (signed 64-bit), root and
    component_id.

    Documents whose fingerprints differ in ``max_bits`` bits or fewer are linked; rows of a
    component share their root, and its id is its smallest document id (null where it has
    none). Null, empty and blank texts have fingerprint 0 and are linked like others; repeated
    rows come back repeated; an empty table gives no rows; other columns are ignored; result
    columns whose name is taken get underscores in front.
    """
    keep = [doc_id] if keep is None else keep
    keyed = _kept(docs, doc_id, text, keep)
    prints = written(with_fingerprint(keyed, words, "t", keep=["id", "kept_columns"]), "simhash-prints")
    first = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    found = connected_components(links(first.select("fp"), max_bits))
    rooted = first.join(found, first.fp == found.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", F.col("root"), "component_id")
    return _named(docs, keep, prints.join(classes, "fp", "left"), ["fp", "root", "component_id"])


def _kept(docs: DataFrame, doc_id: str, text: str, keep: list[str]) -> DataFrame:
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept_columns")
    return docs.select(F.col(f"`{doc_id}`").alias("id"), kept, F.col(f"`{text}`").alias("t"))


def _named(docs: DataFrame, keep: list[str], rows: DataFrame, names: list[str]) -> DataFrame:
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    return rows.select("kept_columns.*", *[F.col(n).alias(free_name(kept, n)) for n in names])


# --- similarity of shingle sets ------------------------------------------------------------------

WIDTH = 256  # bits of a fingerprint of a set
#: At similarity 0.8 a bit differs with probability 0.1611 at most (14 shingles), for sets of
#: TINY shingles or fewer 0.1875 (5 and 4 of them); RADIUS is 4.5 deviations above the latter.
DIFFER, DIFFER_TINY, TINY, RADIUS = 0.1611, 0.1875, 5, 76
MISS = 0.002  # probability that a pair of similarity 0.8 shares no path of any tree
FILL = 4096  # most fingerprints, on average, below one path
PRINTS = 16384  # fingerprints in one task's shard
WEIGHT = 1_000_000  # shingles of one task's shard
_SEEDS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, WIDTH // 64), np.uint64)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of the word shingles of the text (A-Z lower-cased), repeats included."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(w)] if len(w) <= words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def majority(h: np.ndarray) -> int:
    """The fingerprint: bits set in over half the hashes."""
    lanes = _LANES[h.view(np.uint8).reshape(-1, 8)]
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(h), 255):
        counts += lanes[lo : lo + 255].sum(0, dtype=np.uint64).view(np.uint8)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def wide_print(distinct: np.ndarray) -> bytes:
    """SimHash of WIDTH bits of different shingle hashes, each mixed anew for every 64 bits."""
    mixed = (distinct[:, None] ^ _SEEDS[0]) * (_SEEDS[1] | np.uint64(1))
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    lanes = _LANES[mixed.view(np.uint8)]
    counts = np.zeros(WIDTH, np.int64)
    for lo in range(0, len(lanes), 255):
        counts += lanes[lo : lo + 255].sum(0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * counts > len(distinct), bitorder="little").tobytes()


def _words(prints: np.ndarray | list) -> np.ndarray:
    return np.frombuffer(b"".join(prints), "<u8").reshape(-1, WIDTH // 64)


def with_shingle_sets(keyed: DataFrame, words: int) -> DataFrame:
    """id, kept_columns and class (hash of the set of shingles), print (its fingerprint), n (its
    size) and payload (the shingles' different low 32 bits) of each row of (id, kept_columns, t)."""
    ship(keyed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out: list[tuple] = []
                for t in part.column(2).to_pylist():
                    s = np.unique(shingle_hashes(t, words))
                    label = np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64)
                    short = np.unique(s.astype("<u4"))
                    out.append((label, wide_print(s), len(short), short.tobytes()))
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary()]
                made = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *made], [*part.schema.names[:2], *names])

    names = ["class", "print", "n", "payload"]
    schema = keyed.select("id", "kept_columns").schema.add("class", "long").add("print", "binary")
    return keyed.mapInArrow(run, schema.add("n", "long").add("payload", "binary"))


def n_trees(bits: int, differ: float) -> int:
    """Trees with paths of ``bits`` bits that leave MISS of the pairs whose bits differ so apart."""
    if not bits:
        return 1
    d = range(WIDTH - bits + 1)
    chance = np.array([math.comb(WIDTH, k) * differ**k * (1 - differ) ** (WIDTH - k) for k in d])
    apart = 1 - np.array([math.comb(WIDTH - k, bits) / math.comb(WIDTH, bits) for k in d])
    n = 1
    while (chance * apart**n).sum() > MISS:
        n += 1
    return n


def tree_blocks(n: int, fill: int = FILL) -> tuple[np.ndarray, int]:
    """The bits on which each tree for ``n`` fingerprints branches, and how many trees are for
    all sets (the others are for tiny ones)."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / fill)))
    trees, rng, blocks = n_trees(bits, DIFFER_TINY), np.random.default_rng(SEED), []
    while len(blocks) < trees:
        order = rng.permutation(WIDTH)
        blocks += [order[k * bits : (k + 1) * bits] for k in range(WIDTH // bits if bits else 1)]
    return np.array(blocks[:trees], np.int64).reshape(trees, bits), n_trees(bits, DIFFER)


def _paths(prints: DataFrame, blocks: np.ndarray, common: int) -> DataFrame:
    """The rows once for each of their trees, with ``path`` (of the tree and its bits) in front."""
    ship(prints.sparkSession)
    at_print, at_tiny = prints.columns.index("print"), prints.columns.index("tiny")
    powers = 1 << np.arange(blocks.shape[1], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tiny = batch.column(at_tiny)
            bits = np.unpackbits(_words(batch.column(at_print).to_pylist()).view(np.uint8), axis=1, bitorder="little")
            for k, block in enumerate(blocks):
                path = pa.array(k + len(blocks) * (bits[:, block] @ powers))
                out = pa.RecordBatch.from_arrays([path, *batch.columns], ["path", *batch.schema.names])
                yield out if k < common else out.filter(tiny)

    return prints.mapInArrow(run, T.StructType([T.StructField("path", T.LongType()), *prints.schema.fields]))


def candidates(prints: DataFrame, blocks: np.ndarray, common: int, limit: int = PRINTS) -> DataFrame:
    """(a, b): a forest that joins the fingerprints (print, tiny) that pairs within RADIUS below
    one path of one of the trees join."""
    rows = _paths(prints, blocks, common)
    members = rows.select(F.col("path").alias("key"), F.col("print").alias("item"), F.lit(1).cast("long").alias("weight"))
    search = partial(_print_search, RADIUS)
    large = written(members.groupBy("key").count().where(F.col("count") > limit).select("key"), "simhash-large")
    if not large.limit(1).count():
        return plain_forest(members, search)
    small = plain_forest(members.join(large, "key", "left_anti"), search)
    return small.unionByName(forest(members.join(large, "key", "left_semi"), search, limit))


def _set_search(similarity: float, items: np.ndarray, payloads: list, labels: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of at least the similarity: those that share one of the rarest shingles that such
    a pair must share and fit in size, and whose sets then are that alike."""
    sets = [np.frombuffer(p, np.uint32) for p in payloads]
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    rarity = np.empty(len(count), np.int64)
    rarity[np.argsort(count, kind="stable")] = np.arange(len(count))
    ranked = [np.sort(r) for r in np.split(rarity[place], np.cumsum(sizes)[:-1])]
    need = np.ceil(similarity * sizes - 1e-9).astype(np.int64)
    heads = [r[: n - k + 1] for r, n, k in zip(ranked, sizes, need)]
    owner = np.repeat(np.arange(len(sets)), [len(h) for h in heads])
    flat_heads = np.concatenate(heads)
    order = np.argsort(flat_heads, kind="stable")
    flat_heads, owner = flat_heads[order], owner[order]
    label, found = labels.copy(), []
    for v in range(len(sets)):
        lo, hi = np.searchsorted(flat_heads, heads[v]), np.searchsorted(flat_heads, heads[v], "right")
        near = [owner[a:b] for a, b in zip(lo, hi) if b - a > 1]
        if not near:
            continue
        other = np.unique(np.concatenate(near))
        other = other[(other > v) & (label[other] != label[v]) & (left[other] | left[v])]
        other = other[(sizes[other] >= need[v]) & (need[other] <= sizes[v])]
        for o in other.tolist():
            if label[o] == label[v]:
                continue
            common = len(np.intersect1d(ranked[v], ranked[o], assume_unique=True))
            if common >= similarity * (sizes[v] + sizes[o] - common) - 1e-9:
                a, b = sorted((label[v], label[o]))
                label[label == b] = a
                found.append((v, o))
    ends = np.array(found, np.int64).reshape(-1, 2)
    return ends[:, 0], ends[:, 1]


def similar_documents(
    docs: DataFrame,
    words: int = 5,
    similarity: float = 0.8,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    limit: int = WEIGHT,
    fill: int = FILL,
) -> DataFrame:
    """The columns ``keep`` (by default ``doc_id``) of every row, print (the fingerprint of its
    set, WIDTH bits) and root; rows have one root if links join them.

    Linked are rows whose sets of word shingles (A-Z lower-cased; fewer words: the whole
    sequence) have at least the similarity, compared exactly on 32-bit hashes. Candidates are what
    the vantage-point trees over the fingerprints join; in a candidate group of more than
    ``limit`` shingles, those of it that share a path. Null, empty and blank texts
    are alike; repeated rows come back repeated; an empty table gives no rows; other columns
    are ignored; result columns whose name is taken get underscores in front.
    """
    keep = [doc_id] if keep is None else keep
    rows = written(with_shingle_sets(_kept(docs, doc_id, text, keep), words), "simhash-sets")
    sets = rows.where("n > 0").groupBy(F.col("class").alias("item"))
    sets = written(sets.agg(F.first("n").alias("weight"), F.first("print").alias("print")), "simhash-classes")
    prints = written(sets.groupBy("print").agg((F.min("weight") <= TINY).alias("tiny")), "simhash-prints")
    blocks, common = tree_blocks(prints.count(), fill)
    near = connected_components(candidates(prints, blocks, common))
    group = F.xxhash64(F.coalesce("component", "print"))
    grouped = sets.join(near, F.col("print") == F.col("node"), "left").select(group.alias("key"), "item", "weight", "print")
    sizes = grouped.groupBy("key").agg(F.count("*").alias("n"), F.sum("weight").alias("total")).where("n > 1")
    grouped = written(grouped.join(sizes.select("key", "total"), "key"), "simhash-groups")
    members = grouped.where(F.col("total") <= limit).select("key", "item", "weight")
    below = _paths(grouped.where(F.col("total") > limit).withColumn("tiny", F.col("weight") <= TINY), blocks, common)
    members = members.unionByName(below.select(F.xxhash64("key", "path").alias("key"), "item", "weight"))
    payload = rows.join(grouped.select("item"), F.col("class") == F.col("item"), "left_semi")
    payload = written(payload.groupBy(F.col("class").alias("item")).agg(F.first("payload").alias("payload")), "simhash-payload")
    found = connected_components(forest(members, partial(_set_search, similarity), limit, payload))
    rooted = rows.select("kept_columns", "print", "class").join(found, F.col("class") == F.col("node"), "left")
    rooted = rooted.withColumn("root", F.coalesce("component", "class"))
    return _named(docs, keep, rooted, ["print", "root"])


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay: the row with the smallest id of each group of similar ones.

    Ties between rows of one id go to the smallest hash of the whole row, rows that are equal
    in all columns stay once, and a row without an id stays only where its group has no id.
    Null, empty and blank texts are one group; an empty table gives no rows. Columns are
    those of ``docs``, whatever their names. Removed are (id, row hash) pairs: the texts are
    dealt out once.
    """
    key = free_name(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    names = [free_name(keyed, n) for n in ("id", "row", "stay")]
    with scratch(docs.sparkSession, "simhash"):
        found = similar_documents(keyed, words, similarity, doc_id, text, keep=[doc_id, key])
        found = found.toDF("id", "row", "print", "root")
        rows = written(found.groupBy("root", "id", "row").agg(F.count("*").alias("times")), "simhash-rows")
        stay = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("stays"))
        stays = F.col("id").eqNullSafe(F.col("stays.id")) & (F.col("row") == F.col("stays.row"))
        judged = rows.join(stay, "root").withColumn("stay", stays).where("not stay or times > 1")
        judged = written(judged.select("id", "row", "stay").toDF(*names), "simhash-judged", stays=True)
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(names[0])) & (F.col(key) == F.col(names[1]))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = keyed.join(judged.hint("shuffle_hash"), same, "left_anti").select(*columns)
    repeated = judged.where(names[2])
    if not repeated.limit(1).count():
        return once
    return once.unionByName(keyed.join(repeated, same, "left_semi").select(*columns).distinct())
