"""Repair of conversations: each distinct sequence of roles and faults is solved once.

Rows are coded by one letter of role and fault, and a conversation's letters, cut into pieces of
bounded length, are its signature. Distinct signatures are solved once by memoised recursion over
their halves; the cheapest edits are joined back to the conversations and replayed on the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, written

PIECE_BITS = 12  # a signature's piece holds at most 4,096 rows
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: What stands last in the repaired roles: nothing, a system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_FAR = 1 << 40
#: Letters of a signature: role s, u, a or other (o), in capitals if truncated; x must go.
_ROLES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
_SPOKEN = (USER, USER, ASSISTANT, USER)  # the role to write after each state
#: Letters of a plan: k kept, d deleted, U and A new roles, u and a inserted before the next.
_AUDIT = str.maketrans("kdUAua", "KDRRII")
_BLANK = r"^[ \t-\r]*$"


def damage(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text) with faults set by the checksum of their key: some dropped,
    emptied, without their last marks, repeated, or spoken by the user. Nulls in the key, roles
    and texts are one space."""
    c = lambda name: F.col(f"`{name}`")
    named = lambda name: F.coalesce(c(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named(conversation), F.lit(":"), named(turn))) % 20
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    known = rows.select(c(conversation).alias("conv"), c(turn).alias("turn"), named(role).alias("role"), named(text).alias("text"), kind.alias("kind"))
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return known.select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")
    ).drop("copy")


# --- solving signatures ------------------------------------------------------------------------


def _edits(letter: str, state: int) -> dict[str, tuple[int, int]]:
    """The edits of one row after ``state``: audit letter to (cost, state after)."""
    out = {"D": (DELETE, state)}
    if letter != "x":
        extra = TRUNCATED if letter.isupper() else 0
        own = _ROLES.get(letter.lower())
        if own in _FOLLOWS[state]:
            out["K"] = (KEEP + extra, own)
        out["R"] = (REROLE + extra, _SPOKEN[state])
    return out


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    """Costs to go from each state if rows may be inserted first."""
    user = min(costs[USER], INSERT + costs[ASSISTANT])
    assistant = min(costs[ASSISTANT], INSERT + costs[USER])
    return (min(costs[START], INSERT + user), min(costs[SYSTEM], INSERT + user), user, assistant)


#: Costs to go behind the last row: only nothing and an assistant's row may end.
END = _with_inserts([0, _FAR, _FAR, 0])


@lru_cache(maxsize=1 << 16)
def costs_of(signature: str) -> tuple[tuple[int, ...], ...]:
    """Least costs from each state before a signature to each state behind it."""
    if len(signature) == 1:
        found = [[_FAR] * 4 for _ in range(4)]
        for state in range(4):
            for cost, after in _edits(signature, state).values():
                found[state][after] = min(found[state][after], cost)
        columns = [_with_inserts([row[after] for row in found]) for after in range(4)]
        return tuple(zip(*columns))
    half = len(signature) // 2
    left, right = costs_of(signature[:half]), costs_of(signature[half:])
    return tuple(tuple(min(min(a + b for a, b in zip(row, column)), _FAR) for column in zip(*right)) for row in left)


def before(matrix: tuple[tuple[int, ...], ...], behind: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go in front of a signature from those behind it."""
    return tuple(min(min(a + b for a, b in zip(row, behind)), _FAR) for row in matrix)


@lru_cache(maxsize=1 << 16)
def plan_of(signature: str, behind: tuple[int, ...], state: int) -> tuple[str, int]:
    """The cheapest edits from ``state`` if ``behind`` are the costs to go from each state after
    them, and the state after; of equal costs the edits whose audit is least.

    After equal edits stands the same state, so the least audit takes, row by row, the least
    letter that keeps the costs least. Halves are solved in turn and remembered.
    """
    if len(signature) > 1:
        half = len(signature) // 2
        middle = before(costs_of(signature[half:]), behind)
        least = min(middle)
        first, between = plan_of(signature[:half], tuple(c - least for c in middle), state)
        second, after = plan_of(signature[half:], behind, between)
        return first + second, after
    to_go = before(costs_of(signature), behind)
    plan = ""
    while True:
        options = {a: (c + behind[t], t) for a, (c, t) in _edits(signature, state).items()}
        options["I"] = (INSERT + to_go[_SPOKEN[state]], _SPOKEN[state])
        audit = min(a for a, (cost, _) in options.items() if cost == to_go[state])
        said = "u" if _SPOKEN[state] == USER else "a"
        plan += {"D": "d", "K": "k", "R": said.upper(), "I": said}[audit]
        state = options[audit][1]
        if audit != "I":
            return plan, state


def closing(state: int) -> str:
    """What is inserted behind the last row."""
    return {START: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}[state]


def cost_of(signature: str, plan: str) -> int:
    """The cost of a plan with its inserted rows."""
    edits = [p for p in plan if p not in "ua"]
    kept = sum(TRUNCATED for letter, p in zip(signature, edits) if letter.isupper() and p != "d")
    return kept + INSERT * (len(plan) - len(edits)) + DELETE * plan.count("d") + REROLE * sum(p in "UA" for p in plan)


# --- jobs ----------------------------------------------------------------------------------------


def coded(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, h1, h2, at, letter, fault) of rows (conv, turn, role, text), no texts.

    ``at`` numbers rows by conversation and turn, nulls first, equal turns by role and two
    64-bit hashes of the text; rows equal in all are the same row again. Ranges are dealt by all
    of that and a row number, so neither a conversation nor a turn has to fit into one task.
    """
    slim = rows.select(
        "conv",
        "turn",
        "role",
        F.xxhash64("text").alias("h1"),
        F.xxhash64(F.lit("quill"), F.col("text")).alias("h2"),
        F.col("text").rlike(_BLANK).alias("blank"),
        F.regexp_extract("text", r"([^ \t-\r])[ \t-\r]*\z", 1).isin(".", "!", "?").alias("ended"),
        F.monotonically_increasing_id().alias("salt"),
    )
    order = ["conv", "turn", "role", "h1", "h2", "salt"]
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    placed = written(ranged.withColumn("at", F.monotonically_increasing_id()), "turns")
    first = placed.where(~F.col("blank")).groupBy("conv", "role", "h1", "h2").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    spoken = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("ended"), "truncated")
    letter = F.when(fault.isin("blank", "duplicate"), "x").when(fault == "truncated", F.upper(spoken)).otherwise(spoken)
    return placed.join(first, "at", "left").select("conv", "turn", "role", "h1", "h2", "at", letter.alias("letter"), fault.alias("fault"))


def pieces(rows: DataFrame) -> DataFrame:
    """Pieces of conversations: (conv, piece, signature, rows, counts of faults, illegal pairs,
    first and last initial); ``rows`` lists what tells each row again, at most 4,096."""
    listed = F.array_sort(F.collect_list(F.struct("at", "letter", "turn", "role", "h1", "h2")))
    of = lambda fault: F.count(F.when(F.col("fault") == fault, 1)).alias(fault)
    grouped = rows.groupBy("conv", F.shiftright("at", PIECE_BITS).alias("piece")).agg(listed.alias("rows"), of("blank"), of("duplicate"), of("truncated"))
    initials = F.transform("rows", lambda r: F.substring(r["role"], 1, 1))
    n = F.size("rows")
    pairs = F.zip_with(F.slice("initials", 1, n - 1), F.slice("initials", 2, n), lambda a, b: F.concat(a, b))
    return grouped.withColumn("initials", initials).select(
        "conv",
        "piece",
        F.array_join(F.col("rows")["letter"], "").alias("signature"),
        F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in ("at", "turn", "role", "h1", "h2")])).alias("rows"),
        "blank",
        "duplicate",
        "truncated",
        F.size(F.filter(pairs, lambda p: ~_legal(p))).cast("long").alias("illegal"),
        F.element_at("initials", 1).alias("first"),
        F.element_at("initials", -1).alias("last"),
    )


def _legal(pair: Column) -> Column:
    return pair.isin("su", "ua", "au")


_COSTS = T.ArrayType(T.LongType())


def _solved(df: DataFrame, keep: list[str], inputs: list[Column], answer, outputs: list[T.StructField]) -> DataFrame:
    """``answer`` of each row's inputs as further columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.columns[: len(keep)]
            made = list(zip(*map(answer, *[c.to_pylist() for c in batch.columns[len(keep) :]]))) or [()] * len(outputs)
            arrays = [pa.array(list(m), kind) for m, kind in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays([*kept, *arrays], [*batch.schema.names[: len(keep)], *names])

    from pyspark.sql.pandas.types import to_arrow_type

    names, kinds = [f.name for f in outputs], [to_arrow_type(f.dataType) for f in outputs]
    return mapped(df, keep, inputs, run, T.StructType(outputs))


def _asked(cut: DataFrame) -> DataFrame:
    """(conv, piece, signature, behind, state, last piece?): what each piece has to solve.

    A conversation of one piece starts at its start and ends at its end. Of longer ones, costs
    run back over the pieces' matrices and states forward over their answers: sixteen numbers
    for 4,096 rows meet in one task, no rows.
    """
    spans = cut.groupBy("conv").agg(F.min("piece").alias("low"), F.max("piece").alias("high"), F.count("*").alias("n"))
    known = cut.select("conv", "piece", "signature").alias("c").join(spans.alias("s"), F.col("c.conv").eqNullSafe(F.col("s.conv")))
    known = known.select("c.conv", "piece", "signature", (F.col("n") > 1).alias("long"))
    end = F.array(*[F.lit(c).cast("long") for c in END])
    single = known.where(~F.col("long")).select("conv", "piece", "signature", end.alias("behind"), F.lit(START).alias("state"), F.lit(True).alias("closes"))

    parts = known.where("long").drop("long")
    matrices = _solved(parts.select("signature").distinct(), ["signature"], [F.col("signature")], lambda s: (costs_of(s),), [T.StructField("costs", T.ArrayType(_COSTS))])
    listed = F.array_sort(F.collect_list(F.struct("piece", "costs")))
    grouped = parts.join(matrices, "signature").groupBy("conv").agg(listed.alias("parts"))

    def backward(found):
        behind, out = END, []
        for part in reversed(found):
            out.append({"piece": part["piece"], "behind": list(behind), "closes": not out})
            behind = before(part["costs"], behind)
            behind = tuple(b - min(behind) for b in behind)
        return (out,)

    row = T.StructType([T.StructField("piece", T.LongType()), T.StructField("behind", _COSTS), T.StructField("closes", T.BooleanType())])
    ways = _solved(grouped, ["conv"], [F.col("parts")], backward, [T.StructField("ways", T.ArrayType(row))]).select("conv", F.inline("ways"))
    same = F.col("p.conv").eqNullSafe(F.col("w.conv")) & (F.col("p.piece") == F.col("w.piece"))
    ways = written(parts.alias("p").join(ways.alias("w"), same).select("p.conv", "p.piece", "signature", "behind", "closes"), "ways")
    answers = _solved(
        ways.select("signature", "behind").distinct(),
        ["signature", "behind"],
        [F.col("signature"), F.col("behind")],
        lambda s, b: ([plan_of(s, tuple(b), state)[1] for state in range(4)],),
        [T.StructField("after", T.ArrayType(T.IntegerType()))],
    )
    steps = F.array_sort(F.collect_list(F.struct("piece", "signature", "behind", "closes", "after")))
    walked = ways.join(answers, ["signature", "behind"]).groupBy("conv").agg(steps.alias("steps"))
    state = F.aggregate(
        F.col("steps")["after"],
        F.array(F.lit(START)),
        lambda states, after: F.concat(states, F.array(F.element_at(after, F.element_at(states, -1) + 1))),
    )
    zipped = walked.select("conv", F.explode(F.arrays_zip("steps", state.alias("state"))).alias("x")).where("x.steps is not null")
    return single.unionByName(zipped.select("conv", "x.steps.piece", "x.steps.signature", "x.steps.behind", "x.state", "x.steps.closes"))


def plans(cut: DataFrame) -> DataFrame:
    """(conv, piece, plan, cost) of every piece; each distinct question is solved once."""
    asked = written(_asked(cut), "signatures")

    def answer(signature, behind, state, closes):
        plan, after = plan_of(signature, tuple(behind), state)
        plan += closing(after) if closes else ""
        return plan, cost_of(signature, plan)

    key = ["signature", "behind", "state", "closes"]
    solved = _solved(asked.select(*key).distinct(), key, [F.col(k) for k in key], answer, [T.StructField("plan", T.StringType()), T.StructField("cost", T.LongType())])
    return asked.join(solved, key).select("conv", "piece", "plan", "cost")


def edits(cut: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv, turn, role, h1, h2, at, edit) of the rows that stay or have rows inserted beside
    them: the letters of the plan that stand before the row, its own, and those behind the last."""
    same = F.col("c.conv").eqNullSafe(F.col("p.conv")) & (F.col("c.piece") == F.col("p.piece"))
    letters = F.regexp_extract_all("plan", F.lit("([ua]*[kdUA](?:[ua]+$)?)"))
    both = cut.alias("c").join(planned.alias("p"), same).select("c.conv", F.explode(F.arrays_zip("rows", letters.alias("edit"))).alias("x"))
    return both.where("x.edit != 'd'").select("conv", *[F.col(f"x.rows.{c}").alias(c) for c in ("turn", "role", "h1", "h2", "at")], "x.edit")


def replay(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """(conv, role, text) of the repaired rows: each conversation in one partition, in order.

    Texts meet their edits in one shuffle by conversation, sorted there, and stream through the
    task: a batch of rows and one text are held, however long the conversation is.
    """
    key = ["conv", "turn", "role", "h1", "h2"]
    texts = rows.select(
        "conv", "turn", "role", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("quill"), F.col("text")).alias("h2"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("edit"), "text"
    )
    both = edited.select(*key, "at", "edit", F.lit(None).cast("string").alias("text")).unionByName(texts)
    ordered = both.repartition("conv").sortWithinPartitions(*key, F.col("at").asc_nulls_last())
    roles = {"u": "user", "a": "assistant"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waiting = None, []
        for batch in batches:
            convs, spoken, said = [], [], []
            size = 0
            kept, schema = batch.columns, batch.schema
            for *found, _, edit, text in zip(*[c.to_pylist() for c in kept]):
                if found != last:
                    last, waiting = found, []
                if edit is not None:
                    waiting.append(edit)
                    continue
                for letters in waiting:
                    for letter in letters:
                        if letter == "d":
                            continue
                        convs.append(found[0])
                        spoken.append(found[2] if letter == "k" else roles[letter.lower()])
                        said.append("" if letter in roles else text)
                        size += len(said[-1])
                waiting = []
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(convs, schema.field(0).type), pa.array(spoken, pa.string()), pa.array(said, pa.string())], ["conv", "role", "text"])
                    convs, spoken, said, size = [], [], [], 0
            if convs:
                yield pa.RecordBatch.from_arrays([pa.array(convs, schema.field(0).type), pa.array(spoken, pa.string()), pa.array(said, pa.string())], ["conv", "role", "text"])

    from .common import ship

    ship(rows.sparkSession)
    schema = T.StructType([T.StructField("conv", rows.schema["conv"].dataType), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    return ordered.mapInArrow(run, schema)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of replayed rows: ``role:text``, newline-joined, hashed as they
    come; the hash of a conversation is a chain and so one task's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, n = None, None, 0
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            out = []
            for conv, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if digest is None or conv != last:
                    if digest is not None:
                        out.append((last, digest.hexdigest()))
                    last, digest, n = conv, hashlib.sha256(), 0
                digest.update(f"{chr(10) if n else ''}{role}:{text}".encode())
                n += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out])], ["conv", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], kind), pa.array([digest.hexdigest()])], ["conv", "repaired_sha256"])

    schema = T.StructType([repaired.schema["conv"], T.StructField("repaired_sha256", T.StringType())])
    return repaired.mapInArrow(run, schema)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audits of conversations and their repaired rows, of rows (conv, turn, role, text).

    Audits: conv, gaps, blank, duplicate, truncated, illegal, cost, audit. Turns come in order,
    nulls first; equal turns by role, then by the text's hash. Null roles and texts count as
    one space; a null conversation is one of its own; rows of equal turn, role and text are
    duplicates but for the first; an empty table gives none. ``gaps`` is null where turns are
    further apart than a long holds. A conversation may hold any share of the rows: its rows are
    coded, cut and edited in pieces, and only their costs, the audit (a letter a row) and the
    stream of repaired rows pass through one task.
    """
    blank = F.lit(" ")
    known = rows.select("conv", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    letters = coded(known)
    cut = written(pieces(letters), "pieces")
    planned = written(plans(cut), "plans")
    turns = letters.select("conv", "turn").distinct().groupBy("conv").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("turn").alias("n"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    gaps = turns.select("conv", F.coalesce((wide("high") - wide("low") + 1 - F.col("n")).try_cast("long"), F.when(F.col("n") == 0, 0)).alias("gaps"))

    listed = F.array_sort(F.collect_list(F.struct("piece", "plan", "first", "last")))
    same = F.col("c.conv").eqNullSafe(F.col("p.conv")) & (F.col("c.piece") == F.col("p.piece"))
    met = cut.alias("c").join(planned.alias("p"), same).select("c.conv", "c.piece", "plan", "cost", "first", "last", "blank", "duplicate", "truncated", "illegal")
    by_conv = met.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], listed.alias("parts"))
    n = F.size("parts")
    seams = F.zip_with(F.slice("parts", 1, n - 1), F.slice("parts", 2, n), lambda a, b: F.concat(a["last"], b["first"]))
    audits = by_conv.select(
        "conv",
        "blank",
        "duplicate",
        "truncated",
        (F.col("illegal") + F.size(F.filter(seams, lambda p: ~_legal(p)))).alias("illegal"),
        "cost",
        F.translate(F.array_join(F.col("parts")["plan"], ""), "kdUAua", "KDRRII").alias("audit"),
    )
    out = audits.alias("a").join(gaps.alias("g"), F.col("a.conv").eqNullSafe(F.col("g.conv"))).select("a.*", "g.gaps")
    return out, replay(known, edits(cut, planned))
