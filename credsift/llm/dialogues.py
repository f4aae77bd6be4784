"""Repair of the turn structure of conversations at the least cost.

A repaired conversation is empty, or pairs of a user's and an assistant's turn
behind at most one system turn.  Turns may be kept, given another role,
deleted, or put in; finding the cheapest edits is a shortest way through one
row of states per turn (Viterbi).  Of ways of equal cost the one whose edits,
written down as letters, come first in the order of ASCII is taken.

A conversation may hold a large part of all turns, so it is cut into chunks
that are worked on at the same time, each from a guessed vector of costs at
its end.  The decisions inside a chunk depend on that vector only up to a
constant, and the vectors of different guesses soon differ by no more than
that (rank convergence).  Fix-up passes hand each chunk the vector at the
start of the next one, and run it again only if it differs by more than a
constant from the guess.  The states in which the chunks are entered are
settled in the same way, forwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsift.session import materialise

Batches = Iterator[pa.RecordBatch]
Vector = tuple[int, ...]

DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: States: nothing kept so far, then after a system, a user's, an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a turn of the role that is due leads, and its initial.
DUE = (USER, USER, ASSISTANT, USER)
DUE_ROLE = "uuau"
#: Where keeping a turn leads, by its initial.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Costs of what has to be put in behind the last turn.
END: Vector = (0, 2 * INSERT, INSERT, 0)
INITIALS = "sua"
NAMES = {"u": "user", "a": "assistant"}
#: Faults in a turn's code; the code is the place of its initial (3 for another one) plus 4 times the fault.
FINE, GOES, CUT = range(3)
CHUNK = 1024
SPACES = " \t\n\x0b\x0c\r"


# -- one conversation ----------------------------------------------------------

def _ways(code: int, state: int, after: Vector) -> Iterator[tuple[str, int, int]]:
    """(letter, cost from here, next state) of the edits of a turn, but for insertion, in the order of their letters."""
    initial, fault = code % 4, code // 4
    yield "D", DELETE + after[state], state
    if fault == GOES:
        return
    extra = TRUNCATED if fault == CUT else 0
    kept = KEPT[INITIALS[initial]].get(state) if initial < 3 else None
    if kept is not None:
        yield "K", extra + after[kept], kept
    yield "R", REROLE + extra + after[DUE[state]], DUE[state]


@lru_cache(maxsize=1 << 16)
def costs(code: int, after: Vector) -> Vector:
    """Least costs from before a turn to the end, by state, given those from behind it."""
    best = [min(cost for _, cost, _ in _ways(code, state, after)) for state in range(4)]
    for _ in range(2):  # two turns put in lead from any state to any that turns can lead to
        best = [min(best[state], INSERT + best[DUE[state]]) for state in range(4)]
    return tuple(best)


def level(vector: Vector) -> Vector:
    """The vector less its least member: vectors that differ by a constant are one."""
    least = min(vector)
    return tuple(x - least for x in vector)


@lru_cache(maxsize=1 << 16)
def back(code: int, after: Vector) -> Vector:
    return level(costs(code, after))


@lru_cache(maxsize=1 << 16)
def forth(code: int, after: Vector, state: int) -> tuple[str, str, int]:
    """(initials of turns put in before, letter, next state) of the least cheapest edits of a turn."""
    put = ""
    here = costs(code, after)
    while True:
        letters = {letter: to for letter, cost, to in _ways(code, state, after) if cost == here[state]}
        if "D" in letters or here[state] != INSERT + here[DUE[state]]:
            letter = min(letters)
            return put, letter, letters[letter]
        put += DUE_ROLE[state]
        state = DUE[state]


def to_front(codes: bytes, end: Vector) -> Vector:
    """The vector before the first turn, from the one behind the last, both levelled."""
    for code in reversed(codes):
        end = back(code, end)
    return end


def trace(codes: bytes, end: Vector, state: int) -> tuple[list[tuple[str, str, int]], int]:
    """The edits of all turns, each with the state it was met in, and the last state."""
    behind = [end]
    for code in reversed(codes[1:]):
        behind.append(back(code, behind[-1]))
    edits = []
    for code, after in zip(codes, reversed(behind)):
        put, letter, to = forth(code, after, state)
        edits.append((put, letter, state))
        state = to
    return edits, state


def ending(state: int) -> str:
    """Initials of the turns that have to be put in at the end."""
    return {START: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}[state]


# -- chunks ---------------------------------------------------------------------

class Repair(NamedTuple):
    """``turns``: conv, turn, line, role, text, copies, blank, cut.  ``edits``: conv, turn, line, copies, first,
    before, edit, new_role, behind.  (conv, turn, line) is unique in both."""

    turns: DataFrame
    edits: DataFrame


def distinct_turns(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """``conv, turn, line, role, text, copies, blank, cut``: equal turns of a conversation once, with their number."""
    space = F.lit(" ")
    named = turns.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.lit(1) if copies is None else copies).alias("n"),
    )
    once = named.groupBy("conv", "turn", "role", "text").agg(F.sum("n").cast("long").alias("copies"))
    shown = F.rtrim("text", F.lit(SPACES))
    line = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return once.select(
        "conv", "turn", F.unhex(line).alias("line"), "role", "text", "copies",
        (shown == "").alias("blank"), (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )


def _coded(turns: DataFrame) -> DataFrame:
    """``conv, turn, line, copies, first, code``: whether a turn is the first of its role and text, and its code."""
    place = F.struct(F.col("turn").isNotNull().alias("timed"), F.col("turn").alias("turn"))
    first = turns.groupBy(F.col("conv").alias("_conv"), F.col("line").alias("_line")).agg(F.min(place).alias("_at"))
    met = turns.select("conv", "turn", "line", "copies", "blank", "cut", "role").join(
        first,
        F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("line") == F.col("_line")) & F.col("turn").eqNullSafe(F.col("_at.turn")),
        "left",
    )
    new = F.col("_line").isNotNull()
    initial = F.left("role", F.lit(1))
    place_of = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(F.col("blank") | ~new, GOES).when(F.col("cut"), CUT).otherwise(FINE)
    return met.select("conv", "turn", "line", "copies", new.alias("first"), (place_of + 4 * fault).cast("int").alias("code"))


_PACKED = ("turn", "line", "copies", "first")


def _pack(size: int) -> Callable[[Batches], Batches]:
    """Turns in order to chunks of at most ``size`` turns of one conversation, numbered within the partition."""

    def run(batches: Batches) -> Batches:
        part, nth = TaskContext.get().partitionId(), 0
        held: pa.RecordBatch | None = None
        held_starts = True

        def emit(rows: pa.RecordBatch, cuts: list[tuple[int, int, bool, bool]]) -> pa.RecordBatch:
            nonlocal nth
            offsets = pa.array([cuts[0][0], *[to for _, to, _, _ in cuts]], pa.int32())
            codes = rows.column("code").to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
            pieces = [codes[i:j] for i, j, _, _ in cuts]
            out = {
                "part": pa.array([part] * len(cuts), pa.int32()), "nth": pa.array(range(nth, nth + len(cuts)), pa.int64()),
                "conv": rows.column("conv").take(pa.array([i for i, _, _, _ in cuts])),
                "starts": pa.array([s for _, _, s, _ in cuts]), "ends": pa.array([e for _, _, _, e in cuts]),
                "codes": pa.array(pieces, pa.binary()), "into": pa.array([END] * len(cuts), pa.list_(pa.int32())),
                "out": pa.array([to_front(p, END) for p in pieces], pa.list_(pa.int32())),
                **{name: pa.ListArray.from_arrays(offsets, rows.column(name)) for name in _PACKED},
            }
            nth += len(cuts)
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            if not len(batch):
                continue
            rows = batch
            if held is not None:
                rows = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            convs = rows.column("conv").to_pylist()
            at, starts, cuts = 0, held_starts, []
            for i in range(1, len(convs) + 1):
                over = i < len(convs) and convs[i] != convs[i - 1]
                if over or (i < len(convs) and i - at == size):
                    cuts.append((at, i, starts, over))
                    at, starts = i, over
            held, held_starts = rows.slice(at), starts
            if cuts:
                yield emit(rows, cuts)
        if held is not None:
            rows = pa.Table.from_batches([held]).combine_chunks().to_batches()[0]
            yield emit(rows, [(0, len(rows), held_starts, True)])

    return run


def _chunks(coded: DataFrame, size: int) -> DataFrame:
    """All turns as chunks ``g, opens, closes, conv, codes, into, out, ...``, numbered in order.

    A range partition holds a contiguous piece of the order, however the turns
    are shared among the conversations.  Only the numbers of chunks and the
    conversations at the edges of the partitions come to the driver.
    """
    spark = coded.sparkSession
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("line").asc()]
    conv = coded.schema["conv"].dataType.simpleString()
    packed = materialise(
        coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
            _pack(size),
            f"part int, nth long, conv {conv}, starts boolean, ends boolean, codes binary, into array<int>, out array<int>, "
            "turn array<long>, line array<binary>, copies array<long>, first array<boolean>",
        )
    )
    edges = packed.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("conv", "nth").alias("head"), F.max_by("conv", "nth").alias("tail")
    ).orderBy("part").collect()
    rows, before = [], 0
    for i, e in enumerate(edges):
        goes_on = i > 0 and edges[i - 1]["tail"] == e["head"]
        goes_past = i + 1 < len(edges) and edges[i + 1]["head"] == e["tail"]
        rows.append((e["part"], before, before + e["n"] - 1, goes_on, goes_past))
        before += e["n"]
    at = spark.createDataFrame(rows, "part int, _from long, _last long, _goes_on boolean, _goes_past boolean")
    g = F.col("_from") + F.col("nth")
    return packed.join(F.broadcast(at), "part").select(
        g.alias("g"), (F.col("starts") & ~((F.col("nth") == 0) & F.col("_goes_on"))).alias("opens"),
        (F.col("ends") & ~((g == F.col("_last")) & F.col("_goes_past"))).alias("closes"),
        "conv", "codes", "into", "out", *_PACKED,
    )


def settle(chunks: DataFrame, run: Callable[[bytes, list[int], list[int]], list[int]], forwards: bool) -> DataFrame:
    """Fix-up passes over ``g, opens, closes, codes, fixed, into, out`` until each chunk took what its neighbour gave.

    In pass p a task hands results on through 2**p neighbouring chunks, so
    chunks that never converge take as many passes as their number has binary
    digits; those that do, one or two.
    """
    step, edge, order = (1, "opens", F.col("g").asc()) if forwards else (-1, "closes", F.col("g").desc())

    def rerun(batches: Batches) -> Batches:
        stretch = given = last = None
        for batch in batches:
            columns = batch.to_pydict()
            into, out = columns["into"], columns["out"]
            for i, (s, g) in enumerate(zip(columns["stretch"], columns["g"])):
                if columns[edge][i]:
                    given = into[i]
                elif s != stretch or last is None or g != last + step:
                    given = columns["given"][i]
                if given != into[i]:
                    into[i], out[i] = given, run(columns["codes"][i], columns["fixed"][i], given)
                stretch, last, given = s, g, out[i]
            yield pa.RecordBatch.from_arrays(
                [batch.column(f) if f not in ("into", "out") else pa.array(columns[f], pa.list_(pa.int32())) for f in names], names=list(names)
            )

    names = ("g", "opens", "closes", "codes", "fixed", "into", "out")
    schema = chunks.select(*names).schema
    reach = 1
    while True:
        handed = chunks.select((F.col("g") + step).alias("g"), F.col("out").alias("given"))
        met = chunks.select(*names).join(handed, "g", "left")
        wrong = met.where(~F.col(edge) & (F.col("given") != F.col("into")))
        if wrong.isEmpty():
            return chunks
        stretch = F.floor(F.col("g") / reach).alias("stretch")
        chunks = materialise(
            met.select("*", stretch).repartition("stretch").sortWithinPartitions("stretch", order).mapInArrow(rerun, schema)
        )
        reach *= 2


def _back(codes: bytes, fixed: list[int], end: list[int]) -> list[int]:
    return list(to_front(codes, tuple(end)))


def _forth(codes: bytes, fixed: list[int], state: list[int]) -> list[int]:
    return [trace(codes, tuple(fixed), state[0])[1]]


def _write_down(batches: Batches) -> Batches:
    """Chunks with their vector behind and their first state to edits."""
    for batch in batches:
        before, letters, roles, behind = [], [], [], []
        for codes, end, state, closes in zip(*(batch.column(c).to_pylist() for c in ("codes", "end", "state", "closes"))):
            edits, last = trace(codes, tuple(end), state)
            for put, letter, met in edits:
                due = DUE_ROLE[_after(met, put)]
                before.append(put)
                letters.append(letter)
                roles.append(due if letter == "R" else None)
                behind.append("")
            if closes:
                behind[-1] = ending(last)
        sizes = batch.column("line").value_lengths()
        convs = batch.column("conv").take(pa.array(np.repeat(np.arange(len(batch)), sizes.to_numpy(zero_copy_only=False))))
        yield pa.RecordBatch.from_arrays(
            [convs, *[batch.column(c).flatten() for c in _PACKED], *[pa.array(x, pa.string()) for x in (before, letters, roles, behind)]],
            names=["conv", *_PACKED, "before", "edit", "new_role", "behind"],
        )


def _after(state: int, put: str) -> int:
    for _ in put:
        state = DUE[state]
    return state


def repair(turns: DataFrame, copies: Column | None = None, size: int = CHUNK) -> Repair:
    """The cheapest edits that give every conversation of ``conv_id, turn, role, text`` the structure above.

    Turns stand in the order of ``turn``, null first, those of one number by
    the digest of role and text (``line``).  Equal turns of one number are one
    row with their ``copies`` (with ``copies``, each row counts that often);
    all copies but the first are deleted.  A null role or text is one blank.
    A turn has to go if its text is blank or its role and text came before;
    keeping one whose last character but white space is none of ``.!?`` costs
    3 more.  Costs: another role 3, deletion 4, an empty turn put in 3.

    ``before``: initials of the turns put in before this one; ``edit``: K, R or
    D; ``new_role``: the initial of an R; ``behind``: of those put in after the
    last turn.  An empty table gives empty tables.  A null ``conv_id`` is a
    conversation.
    """
    once = materialise(distinct_turns(turns, copies))
    chunks = materialise(_chunks(_coded(once), size))
    several = chunks.where(~F.col("opens") | ~F.col("closes"))
    narrow = several.select("g", "opens", "closes", "codes", F.array(F.lit(0)).alias("fixed"), "into", "out")
    end = F.array(*map(F.lit, END))
    if several.isEmpty():
        known = chunks.select("*", end.alias("end"), F.lit(START).alias("state"))
    else:
        costed = settle(narrow, _back, forwards=False)
        guessed = costed.select(
            "g", "opens", "closes", "codes", F.col("into").alias("fixed"),
            F.array(F.when(F.col("opens"), START).otherwise(ASSISTANT)).alias("into"), F.array(F.lit(-1)).alias("out"),
        ).mapInArrow(_first_states, "g long, opens boolean, closes boolean, codes binary, fixed array<int>, into array<int>, out array<int>")
        placed = settle(materialise(guessed), _forth, forwards=True)
        found = placed.select("g", F.col("fixed").alias("_end"), F.col("into")[0].alias("_state"))
        known = chunks.drop("into", "out").join(found, "g", "left").select(
            "*", F.coalesce("_end", end).alias("end"), F.coalesce("_state", F.lit(START)).alias("state")
        )
    conv = once.schema["conv"].dataType.simpleString()
    edits = known.select("conv", "codes", "end", "state", "closes", *_PACKED).mapInArrow(
        _write_down,
        f"conv {conv}, turn long, line binary, copies long, first boolean, before string, edit string, new_role string, behind string",
    )
    return Repair(once, edits)


def _first_states(batches: Batches) -> Batches:
    for batch in batches:
        out = [
            _forth(codes, fixed, state)
            for codes, fixed, state in zip(*(batch.column(c).to_pylist() for c in ("codes", "fixed", "into")))
        ]
        yield batch.set_column(batch.schema.get_field_index("out"), "out", pa.array(out, pa.list_(pa.int32())))


# -- summaries --------------------------------------------------------------------

def _sum_up(batches: Batches) -> Batches:
    names = ("conv", "turn", "line", "copies", "first", "before", "edit", "new_role", "behind", "blank", "cut", "role", "text")
    fields = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    conv = None
    sums: dict[str, int] = {}
    audit: list[str] = []
    digest, lines, initial, low, high, distinct, edit = sha256(), 0, None, None, None, 0, None
    open_ = False

    def line(text: str) -> None:
        nonlocal lines
        digest.update((("\n" if lines else "") + text).encode())
        lines += 1

    def put(initials: str) -> None:
        audit.append("I" * len(initials))
        sums["cost"] += INSERT * len(initials)
        for i in initials:
            line(NAMES[i] + ":")

    def close() -> tuple:
        gaps = high - low + 1 - distinct if distinct else 0
        return conv, *(gaps if f == "gaps" else sums[f] for f in fields), "".join(audit), digest.hexdigest()

    for batch in batches:
        out = []
        for c, turn, _, copies, first, before, letter, new_role, behind, blank, cut, role, text in zip(*(batch.column(n).to_pylist() for n in names)):
            if not open_ or c != conv:
                if open_:
                    out.append(close())
                open_, conv, sums, audit, digest = True, c, dict.fromkeys(fields, 0), [], sha256()
                lines, initial, low, high, distinct = 0, None, None, None, 0
            if letter is not None:  # the edit of the turn that comes next
                edit = (copies, first, before, letter, new_role, behind)
                continue
            copies, first, before, letter, new_role, behind = edit
            if turn is not None:
                low, distinct = turn if low is None else low, distinct + (turn != high)
                high = turn
            if blank:
                sums["blank"] += copies
            else:
                sums["duplicate"] += copies - first
                sums["truncated"] += first and cut
            legal = (("s", "u"), ("u", "a"), ("a", "u"))
            sums["illegal"] += copies - 1 + (initial is not None and (initial, role[:1]) not in legal)
            initial = role[:1]
            put(before)
            audit.append(letter + "D" * (copies - 1))
            sums["cost"] += DELETE * (copies - (letter != "D")) + (REROLE if letter == "R" else 0) + (TRUNCATED if letter != "D" and cut else 0)
            if letter != "D":
                line((NAMES[new_role] if letter == "R" else role) + ":" + text)
            put(behind)
        if out:
            yield _summary_rows(out, batch.schema.field("conv").type, fields)
    if open_:
        yield _summary_rows([close()], batch.schema.field("conv").type, fields)


def _summary_rows(rows: list[tuple], conv: pa.DataType, fields: tuple[str, ...]) -> pa.RecordBatch:
    types = (conv, *[pa.int64()] * len(fields), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["conv", *fields, "audit", "repaired_sha256"]
    )


def summarise(repaired: Repair) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of each conversation with turns.

    A SHA-256 digest is worked out from the first byte to the last, so here, and
    only here, a conversation's turns pass one task, one after the other;
    nothing of them is held but the letters of the audit.
    """
    kinds = {f.name: f.dataType for df in (repaired.edits, repaired.turns) for f in df.schema}
    names = ("conv", "turn", "line", "copies", "first", "before", "edit", "new_role", "behind", "blank", "cut", "role", "text")

    def side(df: DataFrame, *left_out: str) -> DataFrame:
        return df.select(*[
            F.col(n) if n in df.columns and n not in left_out else F.lit(None).cast(kinds[n]).alias(n) for n in names
        ])

    both = side(repaired.edits).unionByName(side(repaired.turns, "copies"))
    in_order = both.repartition("conv").sortWithinPartitions(
        F.col("conv"), F.col("turn").asc_nulls_first(), "line", F.col("edit").asc_nulls_last()
    )
    conv = kinds["conv"].simpleString()
    return in_order.mapInArrow(
        _sum_up,
        f"conv {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string",
    )


def repaired_turns(repaired: Repair) -> DataFrame:
    """``conv, turn, line, nth, role, text``: the turns of the repaired conversations.

    Those put in have no text and, by ``nth``, stand before (negative) or behind
    (positive) the turn of the same ``turn`` and ``line``, whether it stays or not.
    """
    met = repaired.edits.join(
        repaired.turns.select(F.col("conv").alias("_c"), F.col("turn").alias("_t"), F.col("line").alias("_l"), "role", "text"),
        F.col("conv").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")) & (F.col("line") == F.col("_l")),
    )

    def put(initials: Column, shift: Column) -> Column:
        return F.transform(
            F.filter(F.split(initials, ""), lambda i: i != ""),
            lambda i, n: F.struct((n + shift).alias("nth"), F.when(i == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")),
        )

    role = F.when(F.col("new_role") == "u", "user").when(F.col("new_role") == "a", "assistant").otherwise(F.col("role"))
    own = F.struct(F.lit(0).alias("nth"), role.alias("role"), F.col("text").alias("text"))
    stays = F.when(F.col("edit") != "D", F.array(own)).otherwise(F.array().cast("array<struct<nth:int,role:string,text:string>>"))
    all_ = F.concat(put(F.col("before"), -F.length("before")), stays, put(F.col("behind"), F.lit(1)))
    return met.select("conv", "turn", "line", F.explode(all_).alias("_x")).select("conv", "turn", "line", "_x.*")


def damage(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Turns with faults made on purpose, by a checksum of conversation and number, and how often each counts.

    Of 20 parts one is dropped, one loses its text, one its sentence ends, one
    stands twice, one becomes a user's.  Nulls are one blank.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name) % 20
    text = F.coalesce("text", space)
    damaged = turns.withColumn("_kind", kind).where("_kind <> 0").select(
        "conv_id", "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(F.col("_kind") == 3, 2).otherwise(1).alias("_copies"),
    )
    return damaged, F.col("_copies")
