"""Conversation structure repair by Four-Russians block tables.

A repaired conversation's role initials read ``(s?(ua)+)?``: an automaton of four states.
Each row is one of twelve symbols (its role's kind and its fault), and the cheapest edits
from a row on, for each state, are a vector of four costs. Less its least entry, such a
vector is one of a few dozen, so the step over a symbol is a table lookup, and so is the
step over every block of ``BLOCK`` symbols: both tables are worked out before any row is
seen. A first pass runs over the blocks from the last to the first by lookup and keeps the
vector at each block's end. The second pass runs forward: it expands one block at a time
backward into the vectors behind its rows, then takes at each row the edit with the least
letter among those that lose nothing, which gives the least of all cheapest edit strings.

A conversation is cut into segments of rows that follow one another. Of a conversation
with several segments, each segment first becomes its map from every vector behind it to
the one before it; those maps are joined into the vectors at the segments' ends, and the
forward states likewise. So rows of one conversation spread over tasks.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import stored

BLOCK = 4
#: Rows of a segment: a power of two.
SEGMENT_BITS = 14

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_ROLES = "sua"
_NEXT = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT,
}
#: Rows inserted behind the last one, by state; what they cost is the last vector.
_ADDED = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
_END = tuple(INSERT * len(_ADDED[q]) for q in range(4))
#: What a row must be: fine, truncated, to be deleted.
FINE, CUT_SHORT, MUST_GO = range(3)
SYMBOLS = 12


def _moves(symbol: int, state: int):
    """(letter, cost, next state) of each edit of a row but insertions."""
    role, status = divmod(symbol, 3)
    yield "D", DELETE, state
    if status == MUST_GO:
        return
    extra = TRUNCATED if status == CUT_SHORT else 0
    kept = _NEXT.get((state, _ROLES[role])) if role < 3 else None
    if kept is not None:
        yield "K", KEEP + extra, kept
    for to in "ua":
        if (state, to) in _NEXT:
            yield "R", REROLE + extra, _NEXT[state, to]


def _inserted(state: int) -> int:
    """The state after an inserted row: there is one role that may follow."""
    return ASSISTANT if state == USER else USER


def _before(after: tuple[int, ...], symbol: int) -> list[int]:
    """Costs to the end before a row, from those behind it; rows may be inserted before it."""
    costs = [min(c + after[to] for _, c, to in _moves(symbol, q)) for q in range(4)]
    for _ in range(3):
        costs = [min(c, INSERT + costs[_inserted(q)]) for q, c in enumerate(costs)]
    return costs


class Tables:
    """All vectors that occur, steps over symbols and blocks, and the choices at a row.

    ``step[n][v, code]`` is the number of the vector before ``n`` symbols, ``code`` in base
    twelve with the first symbol leading, when ``v`` is the vector behind them. Vector 0
    is the one at the end of a conversation. ``choice[v][symbol][state]`` is (letters of
    the edits up to and with the row, next state, cost).
    """

    def __init__(self) -> None:
        vectors = [_END]
        numbers = {_END: 0}
        one, self.choice = [], []
        for v in vectors:  # grows while it is read
            row, chosen = [], []
            for symbol in range(SYMBOLS):
                costs = _before(v, symbol)
                found = tuple(c - min(costs) for c in costs)
                if found not in numbers:
                    numbers[found] = len(vectors)
                    vectors.append(found)
                row.append(numbers[found])
                chosen.append([self._chosen(v, symbol, costs, q) for q in range(4)])
            one.append(row)
            self.choice.append(chosen)
        self.vectors = vectors
        self.step = [None, np.array(one, dtype=np.int16)]
        for n in range(2, BLOCK + 1):
            tail = self.step[n - 1]
            self.step.append(np.concatenate([self.step[1][tail, x] for x in range(SYMBOLS)], axis=1))

    @staticmethod
    def _chosen(after: tuple[int, ...], symbol: int, costs: list[int], state: int) -> tuple[str, int, int]:
        letters, spent = "", 0
        while True:
            left = costs[state]
            moves = {k: (c, to) for k, c, to in _moves(symbol, state) if c + after[to] == left}
            if "D" not in moves and INSERT + costs[_inserted(state)] == left:
                letters, spent, state = letters + "I", spent + INSERT, _inserted(state)
                continue
            letter = min(moves)
            cost, to = moves[letter]
            return letters + letter, to, spent + cost

    def blocks(self, symbols: np.ndarray) -> tuple[np.ndarray, int]:
        """Codes of the whole blocks, and the number of symbols before the first of them."""
        short = len(symbols) % BLOCK
        whole = symbols[short:].reshape(-1, BLOCK).astype(np.int64)
        return whole @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1)), short

    def through(self, symbols: np.ndarray) -> np.ndarray:
        """Number of the vector before the symbols for every vector behind them."""
        codes, short = self.blocks(symbols)
        now = np.arange(len(self.vectors))
        step = self.step[BLOCK]
        for code in codes[::-1]:
            now = step[now, code]
        for x in symbols[:short][::-1]:
            now = self.step[1][now, x]
        return now

    def trace(self, symbols: np.ndarray, behind: int, state: int) -> tuple[str, int, int]:
        """(edits, state at the end, cost) of the rows, with vector ``behind`` after them."""
        codes, short = self.blocks(symbols)
        step, one = self.step[BLOCK], self.step[1]
        ends = [behind]
        for code in codes[::-1]:
            ends.append(int(step[ends[-1], code]))
        parts = [symbols[:short].tolist(), *symbols[short:].reshape(-1, BLOCK).tolist()]
        letters, cost = [], 0
        for part, v in zip(parts, ends[::-1]):
            after = [v]
            for x in part[:0:-1]:
                after.append(int(one[after[-1], x]))
            for x, v in zip(part, after[::-1]):
                edits, state, c = self.choice[v][x][state]
                letters.append(edits)
                cost += c
        return "".join(letters), state, cost


@cache
def tables() -> Tables:
    return Tables()


def _symbols(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), dtype=np.uint8) - 97


def damaged(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """(conv, turn, role, text) after damage: a fifth of the rows by checksum of their place.

    ``conv`` is the conversation's number as text. Null numbers and turns are one space in
    the checksum, null roles and texts one space in the row. A row is dropped, emptied,
    loses its sentence ends, is repeated, or becomes a user's, at the remainders 0 to 4.
    """
    blank = F.lit(" ")
    conv = F.coalesce(F.col(conv_id).cast("string"), blank)
    key = F.concat(conv, F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))
    fault = F.crc32(key.cast("binary")) % 20
    body, who = F.coalesce(F.col(text), blank), F.coalesce(F.col(role), blank)
    made = rows.select(
        conv.alias("conv"), F.col(turn).cast("long").alias("turn"), fault.alias("fault"),
        F.when(fault == 4, F.lit("user")).otherwise(who).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(body, ".!?", "")).otherwise(body).alias("text"),
    ).where("fault <> 0")
    times = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return made.withColumn("copy", F.explode(times)).select("conv", "turn", "role", "text")


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` in order with their ``place``: by conversation, turn, role and text.

    Ranges are sorted by tasks, so a conversation may lie in several. The last key parts
    rows that are equal in everything, which may stand in either order.
    """
    keys = [F.col("conv"), F.col("turn").asc_nulls_first(), "role", "text", "any"]
    ordered = rows.withColumn("any", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stored(ordered.select("conv", F.monotonically_increasing_id().alias("place"), "turn", "role", "text"), "rows")


def _faults(placed: DataFrame) -> DataFrame:
    """(conv, place, turn, status, kind): fault 0 to 3 of each row and its role's number."""
    text = F.col("text")
    who = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    thin = stored(
        placed.select(
            "conv", "place", "turn", F.unhex(F.md5(who)).alias("digest"),
            (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
            (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"),
            F.instr(F.lit(_ROLES), F.substring("role", 1, 1)).alias("at"), F.length("role").alias("named"),
        ),
        "thin",
    )
    first = stored(
        thin.groupBy("conv", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
        .select("conv", "digest", "first"),
        "repeated",
    )
    kind = F.when((F.col("named") > 0) & (F.col("at") > 0), F.col("at") - 1).otherwise(F.lit(3))
    fault = F.when(F.col("blank"), F.lit("blank")).when(F.col("place") > F.col("first"), F.lit("duplicate")).when(
        F.col("open"), F.lit("truncated"))
    return thin.join(first, ["conv", "digest"], "left").select(
        "conv", "place", "turn", fault.alias("fault"), kind.alias("kind")
    )


def _per_row(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` of each row as a dict, which gives a tuple in the schema's order: longs, lists of them, texts."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            made = [fn(row) for row in batch.to_pylist()]
            if made:
                yield pa.RecordBatch.from_pydict({n: [m[i] for m in made] for i, n in enumerate(names)})

    return df.mapInArrow(run, schema)


def _borders(segments: DataFrame) -> DataFrame:
    """(conv, segment, behind, state, before) of the segments of conversations with several.

    ``behind`` is the vector at the segment's end, ``state`` the one at its start, and
    ``before`` the role of the row before it. Of a segment a group holds a few dozen
    numbers, one row for each ``2**SEGMENT_BITS`` rows of the conversation.
    """
    several = segments.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv")
    some = stored(segments.join(several, "conv"), "several")

    def maps(row):
        return row["conv"], row["segment"], tables().through(_symbols(row["symbols"])).tolist(), row["symbols"][-1]

    def backward(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["segment"])
        behind, out = 0, []
        for row in rows[::-1]:
            out.append(behind)
            behind = row["map"][behind]
        before = [None, *(r["last"] for r in rows[:-1])]
        return pa.table({
            "conv": [r["conv"] for r in rows], "segment": pa.array([r["segment"] for r in rows], pa.int64()),
            "behind": pa.array(out[::-1], pa.int32()), "before": pa.array(before, pa.string()),
        })

    made = _per_row(some, maps, "conv string, segment long, map array<long>, last string")
    ends = stored(
        made.groupBy("conv").applyInArrow(backward, "conv string, segment long, behind int, before string"), "ends"
    )

    def states(row):
        x = _symbols(row["symbols"])
        return row["conv"], row["segment"], [tables().trace(x, row["behind"], q)[1] for q in range(4)]

    def forward(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["segment"])
        state, out = START, []
        for row in rows:
            out.append(state)
            state = row["map"][state]
        return pa.table({
            "conv": [r["conv"] for r in rows], "segment": pa.array([r["segment"] for r in rows], pa.int64()),
            "state": pa.array(out, pa.int32()),
        })

    walked = _per_row(some.join(ends, ["conv", "segment"]), states, "conv string, segment long, map array<long>")
    starts = walked.groupBy("conv").applyInArrow(forward, "conv string, segment long, state int")
    return stored(ends.join(starts, ["conv", "segment"]), "borders")


_LEGAL = ("su", "ua", "au")


def _edit(row: dict) -> tuple:
    x = _symbols(row["symbols"])
    audit, _, cost = tables().trace(x, row["behind"], row["state"])
    kinds = "".join("sua "[k] for k in x // 3)
    if row["before"]:
        kinds = "sua "[(ord(row["before"]) - 97) // 3] + kinds
    illegal = sum(a + b not in _LEGAL for a, b in zip(kinds, kinds[1:]))
    return row["conv"], row["place"], audit, cost, illegal


class _Conversation:
    """Audit and digest of one repaired conversation, given its rows one after another."""

    def __init__(self) -> None:
        self.digest, self.state, self.audit, self.lines = hashlib.sha256(), START, [], 0
        self.edits = iter("")

    def line(self, role: bytes, text: bytes) -> None:
        self.digest.update((b"\n" if self.lines else b"") + role + b":" + text)
        self.lines += 1

    def forced(self, text: bytes) -> None:
        """A row of the one role that may follow."""
        self.state = _inserted(self.state)
        self.line(b"user" if self.state == USER else b"assistant", text)

    def row(self, role: bytes, text: bytes) -> None:
        for letter in self.edits:
            if letter == "I":
                self.forced(b"")
                continue
            if letter == "K":
                self.state = _NEXT[self.state, chr(role[0])]
                self.line(role, text)
            elif letter == "R":
                self.forced(text)
            return

    def done(self) -> tuple[str, str, int]:
        added = _ADDED[self.state]
        for _ in added:
            self.forced(b"")
        return "".join(self.audit) + added, self.digest.hexdigest(), INSERT * len(added)


def _written(batches):
    """(conv, audit, repaired_sha256, added) of each conversation of a sorted partition.

    The edits of a segment come before its first row. Only the digest and the edits of one
    conversation are held.
    """
    key, now = None, _Conversation()

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
            names=["conv", "audit", "repaired_sha256", "added"],
        )

    for batch in batches:
        out = []
        for conv, edits, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "edits", "role", "text"))):
            if conv != key:
                if key is not None:
                    out.append((key, *now.done()))
                key, now = conv, _Conversation()
            if edits is None:
                now.row(role, text)
            else:
                now.audit.append(edits)
                now.edits = iter(edits)
        yield made(out)
    if key is not None:
        yield made([(key, *now.done())])


def repair(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    ``rows`` are damaged first (see ``damaged``), then read by turn, null turns first;
    rows of one turn by role, then text. One row comes out for every number of a
    conversation, null among them: with zeros, no edits and the digest of the empty text if
    none of its rows is left. Repeated rows are repeated rows of the conversation, so
    duplicates. An empty table gives none; other columns are not looked at. Texts of any
    length are whole. The digest of a conversation is a chain by nature: its rows pass one
    task in order, one batch in memory.
    """
    named = rows.select(
        F.coalesce(F.col(conv_id).cast("string"), F.lit(" ")).alias("conv"), F.col(conv_id).alias("conv_id")
    ).distinct()
    placed = _placed(damaged(rows, conv_id, turn, role, text))
    marked = stored(_faults(placed), "faults")
    status = F.when(F.col("fault").isin("blank", "duplicate"), F.lit(MUST_GO)).when(
        F.col("fault") == "truncated", F.lit(CUT_SHORT)).otherwise(F.lit(FINE))
    symbol = F.substring(F.lit("abcdefghijkl"), F.col("kind") * 3 + status + 1, F.lit(1))
    ordered = F.sort_array(F.collect_list(F.struct("place", symbol.alias("x"))))
    segments = stored(
        marked.groupBy("conv", F.shiftright("place", SEGMENT_BITS).alias("segment")).agg(ordered.alias("s"))
        .select("conv", "segment", F.col("s")[0]["place"].alias("place"),
                F.array_join(F.transform("s", lambda x: x["x"]), "").alias("symbols")),
        "segments",
    )
    edits = stored(_per_row(
        segments.join(_borders(segments), ["conv", "segment"], "left").select(
            "conv", "place", "symbols", F.coalesce("behind", F.lit(0)).alias("behind"),
            F.coalesce("state", F.lit(START)).alias("state"), "before"),
        _edit, "conv string, place long, audit string, cost long, illegal long",
    ), "edits")
    lines = placed.select("conv", "place", F.lit(1).alias("then"), F.lit(None).cast("string").alias("edits"),
                          F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"))
    none = F.lit(None).cast("binary")
    both = lines.unionByName(edits.select(
        "conv", "place", F.lit(0).alias("then"), F.col("audit").alias("edits"), none.alias("role"), none.alias("text")))
    final = both.repartition("conv").sortWithinPartitions("conv", "place", "then").select(
        "conv", "edits", "role", "text"
    ).mapInArrow(_written, "conv string, audit string, repaired_sha256 string, added long")
    counts = marked.groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    costs = edits.groupBy("conv").agg(F.sum("cost").alias("edited"), F.sum("illegal").alias("illegal"))
    zero = ["gaps", "blank", "duplicate", "truncated", "illegal"]
    out = named.join(counts, "conv", "left").join(costs, "conv", "left").join(final, "conv", "left")
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zero],
        (F.coalesce("edited", F.lit(0)) + F.coalesce("added", F.lit(0))).cast("long").alias("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
