"""Repair of conversation structure by a run-length dynamic program over role and fault symbols.

A row is one of nine symbols: its role initial (s, u, a or another) with or without a cut-off end, or
one that must go.  An edit sequence walks through four states of what has been put out so far (nothing,
ends in s, in u, in a); each symbol has a min-plus matrix of the cheapest way from state to state, with
all insertions before the row in it.  Equal consecutive symbols are collapsed to a run, and a run is
crossed by binary powers of its matrix, which are kept for all conversations.

Conversations of any length are spread over tasks.  Rows are placed once by range (conversation, turn,
role, text); the rows of a conversation among ``FRAGMENT`` consecutive places are a fragment.
1. Each fragment gets its matrix and its counts.
2. The fragments' matrices of a conversation are multiplied from the end: what is still to be paid
   behind each fragment, by state.
3. Each fragment unrolls its choices for every state it can be entered in: in each step the edit of the
   smallest initial that still leads to the least cost.  That is the ASCII-least audit of all cheapest ones.
4. A walk over a conversation's fragments picks the choices that fit together.
5. Fragments write their repaired rows, and these are joined and hashed by conversation.
Only matrices of fragments (and the audit and the text, which are one cell each by their nature) meet in
one group.

Defined results: null values count as one blank, in the key of the damage and as role and text; rows of
equal turn are ordered by role, then text (in code units), and equal rows all count; null turns stand first
and fill no gap; an empty role is no known initial; a conversation with a null conv_id is one of its own; one
without rows after the damage has zeros, an empty audit and the hash of the empty text; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catamatch.llm.common import map_slices
from catamatch.operators.stage import written

FRAGMENT_BITS = 16
#: Symbols: 2 * initial + cut-off end for s, u, a and others; GONE must be deleted.
INITIALS, GONE = "sua", 8
S, U, A = range(3)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
_NEVER = 1 << 50
#: States: nothing yet, after s, after u, after a.  What may follow, and the next state.
_NEXT = ((S, 1), (U, 2)), ((U, 2),), ((A, 3),), ((U, 2),)
_ENDS = (0, 3)
#: What to insert in each state to come to an end.
_FINISH = (0, 2 * INSERT, INSERT, 0)
_BLANK = r"[\x20\x09-\x0D]"


def damaged(rows: DataFrame, kind: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text after the damage; ``kind`` (0 to 19) says which rows suffer which."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    if kind is None:
        kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(copies).alias("copy")).drop("copy")


def placed(rows: DataFrame, bits: int = FRAGMENT_BITS) -> DataFrame:
    """The rows with ``pos``, ascending in the order of conversation, turn, role and text, and ``place``, the same for 2^bits of them."""
    order = ["conv_id", "turn", "role", "text"]
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "pos", F.monotonically_increasing_id()).select(
        "*", F.shiftright("pos", bits).alias("place"), F.coalesce("conv_id", F.lit(0)).alias("c"),
        F.col("conv_id").isNull().alias("nameless")))


FRAGMENT = ["c", "nameless", "place"]


def fragments(rows: DataFrame) -> DataFrame:
    """A row per fragment: at (its first pos), conv_id, and symbols, initials and turns of its rows in order."""
    firsts = rows.groupBy("c", "nameless", "role", F.sha2("text", 256).alias("h")).agg(F.min("pos").alias("pos"))
    firsts = firsts.select("pos", F.lit(True).alias("first"))
    letter = F.substring("role", 1, 1)
    initial = F.when(letter == "s", S).when(letter == "u", U).when(letter == "a", A).otherwise(3)
    marked = rows.select(*FRAGMENT, "conv_id", "pos", "turn", initial.alias("initial"),
                         (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
                         (~F.col("text").rlike(rf"[.!?]{_BLANK}*\z")).alias("cut")).join(firsts, "pos", "left")
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    marked = marked.withColumn("row", F.struct("pos", "turn", F.col("initial").cast("byte").alias("i"), fault.cast("byte").alias("f")))
    grouped = marked.groupBy(*FRAGMENT).agg(
        F.min("conv_id").alias("conv_id"), F.min("pos").alias("at"), F.array_sort(F.collect_list("row")).alias("r"))
    initials, faults = F.transform("r", lambda r: r["i"]), F.transform("r", lambda r: r["f"])
    return grouped.select(*FRAGMENT, "conv_id", "at", initials.alias("initials"), faults.alias("faults"),
                          F.col("r.turn").alias("turns"))


# --- the program over one fragment ---------------------------------------------------------

def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _NEVER)


def _inserts() -> np.ndarray:
    """Cheapest insertions from state to state."""
    step = np.full((4, 4), _NEVER, np.int64)
    for state, ways in enumerate(_NEXT):
        step[state, state] = 0
        for role, then in ways:
            if role != S:
                step[state, then] = INSERT
    return _times(step, _times(step, step))


def edits(symbol: int) -> list[list[tuple[str, int, int]]]:
    """By state: what can be done with a row of the symbol, as (initial of the edit, cost, next state)."""
    out = []
    for state, ways in enumerate(_NEXT):
        found = [("D", DELETE, state)]
        if symbol != GONE:
            late = CUT_OFF * (symbol & 1)
            for role, then in ways:
                if role == symbol >> 1:
                    found.append(("K", KEEP + late, then))
                if role != S:
                    found.append(("R", REROLE + late, then))
        out.append(found)
    return out


_EDITS = [edits(s) for s in range(GONE + 1)]


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> np.ndarray:
    """Matrix of 2^k rows of the symbol."""
    if k:
        return _times(power(symbol, k - 1), power(symbol, k - 1))
    row = np.full((4, 4), _NEVER, np.int64)
    for state, ways in enumerate(_EDITS[symbol]):
        for _, cost, then in ways:
            row[state, then] = min(row[state, then], cost)
    return _times(_inserts(), row)


def runs(symbols: bytes) -> list[tuple[int, int]]:
    """(symbol, length) of the runs."""
    x = np.frombuffer(symbols, np.uint8)
    ends = np.append(np.flatnonzero(np.diff(x)) + 1, len(x))
    return list(zip(x[ends - 1].tolist(), np.diff(ends, prepend=0).tolist()))


def _crossed(symbol: int, n: int, after: np.ndarray) -> np.ndarray:
    """Costs (a column a state) before n rows of the symbol, given those after them."""
    k = 0
    while n:
        if n & 1:
            after = _times(power(symbol, k), after)
        n, k = n >> 1, k + 1
    return after


_START = np.where(np.eye(4, dtype=bool), 0, _NEVER).astype(np.int64)


def matrix(symbols: bytes) -> np.ndarray:
    """Min-plus matrix of a whole fragment."""
    return _matrix(symbols) if len(symbols) <= 64 else _matrix.__wrapped__(symbols)


@lru_cache(maxsize=1 << 14)
def _matrix(symbols: bytes) -> np.ndarray:
    out = _START
    for symbol, n in reversed(runs(symbols)):
        out = _crossed(symbol, n, out)
    return out


def _within(symbol: int, n: int, after: np.ndarray) -> np.ndarray:
    """Costs before the last 0, 1 .. n rows of a run, by doubling."""
    out = after[:, None]
    k = 0
    while out.shape[1] <= n:
        out = np.concatenate([out, _times(power(symbol, k), out)], axis=1)
        k += 1
    return out[:, :n + 1]


def unroll(symbols: bytes, entry: int, after: tuple[int, ...], final: bool) -> tuple[str, int]:
    """ASCII-least initials of the cheapest edits from the state ``entry``, and the state they end in.

    ``after``: what is still to be paid behind the fragment, by state; ``final``: nothing follows it.
    """
    parts, costs = runs(symbols), np.array(after, np.int64)
    stack = []
    for symbol, n in reversed(parts):
        inside = _within(symbol, n, costs)
        stack.append((symbol, n, inside))
        costs = inside[:, n]
    out, state = [], entry
    for symbol, n, inside in reversed(stack):
        table = inside.T.tolist()
        ways = _EDITS[symbol]
        for left in range(n, 0, -1):
            here, then = table[left], table[left - 1]
            while True:
                best = min((w for w in ways[state] if w[1] + then[w[2]] == here[state]), default=None)
                # D comes before an insertion, an insertion before all other edits
                if best is None or best[0] != "D":
                    role, to = _NEXT[state][-1]
                    if role != S and INSERT + here[to] == here[state]:
                        out.append("I")
                        state = to
                        continue
                out.append(best[0])
                state = best[2]
                break
    while final and state not in _ENDS:
        out.append("I")
        state = _NEXT[state][-1][1]
    return "".join(out), state


def symbols_of(initials: np.ndarray, faults: np.ndarray) -> bytes:
    """Initials 0 to 3; faults 0 none, 1 blank, 2 duplicate, 3 cut off."""
    return np.where((faults == 1) | (faults == 2), GONE, 2 * initials + (faults == 3)).astype(np.uint8).tobytes()


_LEGAL = {(S, U), (U, A), (A, U)}
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


def summaries(found: DataFrame) -> DataFrame:
    """Adds to each fragment its symbols, matrix, counts, and what its neighbours need to know."""
    def run(cols):
        names = ("symbols", "matrix", *_COUNTS, "head", "tail", "low", "high")
        out = {n: [] for n in names}
        for initials, faults, turns in zip(cols["initials"], cols["faults"], cols["turns"]):
            symbols = symbols_of(initials, faults)
            pairs = list(zip(initials.tolist(), initials.tolist()[1:]))
            values = (symbols, matrix(symbols).ravel(), int((faults == 1).sum()), int((faults == 2).sum()),
                      int((faults == 3).sum()), sum(p not in _LEGAL for p in pairs),
                      int((np.diff(turns) != 0).sum()) + 1 if len(turns) else 0, int(initials[0]), int(initials[-1]),
                      int(turns[0]) if len(turns) else None, int(turns[-1]) if len(turns) else None)
            for n, v in zip(names, values):
                out[n].append(v)
        return {**{c: cols[c] for c in ("c", "nameless", "place", "conv_id", "at")}, **out}

    # null turns fill no gap
    known = found.withColumn("turns", F.filter("turns", lambda t: t.isNotNull()))
    return map_slices(known, run, "c bigint, nameless boolean, place bigint, conv_id bigint, at bigint, symbols binary, "
                      "matrix array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, "
                      "head int, tail int, low bigint, high bigint")


def chained(sums: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations with gaps, counts and cost; fragments with what is to be paid behind them)."""
    cols = ["at", "matrix", *_COUNTS, "head", "tail", "low", "high"]
    per = sums.groupBy("c", "nameless").agg(F.min("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct(*cols))).alias("f"))
    per = per.select("conv_id", *[F.col(f"f.{c}").alias(c) for c in cols if c not in ("matrix", "low", "high")],
                     F.flatten(F.col("f.matrix")).alias("matrix"),
                     F.filter(F.col("f.low"), lambda x: x.isNotNull()).alias("low"), F.filter(F.col("f.high"), lambda x: x.isNotNull()).alias("high"))

    def run(cols):
        names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "after")
        out = {n: [] for n in names}
        for i, matrices in enumerate(cols["matrix"]):
            after = [np.array(_FINISH, np.int64)]
            for m in matrices.reshape(-1, 4, 4)[::-1]:
                after.append(_times(m, after[-1][:, None])[:, 0])
            low, high, distinct = cols["low"][i], cols["high"][i], int(cols["turns"][i].sum())
            distinct -= int((low[1:] == high[:-1]).sum())  # a turn that goes on in the next fragment
            heads, tails = cols["head"][i].tolist(), cols["tail"][i].tolist()
            between = sum(p not in _LEGAL for p in zip(tails, heads[1:]))
            values = (int(high[-1]) - int(low[0]) + 1 - distinct if len(low) else 0, *[int(cols[c][i].sum()) for c in _COUNTS[:3]],
                      int(cols["illegal"][i].sum()) + between, int(after[-1][0]), np.concatenate(after[-2::-1]))
            for n, v in zip(names, values):
                out[n].append(v)
        return {"conv_id": cols["conv_id"], "at": cols["at"], **out}

    done = written(map_slices(per, run, "conv_id bigint, at array<bigint>, gaps bigint, blank bigint, duplicate bigint, "
                              "truncated bigint, illegal bigint, cost bigint, after array<bigint>"))
    count = F.size("at")
    behind = done.select(F.explode(F.transform("at", lambda a, i: F.struct(
        a.alias("at"), F.slice("after", i * 4 + 1, F.lit(4)).alias("after"), (i == 0).alias("first"),
        (i == count - 1).alias("final")))).alias("x")).select("x.*")
    return done.drop("at", "after"), behind


def choices(sums: DataFrame, behind: DataFrame) -> DataFrame:
    """Each fragment's audits and exits, by the state it is entered in (the first one only in the first)."""
    def run(cols):
        out = {"audits": [], "exits": []}
        for symbols, after, first, final in zip(*[cols[c] for c in ("symbols", "after", "first", "final")]):
            ways = [unroll(symbols, s, tuple(after.tolist()), final) for s in range(1 if first else 4)]
            ways += [("", 0)] * (4 - len(ways))
            out["audits"].append([w[0] for w in ways])
            out["exits"].append([w[1] for w in ways])
        return {**{c: cols[c] for c in ("c", "nameless", "place", "conv_id", "at")}, **out}

    rows = sums.select("c", "nameless", "place", "conv_id", "at", "symbols").join(behind, "at")
    return written(map_slices(rows, run, "c bigint, nameless boolean, place bigint, conv_id bigint, at bigint, "
                              "audits array<string>, exits array<int>"))


def walked(found: DataFrame) -> DataFrame:
    """at, entry: the state in which each fragment is entered."""
    def run(cols):
        out = {"at": [], "entry": []}
        for at, exits in zip(cols["at"], cols["exits"]):
            state = 0
            for fragment, then in zip(at.tolist(), exits.reshape(-1, 4).tolist()):
                out["at"].append(fragment)
                out["entry"].append(state)
                state = then[state]
        return out

    per = found.groupBy("c", "nameless").agg(F.array_sort(F.collect_list(F.struct("at", "exits"))).alias("f"))
    return map_slices(per.select(F.col("f.at").alias("at"), F.flatten("f.exits").alias("exits")), run, "at bigint, entry int")


def repaired(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv_id, at, audit and the repaired rows of every fragment as text (null where none is left)."""
    def run(cols):
        out = []
        for roles, texts, audit, entry in zip(*[cols[c] for c in ("roles", "texts", "audit", "entry")]):
            lines, at, state = [], 0, entry
            for edit in audit.decode():
                if edit == "D":
                    at += 1
                    continue
                role, then = _NEXT[state][-1]
                if edit == "K" and state == 0 and roles[at].startswith("s"):
                    then = 1
                text, name = "", {U: "user", A: "assistant"}[role]
                if edit != "I":
                    text, name = texts[at], roles[at] if edit == "K" else name
                    at += 1
                lines.append(f"{name}:{text}")
                state = then
            out.append("\n".join(lines) if lines else None)
        return {**{c: cols[c] for c in ("conv_id", "at", "audit")}, "part": out}

    grouped = rows.groupBy(*FRAGMENT).agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("r"))
    grouped = grouped.select(*FRAGMENT, F.col("r.role").alias("roles"), F.col("r.text").alias("texts"))
    return map_slices(grouped.join(chosen, FRAGMENT).drop(*FRAGMENT), run,
                      "conv_id bigint, at bigint, audit string, part string", rows=16)


def repair(rows: DataFrame, kind: Column | None = None, bits: int = FRAGMENT_BITS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, text of every conversation."""
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    lines = placed(damaged(rows, kind), bits)
    sums = written(summaries(fragments(lines)))
    counts, behind = chained(sums)
    found = choices(sums, behind)
    chosen = found.join(walked(found), "at").select(
        *FRAGMENT, "conv_id", "at", "entry", F.get("audits", F.col("entry")).alias("audit"))
    texts = repaired(lines.select(*FRAGMENT, "pos", "role", "text"), chosen)
    # every conversation, its numbers and its fragments meet in one shuffle
    both = texts.unionByName(counts.select("conv_id", *numbers), allowMissingColumns=True).unionByName(
        rows.select("conv_id").distinct(), allowMissingColumns=True)
    fragment = F.when(F.col("at").isNotNull(), F.struct("at", "audit", "part"))
    per = both.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in numbers],
                                      F.array_sort(F.collect_list(fragment)).alias("f"))
    return per.select("conv_id", *numbers, F.array_join("f.audit", "").alias("audit"), F.array_join("f.part", "\n").alias("text"))
