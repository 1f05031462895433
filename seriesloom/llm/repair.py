"""Cheapest repair of a conversation's roles, with Four-Russians block tables.

Every row is one of nine symbols: rows that must go, and four kinds of role, truncated or not. A vector holds, for each
state of the role automaton, the cost of mending all rows from here to the end; less its least entry, only a few dozen
vectors exist. A table gives, for every vector and every block of ``BLOCK`` symbols, the vector in front of the block, so
a conversation is one look-up a block from its end to its start. Blocks are then expanded backward from the vectors found
and walked forward, each time by the first letter in ASCII order that keeps to the least cost. Longer conversations are
cut into chunks: a chunk maps vectors to vectors and states to states, and these maps are chained.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from seriesloom.functions.lanes import Lanes, lay_out, small
from seriesloom.lineage import pin
from seriesloom.llm.common import attach
from seriesloom.llm.streams import folded, sha256_of

CHUNK = 1024                     # rows of a conversation that are solved together
BLOCK = 4                        # symbols of a table block
KEY = ["_none", "_id"]           # a conversation: whether it has no id, and the id
SPACE = " \t\n\x0b\x0c\r"

START, SYSTEM, USER, ASSISTANT = range(4)                       # states: nothing yet, or the role last given
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5                  # fixed values: costs
GIVEN = (USER, USER, ASSISTANT, USER)                           # the role that an inserted or reroled row gets, by state
KEPT = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})    # by initial s, u, a, other
GONE, PAD = 0, 9                                                # symbols: must be deleted; nothing; between them 1 + 2 * initial + truncated
END = (0, INSERT + INSERT, INSERT, 0)                           # cost of ending in each state
LETTER = {USER: "u", ASSISTANT: "a"}


def _before(cost: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """The vector in front of a symbol, given the one behind it."""
    if symbol == PAD:
        return cost
    out = [DELETE + c for c in cost]
    if symbol != GONE:
        initial, late = divmod(symbol - 1, 2)
        for state in range(4):
            out[state] = min(out[state], REROLE + TRUNCATED * late + cost[GIVEN[state]])
            if state in KEPT[initial]:
                out[state] = min(out[state], TRUNCATED * late + cost[KEPT[initial][state]])
    for _ in range(3):
        out = [min(c, INSERT + out[GIVEN[state]]) for state, c in enumerate(out)]
    return tuple(out)


class Tables:
    """All vectors that occur (0 is the one at the end) and, per vector and block, the vector in front."""

    def __init__(self):
        self.vectors, ids = [END], {END: 0}
        single = []
        for vector in self.vectors:                              # grows while it is read
            row = []
            for symbol in range(10):
                cost = _before(vector, symbol)
                cost = tuple(c - min(cost) for c in cost)
                if cost not in ids:
                    ids[cost] = len(self.vectors)
                    self.vectors.append(cost)
                row.append(ids[cost])
            single.append(row)
        one = np.array(single, np.int32)
        block = np.arange(10 ** BLOCK)
        self.front = np.repeat(np.arange(len(one), dtype=np.int32)[:, None], len(block), axis=1)
        for place in range(BLOCK):
            self.front = one[self.front, block // 10 ** place % 10]
        self.walked: dict[tuple[int, int, int], tuple[str, list[str], int, int]] = {}

    def blocks(self, symbols: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Block numbers of all strings end to end, and where each string's begin."""
        n = np.array([-(-len(s) // BLOCK) for s in symbols], np.int64)
        flat = "".join(s.ljust(BLOCK * k, str(PAD)) for s, k in zip(symbols, n.tolist()))
        digits = (np.frombuffer(flat.encode(), np.uint8) - ord("0")).reshape(-1, BLOCK)
        return digits @ 10 ** np.arange(BLOCK - 1, -1, -1), np.append(0, np.cumsum(n))

    def backward(self, block: np.ndarray, at: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector in front of each string, vector behind each block), from the vectors behind the strings."""
        behind, now, n = np.zeros(len(block), np.int32), right.astype(np.int32).copy(), np.diff(at)
        order = np.argsort(-n, kind="stable")
        live = np.searchsorted(-n[order], -np.arange(int(n.max(initial=0))), side="left")    # strings with more than k blocks
        for k, m in enumerate(live.tolist()):
            here = order[:m]
            spot = at[here + 1] - 1 - k
            behind[spot] = now[here]
            now[here] = self.front[now[here], block[spot]]
        return now, behind

    def walk(self, block: int, behind: int, state: int) -> tuple[str, list[str], int, int]:
        """(letters, an edit per symbol, state behind, cost) of the block's least walk from ``state``.

        An edit is the initials of rows inserted before and then D, K, or the role given anew: U or A."""
        known = self.walked.get((block, behind, state))
        if known:
            return known
        symbols = [s for s in map(int, str(block).zfill(BLOCK)) if s != PAD]
        cost = [self.vectors[behind]]
        for symbol in reversed(symbols):
            cost.append(_before(cost[-1], symbol))
        cost.reverse()
        letters, edits, to, paid = "", [], state, 0
        for i, symbol in enumerate(symbols):
            initial, late = divmod(symbol - 1, 2) if symbol != GONE else (3, 0)
            inserted = ""
            while True:
                if DELETE + cost[i + 1][to] == cost[i][to]:
                    letter, edit, paid = "D", "D", paid + DELETE
                elif INSERT + cost[i][GIVEN[to]] == cost[i][to]:
                    to, letters, paid = GIVEN[to], letters + "I", paid + INSERT
                    inserted += LETTER[to]
                    continue
                elif to in KEPT[initial] and TRUNCATED * late + cost[i + 1][KEPT[initial][to]] == cost[i][to]:
                    letter, edit, to, paid = "K", "K", KEPT[initial][to], paid + TRUNCATED * late
                else:
                    to = GIVEN[to]
                    letter, edit, paid = "R", LETTER[to].upper(), paid + REROLE + TRUNCATED * late
                break
            letters += letter
            edits.append(inserted + edit)
        self.walked[block, behind, state] = letters, edits, to, paid
        return self.walked[block, behind, state]


@cache
def tables() -> Tables:
    return Tables()


SOLVED = (StructType().add("audit", StringType()).add("cost", LongType()).add("edits", ArrayType(StringType())).add("tail", StringType()))


@F.pandas_udf(SOLVED)
def _solve(symbols: pd.Series, right: pd.Series, entry: pd.Series, last: pd.Series) -> pd.DataFrame:
    """Edits of a chunk entered in state ``entry`` with vector ``right`` behind it; ``tail`` is inserted after the last one."""
    known = tables()
    block, at = known.blocks(symbols.tolist())
    _, behind = known.backward(block, at, right.to_numpy())
    block, behind, bounds, out = block.tolist(), behind.tolist(), at.tolist(), []
    for k, (state, final) in enumerate(zip(entry.tolist(), last.tolist())):
        audit, edits, cost = [], [], 0
        for i in range(bounds[k], bounds[k + 1]):
            letters, steps, state, paid = known.walk(block[i], behind[i], state)
            audit.append(letters)
            edits += steps
            cost += paid
        tail = ("", "ua", "a", "")[state] if final else ""
        out.append(("".join(audit) + "I" * len(tail), cost + INSERT * len(tail), edits, tail))
    return pd.DataFrame(out, columns=["audit", "cost", "edits", "tail"])


@F.pandas_udf(ArrayType(IntegerType()))
def _vector_map(symbols: pd.Series) -> pd.Series:
    """For every vector behind a chunk the one in front of it."""
    known = tables()
    block, at = known.blocks(symbols.tolist())
    fronts = [known.backward(block, at, np.full(len(symbols), v))[0] for v in range(len(known.vectors))]
    return pd.Series(list(np.stack(fronts, axis=1)))


@F.pandas_udf(ArrayType(IntegerType()))
def _state_map(symbols: pd.Series, right: pd.Series) -> pd.Series:
    """For every state in front of a chunk the one behind it."""
    known = tables()
    block, at = known.blocks(symbols.tolist())
    _, behind = known.backward(block, at, right.to_numpy())
    out = []
    for k in range(len(symbols)):
        states = list(range(4))
        for i in range(at[k], at[k + 1]):
            states = [known.walk(int(block[i]), int(behind[i]), s)[2] for s in states]
        out.append(states)
    return pd.Series(out)


def damage(conversations: DataFrame) -> DataFrame:
    """(_none, _id, turn, role, text, _copy): one row in 20 each is dropped, emptied, unpunctuated, repeated, made the user's.

    The CRC-32 of ``conv_id:turn`` decides; nulls in any column count as one space."""
    def spaced(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate, text = F.col("_fate"), F.col("text")
    rows = conversations.select(
        F.col("conv_id").isNull().alias("_none"), F.coalesce("conv_id", F.lit(0)).cast("long").alias("_id"), "turn", spaced("role").alias("role"),
        spaced("text").alias("text"), (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20).alias("_fate"))
    return (rows.where("_fate <> 0")
            .withColumn("text", F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text))
            .withColumn("role", F.when(fate == 4, "user").otherwise(F.col("role")))
            .withColumn("_copy", F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_fate"))


def _seen(lanes: Lanes) -> DataFrame:
    """The laid-out rows with ``_again``: role and text occurred earlier in the conversation."""
    df = lanes.df.withColumn("_said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    by = [*KEY, "_said"]
    if not lanes.split:
        return df.withColumn("_again", F.row_number().over(Window.partitionBy(*by).orderBy("step")) > 1)
    firsts = pin(df.groupBy(*by).agg(F.min("step").alias("_first"), F.count("*").alias("_times")))
    return attach(df, firsts, by, "_times", df.count()).withColumn("_again", F.col("step") > F.col("_first"))


def chunks(conversations: DataFrame) -> tuple[DataFrame, int]:
    """One row per ``CHUNK`` rows of a damaged conversation: symbols, rows, counts of faults; and a bound of a conversation's rows."""
    lanes = lay_out(damage(conversations), KEY, ["turn", "role", "text", "_copy"], reach=1)
    lanes.df = _seen(lanes)
    initial, text = F.substring("role", 1, 1), F.col("text")
    before, turn_before = F.lag(initial).over(lanes.window), F.lag("turn").over(lanes.window)
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    repeated = ~blank & F.col("_again")
    late = ~blank & ~F.col("_again") & ~F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1)).isin(".", "!", "?")
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    symbol = F.when(blank | repeated, str(GONE)).otherwise((1 + 2 * kind + late.cast("int")).cast("string"))
    marked = lanes.done(lanes.df.select(
        "*", symbol.alias("_symbol"), blank.alias("_blank"), repeated.alias("_duplicate"), late.alias("_late"),
        (before.isNotNull() & ~F.concat(before, initial).isin("su", "ua", "au")).alias("_illegal"),
        (F.col("turn").isNotNull() & ~turn_before.eqNullSafe(F.col("turn"))).alias("_new")))
    grouped = marked.groupBy(*KEY, F.floor(F.col("step") / CHUNK).alias("_chunk")).agg(
        F.sort_array(F.collect_list(F.struct("step", F.col("_symbol").alias("symbol"), "role", "text"))).alias("rows"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_if("_new").alias("turns"), F.count_if("_blank").alias("blank"),
        F.count_if("_duplicate").alias("duplicate"), F.count_if("_late").alias("truncated"), F.count_if("_illegal").alias("illegal"))
    return grouped.withColumn("symbols", F.array_join("rows.symbol", "")), lanes.longest


def _mended(parts: DataFrame) -> DataFrame:
    """Chunks with ``right``, ``entry`` and ``last`` become audit, cost and ``body``: the mended lines, null if there are none."""
    def lines(initials):
        return F.replace(F.replace(initials, F.lit("u"), F.lit("user:\n")), F.lit("a"), F.lit("assistant:\n"))

    def line(row, edit):
        act = F.right(edit, F.lit(1))
        role = F.when(act == "K", row["role"]).when(act == "U", F.lit("user")).when(act == "A", F.lit("assistant"))
        return F.concat(lines(F.substr(edit, F.lit(1), F.length(edit) - 1)),
                        F.coalesce(F.concat(role, F.lit(":"), row["text"], F.lit("\n")), F.lit("")))

    solved = parts.withColumn("_s", _solve("symbols", "right", "entry", "last")).select("*", "_s.*").drop("_s", "symbols")
    body = F.concat(F.array_join(F.zip_with("rows", "edits", line), ""), lines(F.col("tail")))
    return (solved.withColumn("body", body).withColumn("body", F.when(F.length("body") > 0, F.substr("body", F.lit(1), F.length("body") - 1)))
            .drop("rows", "edits", "tail"))


def _long(parts: DataFrame) -> DataFrame:
    """Conversations of several chunks (``top`` is the last one's number): chained maps, then one row each as in ``repair``."""
    back = parts.select(*KEY, "_chunk", _vector_map("symbols").alias("map"))
    right = folded(back, KEY, F.col("_chunk").desc(), "map", "right int", lambda: 0, lambda v, m: m[v], None)
    parts = pin(parts.join(right, [*KEY, "_chunk"]))
    ahead = parts.select(*KEY, "_chunk", _state_map("symbols", "right").alias("map"))
    entry = folded(ahead, KEY, "_chunk", "map", "entry int", lambda: START, lambda s, m: m[s], None)
    solved = pin(_mended(parts.join(entry, [*KEY, "_chunk"]).withColumn("last", F.col("_chunk") == F.col("top"))))
    audits = F.sort_array(F.collect_list(F.struct("_chunk", "audit")))
    sums = solved.groupBy(*KEY).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.array_join(audits["audit"], "").alias("audit"),
                                    *(F.sum(c).alias(c) for c in ("turns", "blank", "duplicate", "truncated", "illegal", "cost")))
    return sums.join(sha256_of(solved.select(*KEY, "_chunk", "body"), KEY, "_chunk", "body", "\n", "repaired_sha256"), KEY)


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``conversations`` needs conv_id (long), turn (integer), role and text; other columns, whatever their names, are not
    read. Rows are damaged first (``damage``) and then taken by turn, nulls first; rows of one turn by role and text,
    copies side by side. A role is known by its first letter; any other, also an empty one, can only be reroled or deleted.
    Rows without a conv_id are one conversation. One that loses all its rows has zeros, an empty audit and the hash of the
    empty text. An empty table gives an empty result. Texts stay in the JVM; Python sees one symbol a row. A conversation
    of any length is cut: rows into lanes, symbols into chunks of ``CHUNK``, the mended text into a hashed stream; its
    audit is one value.
    """
    parts, longest = chunks(conversations)
    names = ["low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def whole(frame: DataFrame) -> DataFrame:
        at_once = _mended(frame.withColumns({"right": F.lit(0), "entry": F.lit(START), "last": F.lit(True)}))
        return at_once.select(*KEY, *names[:-1], F.sha2(F.coalesce("body", F.lit("")).cast("binary"), 256).alias("repaired_sha256"))

    if longest <= CHUNK:
        done = whole(parts)
    else:
        parts = pin(parts)
        tops = pin(parts.groupBy(*KEY).agg(F.max("_chunk").alias("top")).where("top > 0"))
        n = tops.count()
        done = whole(parts.join(small(tops, n), KEY, "left_anti")).unionByName(_long(parts.join(small(tops, n), KEY)).select(*KEY, *names))
    every = conversations.select(F.col("conv_id").isNull().alias("_none"), F.coalesce("conv_id", F.lit(0)).cast("long").alias("_id")).distinct()
    zero = F.lit(0).cast("long")
    return every.join(done, KEY, "left").select(
        F.when(~F.col("_none"), F.col("_id")).alias("conv_id"), F.coalesce(F.col("high").cast("long") - F.col("low") + 1 - F.col("turns"), zero).alias("gaps"),
        *(F.coalesce(c, zero).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))
