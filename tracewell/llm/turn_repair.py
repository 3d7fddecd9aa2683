"""Repair of the order of turns in conversations: the cheapest edits, and of those the least audit.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles: nothing, or an optional system turn and then user
and assistant in turn.  A turn is kept (K, free), given the role user or assistant (R, 3), or deleted (D, 4); an empty
turn of user or assistant is inserted (I, 3).  Blank turns and duplicates must be deleted; a truncated turn that stays
costs 3 more.

1. Costs.  A node is a turn and one of four states: nothing written yet, after a system turn, after a user's, after an
   assistant's.  Costs to the end are found backwards, one turn of all conversations of a batch at a time.
2. Path.  Of a node's optimal arcs, whose letters differ, the least letter leads to the least audit.  Nodes are ranked by
   the first 1, 2, 4, ... letters of their audits: a rank joins those of the node and of the node that many letters
   on, and the pointers are doubled with it.  Ranks that no longer change tell whole audits apart; each different audit of a
   batch is read once, every letter through the doubled pointers.
3. Long conversations.  Turns lie in blocks (see ``blocks``).  A conversation in one block is repaired where it lies.  Of
   one in several blocks each block gives a 4 x 4 table of costs from state to state; a pass backwards over
   these tables gives the costs behind each block, a step on every block its four least paths, and a pass
   forwards follows them.  No task holds more than a block.

Defined results: turns go by turn, nulls first, then role and text; a role whose initial is none of ``s u a`` can only be
changed or deleted; blank, duplicate and truncated exclude each other in that order; a conversation without
turns has zeros, an empty audit and the hash of nothing; a null conversation id is a conversation; an empty table
gives an empty result; other columns play no part.  Texts are equal if their MD5 is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import blocks
from tracewell.llm.tables import crc, written

DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
LETTERS = np.array(["", "D", "I", "K", "R"])
COST_DELETE, COST_INSERT, COST_REROLE, COST_LATE = 4, 3, 3, 3
SPACES = " \t\n\x0b\x0c\r"
#: States: nothing written, after a system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the turn of user or assistant that may follow, and after keeping a turn of role s, u, a or another.
_NEXT = np.array([USER, USER, ASSISTANT, USER])
_KEPT = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1, -1, -1, -1]])
#: Costs behind the last turn: nothing more, or what must be inserted.
_END = np.array([0, 2 * COST_INSERT, COST_INSERT, 0])
_NEVER = 1 << 40
FAULTS = ("blank", "duplicate", "truncated")
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}

_STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = f"conv_id long, {_STATS}"
_REPAIRED = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in ("gaps", *FAULTS, "illegal", "cost")], ("audit", pa.string()),
                       ("repaired_sha256", pa.string())])
BLOCK = (f"conv_id long, part int, block int, result struct<{_STATS.replace(' long', ':long').replace(' string', ':string')}>, "
         "roles array<string>, texts array<string>, initials array<int>, must array<boolean>, late array<boolean>, costs array<long>, "
         "counts array<long>, turns array<long>")
_BLOCK = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("result", pa.struct(list(_REPAIRED)[1:])), ("roles", pa.list_(pa.string())),
    ("texts", pa.list_(pa.string())), ("initials", pa.list_(pa.int32())), ("must", pa.list_(pa.bool_())), ("late", pa.list_(pa.bool_())),
    ("costs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("turns", pa.list_(pa.int64()))])


class Paths:
    """Costs and least optimal paths over runs of turns; ``first[i]`` to ``first[i + 1]`` are the turns of run i.

    ``ends`` has for every run the costs behind it in each state.
    """

    def __init__(self, first: np.ndarray, initial: np.ndarray, must: np.ndarray, late: np.ndarray, ends: np.ndarray, last: bool):
        self.first, count = first, len(first) - 1
        length = np.diff(first)
        at = np.repeat(np.arange(count), length)
        self.node = np.arange(len(initial)) + at  # a run has one node more than turns
        self.begin = first[:-1] + np.arange(count)
        end = self.begin + length
        self.cost = np.zeros((len(initial) + count, 4), np.int64)
        self.cost[end] = ends
        kept = _KEPT[initial]  # state behind a kept turn, by state before it
        stays = np.where(late, COST_LATE, 0)[:, None]
        free = ~must[:, None]
        order = np.argsort(-length, kind="stable")
        sizes = length[order]
        for step in range(1, int(length.max(initial=0)) + 1):
            runs = order[:np.searchsorted(-sizes, -step, "right")]
            row = first[runs] + length[runs] - step
            arcs = self._arcs(self.cost[self.node[row] + 1], kept[row], stays[row], free[row])
            base = np.minimum(np.minimum(arcs[0], arcs[1]), arcs[2])
            self.cost[self.node[row]] = np.minimum(base, np.minimum(COST_INSERT + base[:, _NEXT], 2 * COST_INSERT + base[:, _NEXT[_NEXT]]))
        own = self.cost[self.node]
        delete, keep, rerole = self._arcs(self.cost[self.node + 1], kept, stays, free)
        insert = COST_INSERT + own[:, _NEXT]
        letter = np.zeros(self.cost.shape, np.int64)
        letter[self.node] = np.select([own == delete, own == insert, own == keep], [DELETE, INSERT, KEEP], REROLE)
        state = np.select([own == delete, own == insert, own == keep], [np.arange(4)[None, :], _NEXT[None, :], kept], _NEXT[None, :])
        ahead = np.where(letter[self.node] == INSERT, self.node[:, None], self.node[:, None] + 1)
        successor = np.arange(self.cost.size).reshape(-1, 4)
        successor[self.node] = 4 * ahead + np.maximum(state, 0)
        if last:
            # behind the last turn what is missing is inserted
            for missing in (SYSTEM, USER):
                letter[end, missing] = INSERT
                successor[end, missing] = 4 * end + _NEXT[missing]
        self._double(letter.ravel(), successor.ravel())

    @staticmethod
    def _arcs(ahead: np.ndarray, kept: np.ndarray, stays: np.ndarray, free: np.ndarray):
        keep = np.where(free & (kept >= 0), stays + np.take_along_axis(ahead, np.maximum(kept, 0), 1), _NEVER)
        return COST_DELETE + ahead, keep, np.where(free, COST_REROLE + stays + ahead[:, _NEXT], _NEVER)

    def _double(self, letter: np.ndarray, successor: np.ndarray) -> None:
        self.letter, self.jumps, self.rank = letter, [successor], letter
        self.steps = (letter > 0).astype(np.int64)
        while True:
            jump = self.jumps[-1]
            # letters up to twice as far: the node's and those of the node behind them
            self.rank = np.unique(self.rank * (int(self.rank.max(initial=0)) + 1) + self.rank[jump], return_inverse=True)[1]
            self.steps = self.steps + self.steps[jump]
            farther = jump[jump]
            if (farther == jump).all():
                return
            self.jumps.append(farther)

    def audits(self, starts: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The least audit from each start node (``4 * node + state``), and the node where it ends."""
        _, one, which = np.unique(self.rank[starts], return_index=True, return_inverse=True)
        size = self.steps[starts[one]]
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(starts[one], size)
        for k, jump in enumerate(self.jumps):
            far = place >> k & 1 == 1
            at[far] = jump[at[far]]
        letters = LETTERS[self.letter[at]].tolist()
        ends = np.cumsum(size).tolist()
        texts = ["".join(letters[e - int(s):e]) for e, s in zip(ends, size)]
        return [texts[w] for w in which.ravel()], self.jumps[-1][starts]


def edited(audit: str, roles: list[str], texts: list[str], state: int) -> Iterator[str]:
    """``role:text`` of the turns that an audit leaves, from a state on."""
    row = 0
    for letter in audit:
        if letter == "D":
            row += 1
            continue
        fitting = "assistant" if state == USER else "user"
        if letter == "I":
            yield f"{fitting}:"
        else:
            yield f"{roles[row] if letter == 'K' else fitting}:{texts[row]}"
        state = SYSTEM if letter == "K" and roles[row][:1] == "s" else int(_NEXT[state])
        row += letter != "I"


def _judged(rows: Iterator[dict]) -> Iterator[dict]:
    """Rows with their first fault: ``fault`` 1 blank, 2 duplicate, 3 truncated, else 0."""
    before = None
    for row in rows:
        if row["missing"]:
            yield {**row, "fault": 0}
            continue
        own = (row["conv_id"], row["turn"], row["role"], row["text"])
        shown = row["text"].strip(SPACES)
        fault = 1 if not shown else 2 if row["again"] or own == before else 3 if shown[-1] not in ".!?" else 0
        before = own
        yield {**row, "fault": fault}


class _Facts:
    """Counts of a conversation's turns in order; blocks of it are added one after the other."""

    def __init__(self) -> None:
        self.faults, self.illegal, self.different = [0, 0, 0], 0, 0
        self.first = self.last = self.role = None

    def turns(self, rows: list[dict]) -> None:
        for row in rows:
            if row["fault"]:
                self.faults[row["fault"] - 1] += 1
            initial = row["role"][:1]
            self.illegal += self.role is not None and (self.role, initial) not in _LEGAL
            self.role = initial
            if row["turn"] is not None:
                self.different += row["turn"] != self.last
                self.first = row["turn"] if self.first is None else self.first
                self.last = row["turn"]

    def row(self, key, cost: int, audit: str, digest: str) -> dict:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.different
        return {"conv_id": key, "gaps": gaps, **dict(zip(FAULTS, self.faults)), "illegal": self.illegal, "cost": cost, "audit": audit,
                "repaired_sha256": digest}


def _arrays(runs: list[list[dict]]):
    rows = [r for run in runs for r in run]
    first = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64)
    initial = np.array(["sua".find(r["role"][:1]) if r["role"] else -1 for r in rows], np.int64) % 4
    fault = np.array([r["fault"] for r in rows], np.int64)
    return first, initial, (fault == 1) | (fault == 2), fault == 3


def _repaired(found: list[tuple[object, list[dict]]]) -> list[dict]:
    """Result rows of conversations that lie in one block."""
    runs = [rows for _, rows in found]
    first, initial, must, late = _arrays(runs)
    paths = Paths(first, initial, must, late, np.tile(_END, (len(runs), 1)), True)
    audits, _ = paths.audits(4 * paths.begin)
    out = []
    for (key, rows), audit, cost in zip(found, audits, paths.cost[paths.begin, START].tolist()):
        facts = _Facts()
        facts.turns(rows)
        text = "\n".join(edited(audit, [r["role"] for r in rows], [r["text"] for r in rows], START))
        out.append(facts.row(key, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, whole, size = TaskContext.get().partitionId(), [], 0
    empty = dict.fromkeys(_BLOCK.names)

    def results() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{**empty, "conv_id": r.pop("conv_id"), "part": part, "block": 0, "result": r} for r in _repaired(whole)], _BLOCK)

    for key, number, complete, rows in blocks.cut(_judged(blocks.rows_of(batches)), lambda r: len(r["text"])):
        rows = [r for r in rows if not r["missing"]]
        if complete:
            whole.append((key, rows))
            size += len(rows)
            if size >= 2 * blocks.ROWS or len(whole) >= 2 * blocks.ROWS:
                yield results()
                whole, size = [], 0
            continue
        first, initial, must, late = _arrays([rows])
        costs = []
        for state in range(4):
            ends = np.full((1, 4), _NEVER)
            ends[0, state] = 0
            costs.append(Paths(first, initial, must, late, ends, False).cost[0])
        turns = [r["turn"] for r in rows]
        yield pa.RecordBatch.from_pylist([{
            "conv_id": key, "part": part, "block": number, "result": None, "roles": [r["role"] for r in rows], "texts": [r["text"] for r in rows],
            "initials": initial.tolist(), "must": must.tolist(), "late": late.tolist(), "costs": np.array(costs).ravel().tolist(),
            "counts": [r["fault"] for r in rows], "turns": turns}], _BLOCK)
    if whole:
        yield results()


BEHIND = "part int, block int, behind array<long>, last boolean"


def _behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs behind each block; blocks come from the last to the first."""
    key, cost = blocks._NONE, _END
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            last = key is blocks._NONE or row["conv_id"] != key
            key, cost = row["conv_id"], _END if last else cost
            out.append({"part": row["part"], "block": row["block"], "behind": cost.tolist(), "last": last})
            # costs[end][begin]: from a state before the block to one behind it
            cost = (np.array(row["costs"]).reshape(4, 4) + cost[:, None]).min(0)
        yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.int32()), ("block", pa.int32()), ("behind", pa.list_(pa.int64())), ("last", pa.bool_())]))


PATHS = "conv_id long, part int, block int, roles array<string>, texts array<string>, counts array<long>, turns array<long>, audits array<string>, exits array<int>, cost long"
_PATHS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
                    ("counts", pa.list_(pa.int64())), ("turns", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int32())),
                    ("cost", pa.int64())])


def _through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least path through a block from each of the four states."""
    for row in blocks.rows_of(batches):
        paths = Paths(np.array([0, len(row["roles"])]), np.array(row["initials"], np.int64), np.array(row["must"], bool), np.array(row["late"], bool),
                      np.array([row["behind"]]), row["last"])
        audits, ends = paths.audits(np.arange(4))
        kept = {c: row[c] for c in ("conv_id", "part", "block", "roles", "texts", "counts", "turns")}
        yield pa.RecordBatch.from_pylist([{**kept, "audits": audits, "exits": (ends % 4).tolist(), "cost": int(paths.cost[0, START])}], _PATHS)


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its blocks in order."""
    for key, run in blocks.grouped(blocks.rows_of(batches)):
        facts, audit, digest, state, cost, begun = _Facts(), [], hashlib.sha256(), START, None, False
        for block in run:
            cost = block["cost"] if cost is None else cost
            facts.turns([{"role": r, "turn": t, "fault": f} for r, t, f in zip(block["roles"], block["turns"], block["counts"])])
            audit.append(block["audits"][state])
            for line in edited(audit[-1], block["roles"], block["texts"], state):
                digest.update(("\n" * begun + line).encode())
                begun = True
            state = block["exits"][state]
        yield pa.RecordBatch.from_pylist([facts.row(key, cost, "".join(audit), digest.hexdigest())], _REPAIRED)


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``conv_id, turn, role, text, missing``: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``.

    Rows that are ``missing`` only name their conversation.  ``gaps`` is the number of turns between the first and the last
    that do not occur; ``illegal`` counts neighbours whose roles may not follow each other.
    """
    rows = turns.select("conv_id", "turn", "role", "text", "missing", F.md5("text").alias("digest"))
    order = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    seen = rows.filter(~F.col("missing")).groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(
        F.min(order).alias("earliest"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    known = rows.join(seen, same, "left").select(
        "conv_id", "turn", "role", "text", "missing", F.coalesce(order > F.col("earliest"), F.lit(False)).alias("again"))
    found = written(blocks.dealt(known, "text").mapInArrow(_blocks, BLOCK), "turn_blocks")
    whole = found.filter("result is not null").select("conv_id", "result.*")
    split = found.filter("result is null").drop("result")
    narrow = split.select("conv_id", "part", "block", "costs")
    behind = narrow.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("block")).mapInArrow(_behind, BEHIND)
    paths = split.join(behind, ["part", "block"]).select(*split.columns, "behind", "last").mapInArrow(_through, PATHS)
    return whole.union(blocks.in_order(paths).mapInArrow(_followed, REPAIRED))


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns damaged by a hash of conversation and turn, for ``repair``: dropped, emptied, without full stops, repeated, or all the user's."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    act = crc(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), act.alias("act"))
    text = F.when(F.col("act").isin(0, 1), "").when(F.col("act") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("act") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select(
        "conv_id", "turn", F.when(F.col("act") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("act") == 0).alias("missing"), times.alias("time")).drop("time")
