"""Conversation structure repair: cheapest edits that make the roles of a conversation an optional system turn and user/assistant pairs.

Edits of a turn: keep it (0), give it the other role (2), delete it (3); a user or assistant turn with an empty text may be
inserted anywhere (2). Blank turns and duplicates must be deleted, and a truncated turn that is not deleted adds 1. Of equally cheap
edits those whose initials (``D``, ``I``, ``K``, ``R``) read together are least in ASCII are taken.

The roles form an automaton of four states, in each of which exactly one of user and assistant may come next. Two
secondary-sorted streams do the work, both repartitioned by conversation:

* ``plan`` goes through the turns from the last to the first, without texts, and carries the cost to go of the four
  states from Arrow batch to Arrow batch. The choice of each state (two bits, so a byte per turn) is a
  backpointer. They leave the task in blocks of ``BLOCK`` turns as rows of a table in the shared folder, so a conversation of
  any length needs one block of memory.
* ``digest`` and ``repaired`` go through the turns from the first to the last, each block sorted before the turns it covers, and follow the
  backpointers: a state, a block and (for ``digest``) an open hash and the audit of one conversation are all they hold.

A hash over a whole conversation is sequential, so the turns of one conversation pass through one task, as a stream; costs of a turn are a table
look-up, since the costs of the states, less their least, take a few values only.

Edge cases. NULL role or text: one space. Turns go by ``turn``, NULLs first, equal ones by role and then by the SHA-256 of role and text. A role's initial is its
first character; a role that is empty or begins with neither s, u nor a can only be changed or deleted. A conversation without turns (all of them
marked ``gone``) gets zeros, an empty audit and the hash of nothing. A NULL ``conv_id`` is a conversation of its own; repeated rows are duplicates;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetlens.llm.tables import TEXT_ROWS, partitions, stored

#: Turns whose backpointers leave a task together.
BLOCK = 1 << 16
#: White space, and marks that end a sentence.
WHITE_SPACE, ENDING = " \t\n\x0b\x0c\r", ".!?"
#: Role initials; any other is number 3. Faults: 0 none, 1 truncated, 2 blank, 3 duplicate.
INITIALS = "sua"
#: States: nothing yet, after s, after u, after a. From each, the state after the next user or assistant turn.
_START, _NEXT, _ROLE_AFTER = 0, (2, 2, 3, 2), (None, None, "user", "assistant")
_DELETE, _INSERT, _KEEP, _REROLE = range(4)
LETTERS = "DIKR"
#: Costs from each state where no turn is left: pairs must be complete.
_END = (0, 4, 2, 0)


def _kept_state(state: int, initial: int) -> int | None:
    """The state after a turn with this role initial, or None if it may not come."""
    if initial == 0:
        return 1 if state == _START else None
    needed = _NEXT[state]
    return needed if initial == needed - 1 else None


class Costs:
    """Steps of the DP from a turn to the one before it, remembered by (costs less the least, kind of turn)."""

    def __init__(self):
        self.known: dict[tuple[int, ...], int] = {}
        self.costs: list[tuple[int, ...]] = []
        self.steps: list[list[tuple[int, int, int] | None]] = []
        self.end = self.number(_END)

    def number(self, costs: tuple[int, ...]) -> int:
        if costs not in self.known:
            self.known[costs] = len(self.costs)
            self.costs.append(costs)
            self.steps.append([None] * 16)
        return self.known[costs]

    def step(self, number: int, kind: int) -> tuple[int, int, int]:
        """Costs before a turn of ``kind`` (4 * fault + initial): their number, what was taken off, and the backpointers."""
        ahead, fault, initial = self.costs[number], kind >> 2, kind & 3
        extra = int(fault == 1)
        choices: list[dict[int, int]] = []
        for state in range(4):
            ways = {_DELETE: 3 + ahead[state]}
            if fault < 2:
                ways[_REROLE] = 2 + extra + ahead[_NEXT[state]]
                kept = _kept_state(state, initial)
                if kept is not None:
                    ways[_KEEP] = extra + ahead[kept]
            choices.append(ways)
        best = [min(w.values()) for w in choices]
        for _ in range(3):
            best = [min(best[s], 2 + best[_NEXT[s]]) for s in range(4)]
        pointers = 0
        for state in range(4):
            ways = {**choices[state], _INSERT: 2 + best[_NEXT[state]]}
            pointers |= min(w for w, c in ways.items() if c == best[state]) << (2 * state)
        least = min(best)
        result = self.number(tuple(c - least for c in best)), least, pointers
        self.steps[number][kind] = result
        return result


class Plan:
    """The DP over one conversation, from its last turn to its first."""

    def __init__(self, costs: Costs):
        self.costs, self.at, self.total = costs, costs.end, 0
        self.pointers = bytearray()
        self.faults = np.zeros(4, np.int64)
        self.illegal, self.after = 0, -1  # the role initial of the turn after
        self.low = self.high = None
        self.turns = 0  # distinct

    def extend(self, kinds: np.ndarray, turns: np.ndarray) -> None:
        """Turns in descending order; ``turns`` without the NULLs."""
        steps, step, at = self.costs.steps, self.costs.step, self.at
        for kind in kinds.tolist():
            at, cost, pointer = steps[at][kind] or step(at, kind)
            self.total += cost
            self.pointers.append(pointer)
        self.at = at
        self.faults += np.bincount(kinds >> 2, minlength=4)
        initials = np.concatenate([[self.after] if self.after >= 0 else [], kinds & 3]).astype(np.int64)
        pair = initials[1:] * 4 + initials[:-1]
        self.illegal += int((~np.isin(pair, (1, 6, 9))).sum())  # su, ua, au
        self.after = int(initials[-1]) if len(initials) else -1
        if len(turns):
            self.turns += int((np.diff(turns) != 0).sum()) + (self.low is None or turns[0] != self.low)
            self.high, self.low = (int(turns[0]) if self.high is None else self.high), int(turns[-1])

    def block(self) -> bytes:
        """Backpointers since the last block, first turn first."""
        out = bytes(reversed(self.pointers))
        self.pointers = bytearray()
        return out

    def head(self) -> dict[str, int]:
        _, truncated, blank, duplicate = map(int, self.faults)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost = self.total + self.costs.costs[self.at][_START]
        return {"gaps": gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": self.illegal, "cost": cost}


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_BLOCK_ROWS = "conv string, head boolean, has_turn boolean, at bigint, role string, key binary, pointers binary, " + ", ".join(f"{c} bigint" for c in COUNTS)


def turns_of(conversations: DataFrame, gone: Column | None = None) -> DataFrame:
    """``conv``, ``has_turn``, ``at``, ``role``, ``text``, ``key`` (hash of role and text) and ``gone`` of every row."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        F.col("conv_id").cast("string").alias("conv"),
        F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("at"),
        role.alias("role"),
        text.alias("text"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("key"),
        (F.lit(False) if gone is None else gone).alias("gone"),
    )


def faults(turns: DataFrame) -> DataFrame:
    """Turns without texts, with ``again`` (role and text seen earlier) and ``kind`` (4 * fault + role initial)."""
    visible = F.rtrim("text", F.lit(WHITE_SPACE))
    light = turns.select(
        "conv", "has_turn", "at", "role", "key", "gone",
        (F.length(visible) == 0).alias("blank"),
        (~F.substring(visible, -1, 1).isin(*ENDING)).alias("truncated"),
    ).repartition(partitions(turns.sparkSession), "conv")
    earlier = Window.partitionBy("conv", "gone", "role", "key").orderBy("has_turn", "at")
    initial = F.coalesce(*[F.when(F.col("role").startswith(c), F.lit(i)) for i, c in enumerate(INITIALS)], F.lit(3))
    again = F.row_number().over(earlier) > 1
    fault = F.when(F.col("blank"), 2).when(F.col("again"), 3).when(F.col("truncated"), 1).otherwise(0)
    return light.withColumn("again", again).withColumn("kind", fault * 4 + initial).drop("blank", "truncated")


def plan(conversations: DataFrame, *, gone: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Blocks of backpointers, stored in the shared folder; the ``head`` block of each conversation has its counts and cost."""
    spark = conversations.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(10 * TEXT_ROWS))
    down = [F.desc_nulls_last(c) for c in ("has_turn", "at", "role", "key", "again")]
    ordered = faults(turns_of(conversations, gone)).sortWithinPartitions("conv", "gone", *down)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        costs, state, conv = Costs(), None, None

        def row(head: bool, first: tuple) -> dict:
            counts = state.head() if head else dict.fromkeys(COUNTS, 0)
            return {"conv": conv, "head": head, **dict(zip(("has_turn", "at", "role", "key"), first)), "pointers": state.block(), **counts}

        for batch in batches:
            out = []
            names = batch["conv"].to_numpy()
            bounds = np.flatnonzero([True, *(a != b for a, b in zip(names[1:], names[:-1]))]) if len(names) else np.zeros(0, int)
            gone_rows, kinds = batch["gone"].to_numpy(bool), batch["kind"].to_numpy(np.int64)
            at, has_turn = batch["at"].to_numpy(np.int64), batch["has_turn"].to_numpy(bool)
            for a, b in zip(bounds, np.append(bounds[1:], len(names))):
                if state is None or names[a] != conv:
                    if state is not None:
                        out.append(row(True, (False, 0, "", b"")))
                    state, conv = Plan(costs), names[a]
                while a < b:
                    # a piece ends where a block is full
                    c = min(b, a + block - len(state.pointers))
                    here = ~gone_rows[a:c]
                    state.extend(kinds[a:c][here], at[a:c][here & has_turn[a:c]])
                    if len(state.pointers) >= block:
                        out.append(row(False, tuple(batch[n].iloc[c - 1] for n in ("has_turn", "at", "role", "key"))))
                    a = c
            if out:
                yield pd.DataFrame(out)
        if state is not None:
            yield pd.DataFrame([row(True, (False, 0, "", b""))])

    return stored(ordered.mapInPandas(run, _BLOCK_ROWS), "repair-plan")


class Replay:
    """Follows the backpointers of one conversation, from its first turn to its last."""

    def __init__(self):
        self.state, self.blocks, self.place = _START, [], 0

    def add(self, pointers: bytes) -> None:
        if pointers:
            self.blocks.append(pointers)

    def turn(self, role: str) -> tuple[list[str], int, str]:
        """Roles inserted before this turn, the edit of the turn and its role after it."""
        pointer = self.blocks[0][self.place]
        self.place += 1
        if self.place == len(self.blocks[0]):
            self.blocks.pop(0)
            self.place = 0
        inserted = []
        while (choice := pointer >> (2 * self.state) & 3) == _INSERT:
            self.state = _NEXT[self.state]
            inserted.append(_ROLE_AFTER[self.state])
        if choice == _KEEP:
            self.state = 1 if role.startswith("s") else _NEXT[self.state]
        elif choice == _REROLE:
            self.state = _NEXT[self.state]
            role = _ROLE_AFTER[self.state]
        return inserted, choice, role

    def end(self) -> list[str]:
        """Roles inserted after the last turn."""
        inserted = []
        while self.state in (1, 2):
            self.state = _NEXT[self.state]
            inserted.append(_ROLE_AFTER[self.state])
        return inserted


def _follow(conversations: DataFrame, plans: DataFrame, gone: Column | None) -> DataFrame:
    """Turns with their texts and blocks of backpointers, by conversation; a block comes before the turns it covers."""
    conversations.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    turns = turns_of(conversations, gone).where(~F.col("gone")).drop("gone")
    # counts as texts: pandas would turn numbers beside NULLs into floats
    rows = plans.select("conv", "has_turn", "at", "role", "key", "pointers", F.when(F.col("head"), 0).otherwise(1).alias("tag"), *[F.col(c).cast("string").alias(c) for c in COUNTS])
    rows = rows.unionByName(turns.withColumn("tag", F.lit(2)), allowMissingColumns=True)
    parts = partitions(conversations.sparkSession)
    # the head has the least place of all: no turn, role "" and key ""
    ordered = rows.repartition(parts, "conv").sortWithinPartitions("conv", "has_turn", "at", "role", "key", "tag")
    return ordered.select("tag", "conv", "role", "text", "pointers", *COUNTS)


def _edits(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """For each batch, its events: ("head", conv, counts), ("edit", letter, role, text) and ("end",), conversation by conversation."""
    replay = None

    def closing() -> Iterator[tuple]:
        if replay is not None:
            yield from (("edit", "I", role, "") for role in replay.end())
            yield ("end",)

    for batch in batches:
        events: list[tuple] = []
        for tag, conv, role, text, pointers, *counts in batch.itertuples(index=False, name=None):
            if tag == 0:
                events += closing()
                replay = Replay()
                replay.add(pointers)
                events.append(("head", conv, tuple(map(int, counts))))
            elif tag == 1:
                replay.add(pointers)
            else:
                inserted, choice, role = replay.turn(role)
                events += [("edit", "I", r, "") for r in inserted]
                events.append(("edit", LETTERS[choice], role, text))
        yield events
    yield list(closing())


def digest(conversations: DataFrame, plans: DataFrame, *, gone: Column | None = None) -> DataFrame:
    """One row per conversation: counts, cost, ``audit`` (the edits' initials) and the SHA-256 of the repaired ``role:text`` lines."""
    kind = conversations.schema["conv_id"].dataType
    fields = StructType.fromDDL("conv string, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, audit, lines, begun, sha = None, bytearray(), [], False, None
        for events in _edits(batches):
            out = []
            for event in events:
                if event[0] == "edit":
                    audit += event[1].encode()
                    if event[1] != "D":
                        lines.append(f"\n{event[2]}:{event[3]}" if begun else f"{event[2]}:{event[3]}")
                        begun = True
                elif event[0] == "head":
                    head, audit, lines, begun, sha = event[1:], bytearray(), [], False, hashlib.sha256()
                else:
                    sha.update("".join(lines).encode())
                    lines = []
                    out.append((head[0], *head[1], audit.decode(), sha.hexdigest()))
            if sha is not None:
                sha.update("".join(lines).encode())
                lines = []
            if out:
                yield pd.DataFrame(out, columns=fields.names)

    found = _follow(conversations, plans, gone).mapInPandas(run, fields)
    return found.select(F.col("conv").cast(kind).alias("conv_id"), *fields.names[1:])


def repaired(conversations: DataFrame, plans: DataFrame, *, gone: Column | None = None) -> DataFrame:
    """The turns after the repair: ``conv_id``, ``place`` (from 0), ``role``, ``text`` and the ``edit`` that gave it."""
    kind = conversations.schema["conv_id"].dataType
    fields = StructType.fromDDL("conv string, place bigint, role string, text string, edit string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, place = None, 0
        for events in _edits(batches):
            out = []
            for event in events:
                if event[0] == "head":
                    conv, place = event[1], 0
                elif event[0] == "edit" and event[1] != "D":
                    out.append((conv, place, event[2], event[3], event[1]))
                    place += 1
            if out:
                yield pd.DataFrame(out, columns=fields.names)

    found = _follow(conversations, plans, gone).mapInPandas(run, fields)
    return found.select(F.col("conv").cast(kind).alias("conv_id"), *fields.names[1:])


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns damaged by the CRC-32 of ``conv_id:turn`` modulo 20 (NULLs: one space), with ``gone`` where a turn was dropped:

    0 drops the turn, 1 empties its text, 2 takes its sentence marks, 3 repeats it, 4 makes it the user's.
    """
    role, text, conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text", "conv_id", "turn"))
    chance = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), chance.alias("_chance"))
    case = F.col("_chance")
    return rows.select(
        "conv_id",
        "turn",
        F.when(case == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(case == 1, "").when(case == 2, F.translate("text", ENDING, "")).otherwise(F.col("text")).alias("text"),
        (case == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(case == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")
