"""Repair of conversation structure: the cheapest edits after which the roles alternate.

Each row is kept, given another role or deleted, and empty turns may be inserted, so that the initials of the roles
read ``(s?(ua)+)?``. A depth-first branch-and-bound search finds the edits; the conversation's rows pass twice through
one sorted partition, first as a few bytes a row, then as texts in a stream, so that no task holds a conversation's texts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equityjobs.llm.shared import lean, stored, text_batches

KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 1, 2, 5, 5
#: What ASCII white space is, and what does not make a text blank.
BLANK, SOLID = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: States of the roles so far: nothing, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the role that must come next, and that role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = ("", "", "user", "assistant")
_FAR = 1 << 60
#: Signatures of short conversations whose edits a task remembers.
_SHORT, _REMEMBERED = 64, 100_000


def _after(state: int, initial: str) -> int:
    """State after a kept turn with this initial, or -1 if it may not come here."""
    if initial == "s":
        return SYSTEM if state == START else -1
    if initial == "u":
        return USER if state != USER else -1
    return ASSISTANT if initial == "a" and state == USER else -1


def _bounds(rows: str) -> array:
    """For each row and state, a lower bound of what the rows from there on cost: the end may be in any state."""
    bounds = array("q", bytes(8 * 4 * (len(rows) + 1)))
    after = {c: [_after(q, c.lower()) for q in range(4)] for c in set(rows)}
    for i in range(len(rows) - 1, -1, -1):
        code, later = rows[i], bounds[4 * i + 4 : 4 * i + 8]
        least = [DELETE_COST + b for b in later]
        if code != "-":
            extra = TRUNCATED_COST * code.isupper()
            for q in range(4):
                kept = later[after[code][q]] + KEEP_COST if after[code][q] >= 0 else _FAR
                least[q] = min(least[q], extra + min(kept, REROLE_COST + later[NEXT[q]]))
        user = min(least[USER], INSERT_COST + least[ASSISTANT])
        bounds[4 * i : 4 * i + 4] = array("q", [
            min(least[START], INSERT_COST + user), min(least[SYSTEM], INSERT_COST + user),
            user, min(least[ASSISTANT], INSERT_COST + least[USER]),
        ])
    return bounds


def _children(rows: str, i: int, q: int, cost: int) -> list[tuple[str, int, int, int]]:
    """(edit, row, state, cost) of what may follow, by edit in ASCII order: delete, insert, keep, rerole."""
    found = []
    code = rows[i] if i < len(rows) else ""
    if code:
        found.append(("D", i + 1, q, cost + DELETE_COST))
    found.append(("I", i, NEXT[q], cost + INSERT_COST))
    if code and code != "-":
        extra = cost + TRUNCATED_COST * code.isupper()
        kept = _after(q, code.lower())
        if kept >= 0:
            found.append(("K", i + 1, kept, extra + KEEP_COST))
        found.append(("R", i + 1, NEXT[q], extra + REROLE_COST))
    return found


def _spelled(node: tuple | None) -> str:
    letters = []
    while node:
        node, letter = node
        letters.append(letter)
    return "".join(reversed(letters))


def _dive(rows: str, bounds: array) -> int:
    """Cost of one repair, found by always following the child of the least bound: the first incumbent's."""
    i, q, cost = 0, START, 0
    while i < len(rows) or q in (SYSTEM, USER):
        _, i, q, cost = min(_children(rows, i, q, cost), key=lambda c: (c[3] + bounds[4 * c[1] + c[2]], -c[1]))
    return cost


def cheapest_edits(rows: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, ties to the ASCII-least audit.

    ``rows`` has one letter a row: its role's initial s, u, a or x (any other), upper case if the row is truncated, or ``-`` if
    it must be deleted. Children are visited in ASCII order, so repairs appear in the order of their audits: of
    prefixes that reach one node (row, state) at one cost, the first has the least audit, since two audits of one node and
    cost have as many inserts, and none is a prefix of the other. Hence the dominance table of a node keeps its least
    cost, and a later prefix goes on only if it is cheaper. Bounds are at most two inserts below the truth, so a node
    is expanded a bounded number of times and the work is linear in the rows.
    """
    bounds = _bounds(rows)
    best = array("q", [_FAR]) * len(bounds)
    most, incumbent = _dive(rows, bounds), None
    stack: list[tuple[int, int, int, tuple | None]] = [(0, START, 0, None)]
    while stack:
        i, q, cost, node = stack.pop()
        if cost >= best[4 * i + q] or cost + bounds[4 * i + q] > most:
            continue
        best[4 * i + q] = cost
        if i == len(rows) and q in (START, ASSISTANT):
            incumbent, most = (cost, node), cost - 1  # a later repair of this cost has a greater audit
            if cost == bounds[START]:
                break
        for edit, j, p, total in reversed(_children(rows, i, q, cost)):
            if total < best[4 * j + p] and total + bounds[4 * j + p] <= most:
                stack.append((j, p, total, (node, edit)))
    return incumbent[0], _spelled(incumbent[1])


def _prepared(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Own column names; a null role or text is one space; ``digest`` tells (role, text) apart."""
    role_col, text_col = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
    named = rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), role_col.alias("role"), text_col.alias("text"))
    return named.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


def _dealt(rows: DataFrame, *first: str) -> DataFrame:
    """Each conversation in one partition, its rows in order: turns (nulls first), then role and digest."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, "turn", "role", "digest")


def fault(text: str) -> Column:
    """``b`` for a text without a character that is not white space, ``t`` where the last such one ends no sentence, else ``o``."""
    ends = F.regexp_extract(text, SOLID + "(?=" + BLANK + r"*\z)", 0)
    return F.when(ends == "", "b").when(ends.isin(".", "!", "?"), "o").otherwise("t")


def _stretches(keys: list) -> Iterator[tuple[object, int, int]]:
    first = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[first]:
            yield keys[first], first, i
            first = i


class _Conversation:
    """What a task holds of one conversation: two letters, a digest and a turn for each row."""

    def __init__(self, key: object) -> None:
        self.key, self.initials, self.faults, self.digests, self.turns = key, [], [], [], []

    def add(self, part: pa.RecordBatch) -> None:
        self.turns.append(part.column(1).drop_null().to_numpy())
        self.initials.append("".join(part.column(2).to_pylist()))
        self.faults.append("".join(part.column(3).to_pylist()))
        self.digests.append(b"".join(part.column(4).to_pylist()))

    def row(self, known: dict[str, tuple[int, str]]) -> tuple:
        """The conversation's counts, cost and audit; ``known`` remembers edits by signature."""
        initials, faults, turns = "".join(self.initials), "".join(self.faults), np.concatenate(self.turns)
        repeated = np.ones(len(faults), bool)
        repeated[np.unique(np.frombuffer(b"".join(self.digests), "V16"), return_index=True)[1]] = False
        kinds = np.frombuffer(faults.encode(), "u1")
        blank, late = kinds == ord("b"), kinds == ord("t")
        duplicate = repeated & ~blank
        truncated = late & ~duplicate
        letters = np.frombuffer(initials.encode(), "u1").copy()
        letters[truncated] -= 32
        letters[blank | duplicate] = ord("-")
        rows = letters.tobytes().decode()
        found = known.get(rows) or cheapest_edits(rows)
        if len(rows) <= _SHORT and len(known) < _REMEMBERED:
            known[rows] = found
        gaps = int(turns.max()) - int(turns.min()) + 1 - len(np.unique(turns)) if len(turns) else 0
        illegal = sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))
        return self.key, gaps, int(blank.sum()), int(duplicate.sum()), int(truncated.sum()), illegal, *found


def repairs(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation that has rows.

    Rows are ordered by turn (nulls first), those of one turn by role and text. A row's first fault counts: blank,
    duplicate (role and text seen before in the conversation) or truncated (its last character that is not white space
    ends no sentence). A null role or text is one space; a role that begins with none of s, u, a must be rerolled or deleted; rows
    with a null id are one conversation; repeated rows are rows of their own; an empty table gives no rows; other columns are
    left out. A task holds about forty bytes a row of one conversation, and no texts.
    """
    prepared = _prepared(rows, conv, turn, role, text)
    kind = prepared.schema["conv_id"].dataType.simpleString()
    initial = F.substring("role", 1, 1)
    narrow = prepared.select("conv_id", "turn", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), fault("text").alias("fault"), "digest", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, str]] = {}
        now, done = None, []
        for batch in batches:
            for key, first, last in _stretches(batch.column(0).to_pylist()):
                if now is None or now.key != key:
                    done += [now.row(known)] if now else []
                    now = _Conversation(key)
                now.add(batch.slice(first, last - first))
            yield table(batch, done)
            done = []
        if now:
            yield table(batch, [now.row(known)])

    def table(batch: pa.RecordBatch, done: list[tuple]) -> pa.RecordBatch:
        kinds = [batch.schema.field(0).type, *[pa.int64()] * 6, pa.string()]
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names)

    counts = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    return _dealt(narrow).mapInArrow(lean(run), f"conv_id {kind}, {counts}, audit string")


def repaired_turns(rows: DataFrame, found: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, position (from 0), role, text of the repaired conversations, each in one partition and in order.

    ``found`` is the stored result of ``repairs(rows)``. A conversation's audit runs ahead of its rows, so texts pass in a stream and
    none is held. Inserted turns have an empty text. Nulls, ties and empty tables are as in ``repairs``.
    """
    text_batches(rows.sparkSession)
    prepared = _prepared(rows, conv, turn, role, text).withColumn("audit", F.lit(None).cast("string"))
    kind = prepared.schema["conv_id"].dataType.simpleString()
    ahead = found.select("conv_id", *[F.lit(None).cast(prepared.schema[c].dataType).alias(c) for c in ("turn", "role", "text", "digest")], "audit")
    both = ahead.unionByName(prepared).withColumn("ahead", F.when(F.col("audit").isNull(), 1).otherwise(0))
    streams = _dealt(both, "ahead").select("conv_id", "role", "text", "audit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, position = "", 0, START, 0
        for batch in batches:
            out: list[tuple] = []
            for key, own_role, own_text, begins in zip(*(c.to_pylist() for c in batch.columns)):
                if begins is not None:
                    audit, at, state, position = begins, 0, START, 0
                else:
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        state = _after(state, own_role[:1])
                    elif edit == "R":
                        state = NEXT[state]
                        own_role = ROLES[state]
                    if edit != "D":
                        out.append((key, position, own_role, own_text))
                        position += 1
                while at < len(audit) and audit[at] == "I":  # inserts stand before the next row, or end the conversation
                    state, at = NEXT[state], at + 1
                    out.append((key, position, ROLES[state], ""))
                    position += 1
            kinds = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["conv_id", "position", "role", "text"])

    return streams.mapInArrow(lean(run), f"conv_id {kind}, position long, role string, text string")


def hashed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of ``repaired_turns``: each turn as ``role:text``, joined by newlines, hashed as they stream by."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for key, position, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if position == 0:
                    done += [(now, digest.hexdigest())] if digest else []
                    now, digest = key, hashlib.sha256()
                digest.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            yield table(batch, done)
        if digest:
            yield table(batch, [(now, digest.hexdigest())])

    def table(batch: pa.RecordBatch, done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], batch.schema.field(0).type), pa.array([r[1] for r in done], pa.string())], ["conv_id", "repaired_sha256"])

    return turns.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair_digest(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each id of ``conversations`` (null too): the counts, the edits and the hash of the repaired conversation.

    Ids without rows have zeros, an empty audit and the hash of the empty string.
    """
    found = stored(repairs(rows), "repairs")
    hashed = hashed_turns(repaired_turns(rows, found))
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    known = ids.join(found, F.col("id").eqNullSafe(found["conv_id"]), "left").drop("conv_id")
    all_rows = known.join(hashed, F.col("id").eqNullSafe(hashed["conv_id"]), "left").drop("conv_id")
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256().hexdigest())
    return all_rows.select(F.col("id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by crc32 of ``conv_id:turn`` modulo 20; nulls are one space.

    0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 sets its role to user.
    """
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    kind = F.crc32(F.concat(part[0], F.lit(":"), part[1])) % 20
    marked = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    texts = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    changed = marked.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), texts.alias("text"), "kind")
    return changed.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")
