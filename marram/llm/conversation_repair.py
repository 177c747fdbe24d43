"""Conversation structure repair: A* on the edit lattice.

A conversation's rows, in order of turn, and the roles that a repaired one may have
(``(s?(ua)+)?``: nothing, or a system turn at most, then pairs of user and assistant) span a
lattice: a node is how many rows are used up and what has been said last. Edits are its edges:
Keep, Rerole, Delete, Insert. A* takes nodes in order of (cost + heuristic, audit), the audit being
the edits' initials; the heuristic adds up what no path can avoid from here on: the deletion of
blank and duplicate rows, and the charge of truncated ones. It never falls by more than an edge
costs, so a node's first visit is its best, by cost and then by audit.

Rows are dealt in ranges of (conversation, turn, ...), so that a very long conversation lies in
many tasks. What lies whole inside a task is repaired there. Of one that is cut, each segment is
searched from every node that it can be entered by to every node that it can be left by, and the
segments' best paths are composed in order; this loses nothing, for a best path is best between
the nodes that it passes.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.llm.common import lean, quoted, small_batches, stored

#: Fixed values of the contract: costs of edits, and what a truncated row that stays adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

#: What has been said last: nothing, system, user, assistant. From each, the initial that can come next and where it leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
ROLES = {"u": "user", "a": "assistant"}
ENDS = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}

#: Faults of a row, by letter; a row without one has a dash.
BLANK, DUPLICATE, CUT_OFF, SOUND = "b", "d", "t", "-"

#: Rows of a segment, and bytes of its texts, before it is closed.
SEGMENT_ROWS, SEGMENT_BYTES = 1024, 4 << 20

_SPACES = " \t\n\x0b\x0c\r"

Path = tuple[int, str]


def unavoidable(fault: str) -> int:
    """What any path pays for such a row."""
    return {BLANK: DELETE, DUPLICATE: DELETE, CUT_OFF: min(DELETE, TRUNCATED)}.get(fault, 0)


def best_paths(faults: str, initials: list[str], entry: int, ends: tuple[int, ...], first_only: bool) -> dict[int, Path]:
    """The best path (cost, audit) from ``entry`` before the first row to each of ``ends`` after the last, or to the best of them."""
    n = len(faults)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + unavoidable(faults[i])
    heap, closed, found = [(ahead[0], "", 0, entry)], set(), {}
    while heap:
        estimate, audit, i, said = heapq.heappop(heap)
        if (i, said) in closed:
            continue
        closed.add((i, said))
        cost = estimate - ahead[i]
        if i == n and said in ends:
            found[said] = (cost, audit)
            if first_only or len(found) == len(ends):
                break
        initial, then = NEXT[said]
        heapq.heappush(heap, (cost + INSERT + ahead[i], audit + "I", i, then))
        if i == n:
            continue
        rest = cost + ahead[i + 1]
        heapq.heappush(heap, (rest + DELETE, audit + "D", i + 1, said))
        if faults[i] in (BLANK, DUPLICATE):
            continue
        stays = rest + (TRUNCATED if faults[i] == CUT_OFF else 0)
        heapq.heappush(heap, (stays + REROLE, audit + "R", i + 1, then))
        if initials[i] == initial:
            heapq.heappush(heap, (stays + KEEP, audit + "K", i + 1, then))
        elif initials[i] == "s" and said == START:
            heapq.heappush(heap, (stays + KEEP, audit + "K", i + 1, SYSTEM))
    return found


def apply_edits(audit: str, entry: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits; an audit fixes every role, for only one can come next."""
    i, said, new_roles, new_texts = 0, entry, [], []
    for edit in audit:
        if edit != "D":
            initial, then = NEXT[said]
            role, text = (roles[i] if edit == "K" else ROLES[initial]), ("" if edit == "I" else texts[i])
            said = SYSTEM if edit == "K" and said == START and role[0] == "s" else then
            new_roles.append(role)
            new_texts.append(text)
        i += edit != "I"
    return new_roles, new_texts


def compose(left: dict, right: dict) -> dict:
    """Best paths through two runs of segments: (entry, end) -> (cost, audit, the node that each segment ends at)."""
    out = {}
    for (a, m), (c1, w1, e1) in left.items():
        for (b, z), (c2, w2, e2) in right.items():
            if m == b and ((a, z) not in out or (c1 + c2, w1 + w2) < out[a, z][:2]):
                out[a, z] = (c1 + c2, w1 + w2, e1 + e2)
    return out


def compose_all(parts: list[dict]) -> dict:
    """All segments' paths, composed pairwise, so that an audit is copied as often as the logarithm of their number."""
    while len(parts) > 1:
        pairs = [compose(a, b) for a, b in zip(parts[::2], parts[1::2])]
        parts = pairs + parts[len(pairs) * 2 :]
    return parts[0]


COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_SEGMENT = pa.schema(
    [("segment", pa.int64()), ("conv_id", pa.int64()), ("whole", pa.bool_()), ("n_rows", pa.int64())]
    + [("min_turn", pa.int64()), ("max_turn", pa.int64()), ("n_turns", pa.int64()), ("first_initial", pa.string()), ("last_initial", pa.string())]
    + [(c, pa.int64()) for c in COUNTS]
    + [("paths", pa.list_(pa.struct([("entry", pa.int8()), ("end", pa.int8()), ("cost", pa.int64()), ("audit", pa.string())])))]
    + [("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
)
SEGMENTS = (
    "segment long, conv_id long, whole boolean, n_rows long, min_turn long, max_turn long, n_turns long, first_initial string, last_initial string,"
    "blank long, duplicate long, truncated long, illegal long, paths array<struct<entry:byte,end:byte,cost:bigint,audit:string>>, roles array<string>, texts array<string>"
)


class Segment:
    """Rows of one conversation that follow each other in one task."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.faults, self.roles, self.texts, self.bytes, self.turns = conv_id, [], [], [], 0, []

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        self.faults.append(fault)
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(text)
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    @property
    def full(self) -> bool:
        return len(self.faults) >= SEGMENT_ROWS or self.bytes >= SEGMENT_BYTES

    def row(self, number: int, whole: bool) -> dict:
        initials = [r[:1] for r in self.roles]
        faults = "".join(self.faults)
        if whole:
            found = {START: best_paths(faults, initials, START, ENDS, True)}
        else:
            found = {entry: best_paths(faults, initials, entry, (START, SYSTEM, USER, ASSISTANT), False) for entry in (START, SYSTEM, USER, ASSISTANT)}
        return {
            "segment": number, "conv_id": self.conv_id, "whole": whole, "n_rows": len(faults),
            "min_turn": self.turns[0] if self.turns else None, "max_turn": self.turns[-1] if self.turns else None, "n_turns": len(self.turns),
            "first_initial": initials[0] if initials else None, "last_initial": initials[-1] if initials else None,
            "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT_OFF),
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "paths": [{"entry": a, "end": z, "cost": c, "audit": w} for a, ends in found.items() for z, (c, w) in ends.items()],
            "roles": self.roles, "texts": self.texts,
        }


@lean
def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a task's sorted rows. A conversation at either border of the task may go on beyond it, so it is none of the whole ones."""
    from pyspark import TaskContext

    number, now, cut, made, size = TaskContext.get().partitionId() << 32, None, True, [], 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "alive", "turn", "role", "text", "n", "fault")]
        for conv_id, alive, turn, role, text, n, fault in zip(*columns, strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    made.append(now.row(number, not cut))
                    size += now.bytes
                    number, cut = number + 1, False
                now = Segment(conv_id)
            for copy in range(n if alive else 0):
                if now.full:
                    made.append(now.row(number, False))
                    size += now.bytes
                    number, cut, now = number + 1, True, Segment(conv_id)
                now.add(turn, role, text, DUPLICATE if copy and fault != BLANK else fault)
            if len(made) >= 1000 or size >= SEGMENT_BYTES:
                yield pa.RecordBatch.from_pylist(made, _SEGMENT)
                made, size = [], 0
    if now is not None:
        made.append(now.row(number, False))
    if made:
        yield pa.RecordBatch.from_pylist(made, _SEGMENT)


def _ordered(turns: DataFrame, copies: Column) -> DataFrame:
    """Distinct rows with their number of copies and first fault, in ranges of (conversation, turn, role, digest of text)."""
    alive = copies > 0
    if_alive = lambda c: F.when(alive, c)
    rows = turns.select("conv_id", alive.alias("alive"), if_alive(F.col("turn")).alias("turn"), if_alive(F.col("role")).alias("role"), if_alive(F.unhex(F.md5("text"))).alias("digest"), if_alive(F.col("text")).alias("text"), copies.cast("long").alias("n"))
    # Rows that repeat are counted before they are shuffled, so no number of copies is a burden.
    counted = stored(rows.groupBy("conv_id", "alive", "turn", "role", "digest").agg(F.sum("n").alias("n"), F.first("text").alias("text")))
    position = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    said = counted.where("alive").groupBy(F.col("conv_id").alias("of"), F.col("role").alias("of_role"), F.col("digest").alias("of_digest"))
    repeated = said.agg(F.min(position).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    with_first = counted.join(repeated, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("of_role")) & (F.col("digest") == F.col("of_digest")), "left")
    inside = F.btrim("text", F.lit(_SPACES))
    fault = (
        F.when(inside == "", BLANK)
        .when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(position), DUPLICATE)
        .when(~F.substring(inside, -1, 1).isin(".", "!", "?"), CUT_OFF)
        .otherwise(SOUND)
    )
    keys = ["conv_id", "alive", "turn", "role", "digest"]
    marked = with_first.select(*keys, "text", "n", fault.alias("fault"))
    return marked.repartitionByRange(*keys).sortWithinPartitions(*keys)


@lean
def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each segment of the cut conversations, sorted, the node it is entered by and its edits; the first carries the summary."""
    held: list[dict] = []

    def chosen() -> pa.RecordBatch:
        parts = [{(p["entry"], p["end"]): (p["cost"], p["audit"], (p["end"],)) for p in s["paths"]} for s in held]
        whole = compose_all(parts)
        cost, audit, ends = min(whole[START, z] for z in ENDS if (START, z) in whole)
        summary = {c: sum(s[c] for s in held) for c in COUNTS} | {"cost": cost, "audit": audit}
        spoken = [s for s in held if s["n_rows"]]
        summary["illegal"] += sum(a["last_initial"] + b["first_initial"] not in LEGAL for a, b in zip(spoken, spoken[1:]))
        timed = [s for s in held if s["n_turns"]]
        distinct = sum(s["n_turns"] for s in timed) - sum(a["max_turn"] == b["min_turn"] for a, b in zip(timed, timed[1:]))
        summary["gaps"] = timed[-1]["max_turn"] - timed[0]["min_turn"] + 1 - distinct if timed else 0
        rows, entry = [], START
        for k, (s, part, end) in enumerate(zip(held, parts, ends, strict=True)):
            rows.append({"segment": s["segment"], "conv_id": s["conv_id"], "entry": entry, "edits": part[entry, end][1]} | (summary if k == 0 else {}))
            entry = end
        return pa.RecordBatch.from_pylist(rows, _CHOICE)

    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["conv_id"] != row["conv_id"]:
                yield chosen()
                held.clear()
            held.append(row)
    if held:
        yield chosen()


_CHOICE = pa.schema([("segment", pa.int64()), ("conv_id", pa.int64()), ("entry", pa.int8()), ("edits", pa.string()), ("gaps", pa.int64())] + [(c, pa.int64()) for c in COUNTS] + [("cost", pa.int64()), ("audit", pa.string())])
CHOICES = "segment long, conv_id long, entry byte, edits string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


@lean
def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            r["roles"], r["texts"] = apply_edits(r["edits"], r["entry"], r["roles"], r["texts"])
        arrays = [batch.column(c) for c in ("conv_id", "segment", "whole", "edits")]
        yield pa.record_batch([*arrays, pa.array([r["roles"] for r in rows], pa.list_(pa.string())), pa.array([r["texts"] for r in rows], pa.list_(pa.string()))], ["conv_id", "segment", "whole", "edits", "roles", "texts"])


@dataclass
class Repaired:
    """summary: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, one row a conversation.

    pieces: conv_id, segment, whole, edits, roles, texts: the repaired turns, in order of segment; a
    conversation that is ``whole`` has one piece.
    """

    summary: DataFrame
    pieces: DataFrame


def repair(turns: DataFrame, copies: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repaired:
    """Conversations with the cheapest edits that make them well formed.

    copies: how often each row counts (once, unless given); 0 means that the row is not there but
    its conversation is listed all the same. Rows are taken by turn, nulls first, then by role and
    the text's digest; rows that repeat follow each other. A row's first fault counts: blank,
    duplicate (role and text seen earlier), truncated (does not end in one of ``.!?``). Defined
    cases: a null role or text is one space; rows of null id make one conversation; a role of any
    other initial, or without one, cannot be kept; texts are read whole; a conversation without
    rows has an empty audit and no turns; an empty table gives no rows; other columns, whatever
    their names, are ignored.
    """
    space = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(" "))
    many = F.lit(1) if copies is None else copies
    rows = turns.select(quoted(conv_col).cast("long").alias("conv_id"), quoted(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), many.alias("copies"))
    segments = stored(small_batches(_ordered(rows, F.col("copies"))).mapInArrow(_segments, SEGMENTS))
    path, whole = F.col("paths")[0], segments.where("whole")
    gaps = F.when(F.col("n_turns") > 0, F.col("max_turn") - F.col("min_turn") + 1 - F.col("n_turns")).otherwise(0)
    slim = segments.where("NOT whole").drop("roles", "texts", "whole").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    choices = stored(slim.mapInArrow(_choices, CHOICES))
    columns = ["conv_id", gaps.alias("gaps"), *COUNTS, path["cost"].alias("cost"), path["audit"].alias("audit")]
    summary = whole.select(*columns).unionByName(choices.where("cost IS NOT NULL").select("conv_id", "gaps", *COUNTS, "cost", "audit"))
    plan = whole.select("conv_id", "segment", "whole", path["audit"].alias("edits"), F.lit(START).cast("byte").alias("entry"), "roles", "texts")
    cut = segments.where("NOT whole").select("conv_id", "segment", "whole", "roles", "texts").join(choices.select("segment", "edits", "entry"), "segment")
    pieces = plan.unionByName(cut).mapInArrow(_edited, "conv_id long, segment long, whole boolean, edits string, roles array<string>, texts array<string>")
    return Repaired(summary, pieces)


@lean
def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id and the digest of its lines; pieces come in order, and only one is held at a time."""
    now, sha, empty, out = None, hashlib.sha256(), True, []
    for batch in batches:
        for row in batch.to_pylist():
            if now is not None and now[0] != row["conv_id"]:
                out.append((now[0], sha.hexdigest()))
                sha, empty = hashlib.sha256(), True
            now = (row["conv_id"],)
            if row["n"]:
                sha.update((row["lines"] if empty else "\n" + row["lines"]).encode())
                empty = False
    if now is not None:
        out.append((now[0], sha.hexdigest()))
    yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], ["of", "repaired_sha256"])


def digests(repaired: Repaired) -> DataFrame:
    """The contract's columns: the summary, and the hash of the repaired turns' ``role:text`` lines."""
    lines = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit(":"), t["texts"])), "\n")
    pieces = repaired.pieces.select("conv_id", "segment", "whole", F.size("roles").alias("n"), lines.alias("lines"))
    cut = pieces.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(_hashed, "of long, repaired_sha256 string")
    hashes = pieces.where("whole").select(F.col("conv_id").alias("of"), F.sha2("lines", 256).alias("repaired_sha256")).unionByName(cut)
    return repaired.summary.join(hashes, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """The contract's faults, planted by a checksum of id and turn: rows, and how often each is there."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text, role = space("text"), space("role")
    rows = turns.select(
        "conv_id", "turn",
        F.when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code == 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"),
    )
    return rows, F.col("copies")
