"""Structure repair of conversations: cheapest edits by a cost DP, the least audit among them by prefix-doubling path ranking.

A conversation is right if the initials of its roles read (s?(ua)+)?. Rows are kept, given another role or deleted, and empty
turns inserted. A node is a place between rows with a state of that expression; the DP gives every node its cost to the end,
and arcs that lose nothing are optimal. Nodes are ranked by the least audit of 1, 2, 4, ... edits that starts there: a
node's rank and that of the node its pointer leads to, ranked as pairs, cover twice the length, and doubled pointers lead
twice as far. Ranks then select the arcs of the least path, which is read off through the doubled pointers. All this
runs on the whole arrays of a run of conversations.

Rows are dealt by ranges of (conversation, turn), so a conversation of any length lies in consecutive partitions, and only the
first and the last one of a partition can go on in another. These are solved for every state they may begin and end in; the
small tables of costs and audits are put together in order, and the edits found go back to the rows' partitions. Texts
leave in pieces of bounded size, so no conversation is ever held whole but its audit, which is one value of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

BLANKS = " \t\n\x0b\x0c\r"
PIECE_CHARS = 1 << 20
LABELS = b"DIKR"  # delete, insert, keep, rerole: in the order of their signs
DELETE, INSERT, KEEP, REROLE = range(4)
EMPTY, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, after s, after u, after a
INITIALS = "sua"  # codes 0, 1, 2; 3 is any other
ENDS = (EMPTY, ASSISTANT)
_FOLLOWS = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])  # state, initial
_GIVEN = np.array([USER, USER, ASSISTANT, USER])  # the state after a turn with the role that a state asks for
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True
_FAR = 1 << 60


@dataclass(frozen=True)
class EditCosts:
    """Costs of edits; `insert` must be above 0, so that no audit is the beginning of another of the same cost."""

    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5  # for every truncated row that stays


@dataclass
class Run:
    """Rows of consecutive (parts of) conversations; `starts` has one more value than there are conversations."""

    initial: np.ndarray
    must: np.ndarray
    cut: np.ndarray
    starts: np.ndarray


def costs_to_end(run: Run, ends: tuple[int, ...], costs: EditCosts) -> np.ndarray:
    """(places, 4): the least cost from every place and state to one of the `ends` of its conversation; rows + 1 places each."""
    out = np.empty((len(run.initial) + len(run.starts) - 1, 4), np.int64)
    initial, must, cut = run.initial.tolist(), run.must.tolist(), run.cut.tolist()
    for c in range(len(run.starts) - 1):
        first, last = int(run.starts[c]), int(run.starts[c + 1])
        place = last + c
        e, s, u, a = (0 if state in ends else _FAR for state in range(4))
        held = []
        for i in range(last, first - 1, -1):
            if i < last:
                user, assistant, system = u, a, s
                e, s, u, a = e + costs.delete, s + costs.delete, u + costs.delete, a + costs.delete
                if not must[i]:
                    extra = costs.truncated if cut[i] else 0
                    kept, given = costs.keep + extra, costs.rerole + extra
                    to_user = user + (min(kept, given) if initial[i] == 1 else given)
                    to_assistant = assistant + (min(kept, given) if initial[i] == 2 else given)
                    e, s, u, a = min(e, to_user), min(s, to_user), min(u, to_assistant), min(a, to_user)
                    if initial[i] == 0:
                        e = min(e, system + kept)
            u, a = min(u, a + costs.insert), min(a, u + costs.insert)
            e, s = min(e, u + costs.insert), min(s, u + costs.insert)
            held.append((e, s, u, a))
        out[first + c : place + 1] = held[::-1]
    return out


def optimal_arcs(run: Run, cost: np.ndarray, costs: EditCosts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, label, next node) of every edit that loses nothing; node is place * 4 + state. No node has two of one label."""
    lengths = np.diff(run.starts)
    here = np.arange(len(run.initial)) + np.repeat(np.arange(len(lengths)), lengths)
    arcs = []

    def add(places: np.ndarray, state: int, label: int, to_places: np.ndarray, to_states: np.ndarray, price: np.ndarray, allowed: np.ndarray) -> None:
        to = np.maximum(to_states, 0)
        good = allowed & (to_states >= 0) & (cost[places, state] < _FAR)
        good &= cost[places, state] == cost[to_places, to] + price
        arcs.append((places[good] * 4 + state, np.full(int(good.sum()), label), to_places[good] * 4 + to[good]))

    free, extra = ~run.must, np.where(run.cut, costs.truncated, 0)
    every = np.arange(len(cost))
    for state in range(4):
        same = np.full(len(here), state)
        add(here, state, DELETE, here + 1, same, np.full(len(here), costs.delete), np.ones(len(here), bool))
        add(here, state, KEEP, here + 1, _FOLLOWS[state][run.initial], costs.keep + extra, free)
        add(here, state, REROLE, here + 1, np.full(len(here), _GIVEN[state]), costs.rerole + extra, free)
        add(every, state, INSERT, every, np.full(len(every), _GIVEN[state]), np.full(len(every), costs.insert), np.ones(len(every), bool))
    node, label, to = (np.concatenate(x) for x in zip(*arcs, strict=True))
    return node, label, to


def _least(node: np.ndarray, label: np.ndarray, to: np.ndarray, rank: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Every node's arc of least (label, rank of the next node): label (-1 without an arc) and next node (itself)."""
    order = np.lexsort((rank[to], label, node))
    chosen = order[np.flatnonzero(np.diff(node[order], prepend=-1))]
    labels, nexts = np.full(nodes, -1), np.arange(nodes)
    labels[node[chosen]], nexts[node[chosen]] = label[chosen], to[chosen]
    return labels, nexts


def ranked_paths(node: np.ndarray, label: np.ndarray, to: np.ndarray, nodes: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Labels of the least paths' edits by node, and pointers 1, 2, 4, ... edits ahead, until all rest at an end."""
    labels, ahead = _least(node, label, to, np.zeros(nodes, np.int64), nodes)
    rank = labels + 1
    while True:
        beyond = ahead[ahead]
        if np.array_equal(beyond, ahead):
            break
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[ahead], return_inverse=True)[1]
        ahead = beyond
    labels, ahead = _least(node, label, to, rank, nodes)
    pointers = [ahead]
    while True:
        beyond = pointers[-1][pointers[-1]]
        if np.array_equal(beyond, pointers[-1]):
            return labels, pointers
        pointers.append(beyond)


def audits(labels: np.ndarray, pointers: list[np.ndarray], starts: np.ndarray) -> list[bytes]:
    """The edits' signs along the path from each start: every level of pointers puts one node between two, ends fall away."""
    nodes, owner = np.asarray(starts, np.int64), np.arange(len(starts))
    going = labels[nodes] >= 0
    nodes, owner = nodes[going], owner[going]
    for pointer in reversed(pointers):
        nodes, owner = np.stack((nodes, pointer[nodes]), axis=1).ravel(), np.repeat(owner, 2)
        going = labels[nodes] >= 0
        nodes, owner = nodes[going], owner[going]
    signs = np.frombuffer(LABELS, np.uint8)[labels[nodes]].tobytes()
    bounds = np.searchsorted(owner, np.arange(len(starts) + 1))
    return [signs[bounds[i] : bounds[i + 1]] for i in range(len(starts))]


def solved(run: Run, costs: EditCosts) -> list[tuple[int, bytes]]:
    """(cost, audit) of every whole conversation of the run."""
    cost = costs_to_end(run, ENDS, costs)
    labels, pointers = ranked_paths(*optimal_arcs(run, cost, costs), cost.size)
    firsts = run.starts[:-1] + np.arange(len(run.starts) - 1)
    return list(zip(cost[firsts, EMPTY].tolist(), audits(labels, pointers, firsts * 4 + EMPTY), strict=True))


def crossings(run: Run, costs: EditCosts) -> list[tuple[int, int, int, str]]:
    """(state at the beginning, state at the end, cost, audit) of the one part of a conversation in the run."""
    out = []
    for end in range(4):
        cost = costs_to_end(run, (end,), costs)
        labels, pointers = ranked_paths(*optimal_arcs(run, cost, costs), cost.size)
        begins = [state for state in range(4) if cost[0, state] < _FAR]
        out += [(state, end, int(cost[0, state]), a.decode()) for state, a in zip(begins, audits(labels, pointers, np.array(begins)), strict=True)]
    return out


class _Lines:
    """Applies an audit to rows in order; repaired lines leave in pieces."""

    def __init__(self, state: int, audit: str):
        self.state, self.audit, self.at, self.lines, self.size = state, audit, 0, [], 0

    def _given(self) -> str:
        role = "assistant" if self.state == USER else "user"
        self.state = int(_GIVEN[self.state])
        return role

    def _line(self, role: str, text: str) -> None:
        self.lines.append(f"{role}:{text}")
        self.size += len(self.lines[-1])

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._line(self._given(), "")

    def row(self, role: str, text: str, times: int = 1) -> None:
        """A row and its repeats, of which all but the first are deleted."""
        for _ in range(times):
            self.inserted()
            sign, self.at = self.audit[self.at], self.at + 1
            if sign == "R":
                self._line(self._given(), text)
            elif sign == "K":
                self.state = int(_FOLLOWS[self.state][_initial(role)])
                self._line(role, text)

    def piece(self) -> str:
        out, self.lines, self.size = "\n".join(self.lines), [], 0
        return out


def _initial(role: str) -> int:
    return INITIALS.index(role[0]) if role[:1] and role[0] in INITIALS else 3


_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_ROW = "role string, text string, times long, blank boolean, cut boolean, seen boolean"
_CROSSING = "array<struct<begin:int,end:int,cost:long,audit:string>>"
_OUT = f"kind string, conv_id {{id}}, part int, no long, {', '.join(f'{c} long' for c in _COUNTS)}, cost long, audit string, text string, whole boolean, role string, times long, crossing {_CROSSING}, first int, last int"


class _Out:
    """Rows of the result, gathered into batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, **row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += 200 + len(row.get("text") or "") + len(row.get("audit") or "")
        if self.size > 4 * PIECE_CHARS:
            yield self.batch()

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in self.rows], f.type) for f in self.schema], schema=self.schema)
        self.rows, self.size = [], 0
        return out


def _group(table: pa.Table, starts: np.ndarray, open_first: bool, open_last: bool, part: int, costs: EditCosts, out: _Out) -> Iterator[pa.RecordBatch]:
    """The rows of the result for consecutive conversations; those that may go on elsewhere as crossings and rows."""
    column = lambda name: table.column(name).to_pylist()
    ids, roles, texts, times = column("conv_id"), column("role"), column("text"), np.array(column("times"), np.int64)
    blank, cut, seen = (np.array(column(n), bool) for n in ("blank", "cut", "seen"))
    codes = np.array([_initial(r) for r in roles])
    at = np.repeat(np.arange(len(roles)), times)
    again = np.concatenate(([False], at[1:] == at[:-1])) if len(at) else np.zeros(0, bool)
    faults = {"blank": blank[at], "duplicate": ~blank[at] & (seen[at] | again)}
    must = faults["blank"] | faults["duplicate"]
    faults["truncated"] = ~must & cut[at]
    begins = np.concatenate(([0], np.cumsum(times)))[starts]
    initial = codes[at]
    wrong = np.zeros(len(at), bool)
    wrong[1:] = ~_LEGAL[initial[:-1], initial[1:]]
    wrong[begins[:-1]] = False
    faults["illegal"] = wrong
    counted = {k: np.add.reduceat(v.astype(np.int64), begins[:-1]).tolist() for k, v in faults.items()}
    n = len(starts) - 1
    inner = range(int(open_first), n - int(open_last and not (open_first and n == 1)))

    def run(a: int, b: int) -> Run:
        rows = slice(begins[a], begins[b])
        return Run(initial[rows], must[rows], faults["truncated"][rows], begins[a : b + 1] - begins[a])

    found = solved(run(inner.start, inner.stop), costs) if len(inner) else []
    for c in range(n):
        rows, facts = range(starts[c], starts[c + 1]), {k: v[c] for k, v in counted.items()}
        name = {"conv_id": ids[starts[c]], "part": part}
        if c in inner:
            cost, audit = found[c - inner.start]
            yield from out.add(kind="report", cost=cost, audit=audit.decode(), **name, **facts)
            lines, no = _Lines(EMPTY, audit.decode()), 0
            for i in rows:
                lines.row(roles[i], texts[i], int(times[i]))
                if lines.size > PIECE_CHARS:
                    yield from out.add(kind="piece", no=no, text=lines.piece(), whole=False, **name)
                    no += 1
            lines.inserted()
            yield from out.add(kind="piece", no=no, text=lines.piece(), whole=no == 0, **name)
        else:
            crossing = [dict(zip(("begin", "end", "cost", "audit"), x, strict=True)) for x in crossings(run(c, c + 1), costs)]
            yield from out.add(kind="part", crossing=crossing, first=int(initial[begins[c]]), last=int(initial[begins[c + 1] - 1]), **name, **facts)
            for no, i in enumerate(rows):
                yield from out.add(kind="row", no=no, role=roles[i], text=texts[i], times=int(times[i]), **name)


def _changes(ids: pa.ChunkedArray) -> np.ndarray:
    """Where another conversation begins, from the second row on."""
    a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
    differ = pc.fill_null(pc.not_equal(a, b), False)
    return np.flatnonzero(pc.or_(differ, pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False) if len(a) else []) + 1


def _repaired(schema: pa.Schema, costs: EditCosts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, opened, part = _Out(schema), [], True, TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ends = pa.chunked_array([held[-1].column(0).slice(held[-1].num_rows - 1)] if held else [batch.column(0).slice(0, 1)])
            changes = _changes(pa.chunked_array([*ends.chunks, batch.column(0)])) - 1
            if len(changes) == 0:
                held.append(batch)
                continue
            cut = int(changes[-1])
            table = pa.Table.from_batches([*held, batch.slice(0, cut)])
            if table.num_rows:
                starts = np.concatenate(([0], _changes(table.column(0)), [table.num_rows]))
                yield from _group(table, starts, opened, False, part, costs, out)
                opened = False
            held = [batch.slice(cut)]
        if held:
            table = pa.Table.from_batches(held)
            starts = np.concatenate(([0], _changes(table.column(0)), [table.num_rows]))
            yield from _group(table, starts, opened, True, part, costs, out)
        yield out.batch()

    return run


def _put_together(schema: pa.Schema, costs: EditCosts):
    """Reports of the conversations whose parts come in order, and the audit of every part."""

    def finished(name, parts: list[dict], best: dict[int, tuple[int, str]], trace: list[dict], out: _Out) -> Iterator[pa.RecordBatch]:
        cost, audit, state = min((*best[s], s) for s in ENDS if s in best)
        sums = {k: sum(p[k] for p in parts) for k in _COUNTS}
        sums["illegal"] += sum(not _LEGAL[p["last"], q["first"]] for p, q in zip(parts, parts[1:], strict=False))
        yield from out.add(kind="report", conv_id=name, cost=cost, audit=audit, **sums)
        for p, came in zip(reversed(parts), reversed(trace), strict=True):
            state, piece = came[state]
            yield from out.add(kind="audit", conv_id=name, part=p["part"], no=-1, first=state, audit=piece)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, parts, best, trace = _Out(schema), None, [], {}, []
        for batch in batches:
            for row in batch.to_pylist():
                if parts and row["conv_id"] != name:
                    yield from finished(name, parts, best, trace, out)
                    parts = []
                if not parts:
                    name, best, trace = row["conv_id"], {EMPTY: (0, "")}, []
                ways: dict[int, tuple[int, str, int, str]] = {}
                for x in row.pop("crossing"):
                    if x["begin"] in best:
                        cost, audit = best[x["begin"]]
                        way = (cost + x["cost"], audit + x["audit"], x["begin"], x["audit"])
                        ways[x["end"]] = min(way, ways.get(x["end"], way))
                best = {end: way[:2] for end, way in ways.items()}
                trace.append({end: way[2:] for end, way in ways.items()})
                parts.append(row)
        if parts:
            yield from finished(name, parts, best, trace, out)
        yield out.batch()

    return run


def _applied(schema: pa.Schema):
    """Pieces of the rows of every part, whose audit comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, lines, name, no = _Out(schema), None, {}, 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == "audit":
                    if lines is not None:
                        lines.inserted()
                        yield from out.add(kind="piece", no=no, text=lines.piece(), whole=False, **name)
                    lines, name, no = _Lines(row["first"], row["audit"]), {"conv_id": row["conv_id"], "part": row["part"]}, 0
                    continue
                lines.row(row["role"], row["text"], row["times"])
                if lines.size > PIECE_CHARS:
                    yield from out.add(kind="piece", no=no, text=lines.piece(), whole=False, **name)
                    no += 1
        if lines is not None:
            lines.inserted()
            yield from out.add(kind="piece", no=no, text=lines.piece(), whole=False, **name)
        yield out.batch()

    return run


@dataclass
class Repaired:
    """`reports`: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit). `pieces`: (conv_id, part, no, text, whole),
    the repaired `role:text` lines, newline-joined; a conversation's pieces in order of (part, no), empty ones being no line."""

    reports: DataFrame
    pieces: DataFrame


def repair_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", times: Column | None = None, costs: EditCosts = EditCosts()) -> Repaired:  # noqa: B008
    """The faults of every conversation, its cheapest edits and its repaired turns.

    Rows stand in order of turn, nulls first; rows of one turn by role, then by the digest of their text. `times` tells how
    often a row stands there (once, if not given). A row's first fault counts: blank (nothing but spaces), duplicate (role
    and text stood before), truncated (the last sign is none of .!?). Null roles and texts count as one space, so a null
    text is blank and a null role begins with none of s, u, a; rows with a null id are one conversation. Rows that
    repeat are merged where they are read and count each time. Long texts pass through in pieces; conversations
    in which all rows go have an empty text. Other columns are not looked at. An empty table gives no rows.
    """
    given = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), given(role_col).alias("role"), given(text_col).alias("text"), (F.lit(1) if times is None else times).cast("long").alias("times"))
    digested = rows.withColumn("digest", F.md5("text"))
    key = ["conv_id", "role", "digest"]
    same = lambda other: [F.col(f"rows.{k}").eqNullSafe(F.col(f"{other}.{k}")) for k in key]
    again = digested.groupBy(*key).agg(F.count("*").alias("rows"), F.max(F.col("turn").isNull()).alias("nulls"), F.min("turn").alias("first")).where("rows > 1").drop("rows")
    again = written(again)
    single = digested.alias("rows").join(again.alias("again"), same("again"), "left_anti").withColumn("seen", F.lit(False))
    merged = digested.alias("rows").join(again.alias("again"), same("again")).select("rows.*", (~F.when(F.col("nulls"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("first"))).alias("seen"))
    merged = merged.groupBy("conv_id", "turn", "role", "digest").agg(F.first("text").alias("text"), F.sum("times").alias("times"), F.max("seen").alias("seen"))
    ordered = single.unionByName(merged)
    ordered = ordered.repartitionByRange("conv_id", "turn", "role", "digest").sortWithinPartitions("conv_id", "turn", "role", "digest")
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    ordered = ordered.select("conv_id", "role", "text", "times", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), "seen")

    kind = turns.schema[id_col].dataType.simpleString()
    out = _OUT.format(id=kind)
    empty = turns.sparkSession.createDataFrame([], out)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(empty.schema)
    done = written(ordered.mapInArrow(_repaired(schema, costs), out))
    parts = done.where("kind = 'part'").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    joined = written(parts.mapInArrow(_put_together(schema, costs), out))
    held = done.where("kind = 'row'").unionByName(joined.where("kind = 'audit'")).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "no")
    applied = written(held.mapInArrow(_applied(schema), out))

    places = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.max("turn").cast("decimal(38,0)").alias("top"), F.min("turn").cast("decimal(38,0)").alias("low"), F.count("turn").alias("turns"))
    gaps = places.select(F.col("conv_id").alias("of"), F.coalesce((F.col("top") - F.col("low") + 1 - F.col("turns")).cast("long"), F.lit(0)).alias("gaps"))
    reports = done.unionByName(joined).where("kind = 'report'").select("conv_id", *_COUNTS, "cost", "audit")
    reports = reports.join(gaps, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "gaps", *_COUNTS, "cost", "audit")
    return Repaired(reports, done.unionByName(applied).where("kind = 'piece'").select("conv_id", "part", "no", "text", "whole"))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, state, out = None, None, []
    for batch in batches:
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != name:
                if state is not None:
                    out.append((name, state.hexdigest()))
                name, state, begun = row["conv_id"], hashlib.sha256(), False
            if row["text"]:
                state.update((("\n" if begun else "") + row["text"]).encode())
                begun = True
    if state is not None:
        out.append((name, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["conv_id", "repaired_sha256"])


def text_digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of every conversation's repaired text; the pieces of long ones are read in order, as SHA-256 asks."""
    whole = pieces.where("whole").select("conv_id", F.sha2("text", 256).alias("repaired_sha256"))
    rest = pieces.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    return whole.unionByName(rest.select("conv_id", "text").mapInArrow(_digested, "conv_id long, repaired_sha256 string"))
