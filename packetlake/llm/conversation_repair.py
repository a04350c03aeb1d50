"""Conversation structure repair by bidirectional Dijkstra over the edit lattice.

A lattice node is (rows passed, state of the turn pattern `(s?(ua)+)?`). From it a row is kept, given another role or
deleted, or an empty turn is inserted. One heap runs from the first node, one back from the accepting last nodes; they
stop when no cheaper or equally cheap crossing can be left, and of all cheapest crossings the one with the least
concatenated audit counts. A node's label is its cheapest cost with the least audit of that cost. That is enough: two audits of one
node and one cost both pass the same rows, so neither is the beginning of the other (it would need one more insert).

Rows are sorted by conversation and turn in ranges, so a conversation may lie in many tasks. One that a task sees whole,
of at most BLOCK rows, is repaired where it stands. Of others each task makes blocks of BLOCK rows: the cheapest edits
from each state to each other one. Blocks are folded in order, which costs a few steps a block; what all four candidates
begin with is put aside at once.

Edge cases: null roles and texts are one space; rows without conv_id are one conversation; null turns come first; rows of
one turn are ordered by role and text, and equal rows are counted before they are sorted; a role whose first character
is not s, u or a can't be kept; a conversation that lost all rows has zeros and an empty audit; an empty table gives an
empty result; other columns are ignored.
"""

import hashlib
import heapq
import os

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, lookup, saved, table

BLOCK = 512
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
DELETE, INSERT, REROLE, UNFINISHED = 3, 2, 2, 1
#: (state, role's initial) -> state of the pattern: 0 nothing yet, 1 after s, 2 after u, 3 after a.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTING = (0, 3)
#: state -> what an inserted turn, or one with a new role, must be there.
WANTED = {0: "user", 1: "user", 2: "assistant", 3: "user"}
SPACES = " \t\n\x0b\x0c\r"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: rows after the damage, equal ones counted."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20).alias("_d")).where("_d <> 0")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_d") == 3, 2).otherwise(1).alias("n"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def _moves(rows, node):
    """(next node, cost, edit) of a node; rows: (role's initial, fault)."""
    i, s = node
    yield (i, NEXT[s, WANTED[s][0]]), INSERT, "I"
    if i < len(rows):
        initial, fault = rows[i]
        yield (i + 1, s), DELETE, "D"
        if fault not in (BLANK, DUPLICATE):
            more = UNFINISHED * (fault == TRUNCATED)
            if (s, initial) in NEXT:
                yield (i + 1, NEXT[s, initial]), more, "K"
            yield (i + 1, NEXT[s, WANTED[s][0]]), REROLE + more, "R"


def _moves_back(rows, node):
    i, t = node
    before = [s for s in range(4) if NEXT[s, WANTED[s][0]] == t]
    for s in before:
        yield (i, s), INSERT, "I"
    if i:
        initial, fault = rows[i - 1]
        yield (i - 1, t), DELETE, "D"
        if fault not in (BLANK, DUPLICATE):
            more = UNFINISHED * (fault == TRUNCATED)
            for s in range(4):
                if NEXT.get((s, initial)) == t:
                    yield (i - 1, s), more, "K"
            for s in before:
                yield (i - 1, s), REROLE + more, "R"


def cheapest(rows: list[tuple], first: int = 0, last=ACCEPTING) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from state `first` before the rows to a state of `last` behind them, the least audit of these."""
    n, best = len(rows), None
    labels = {(0, first): (0, "")}, {(n, s): (0, "") for s in last}
    heaps = [(0, 0, first)], [(0, 0, s) for s in last]
    done = set(), set()
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = int(heaps[1][0] < heaps[0][0])
        cost, passed, s = heapq.heappop(heaps[side])
        node = (n - passed if side else passed, s)
        if node in done[side]:
            continue
        done[side].add(node)
        if node in labels[1 - side]:
            total = cost + labels[1 - side][node][0]
            best = total if best is None else min(best, total)
        audit = labels[side][node][1]
        for to, more, edit in (_moves_back if side else _moves)(rows, node):
            new = (cost + more, edit + audit if side else audit + edit)
            if to not in labels[side] or new < labels[side][to]:  # moves of no cost pass a row, so a node's label is final when its turn comes
                labels[side][to] = new
                heapq.heappush(heaps[side], (new[0], n - to[0] if side else to[0], to[1]))
    if best is None:
        return None
    ahead, back = labels
    met = [ahead[v][1] + back[v][1] for v in ahead.keys() & back.keys() if ahead[v][0] + back[v][0] == best]
    for u, (cost, audit) in ahead.items():
        for v, more, edit in _moves(rows, u):
            if v in back and cost + more + back[v][0] == best:
                met.append(audit + edit + back[v][1])
    return best, min(met)


def edited(rows: list[tuple], audit: str, state: int = 0) -> list[dict]:
    """The turns that an audit makes of (role, text, fault) rows."""
    out, left = [], iter(rows)
    for edit in audit:
        role, text = WANTED[state], ""
        if edit != "I":
            old, text, _ = next(left)
            role = old if edit == "K" else role
        if edit != "D":
            out.append({"role": role, "text": text})
            state = NEXT[state, role[0]]
    return out


def _fault(text: str, repeat: bool) -> int:
    last = text.rstrip(SPACES)[-1:]
    return BLANK if not last else DUPLICATE if repeat else TRUNCATED if last not in ".!?" else CLEAN


class _Part:
    """A conversation's rows as far as a task has read them."""

    def __init__(self, key, conv_id):
        self.key, self.conv_id, self.rows, self.turns = key, conv_id, [], []

    def row(self, no: int, whole: bool) -> dict:
        short = [(r[:1], f) for r, _, f in self.rows]
        turns = [t for t in self.turns if t is not None]
        pairs = [x[0] + y[0] for x, y in zip(short, short[1:])]
        out = {"ck": self.key, "conv_id": self.conv_id, "no": no, "low": min(turns, default=None), "high": max(turns, default=None), "kinds": len(set(turns)), "ends": short[0][0] + "\n" + short[-1][0]}
        out |= {k: sum(f == v for _, f in short) for k, v in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))} | {"illegal": sum(p not in ("su", "ua", "au") for p in pairs)}
        if whole:
            cost, audit = cheapest(short)
            return out | {"cost": cost, "audit": audit, "turns": edited(self.rows, audit)}
        edges = [cheapest(short, a, (b,)) for a in range(4) for b in range(4)]
        return out | {"edges": [e and {"cost": e[0], "audit": e[1]} for e in edges], "rows": [{"role": r, "text": t, "fault": f} for r, t, f in self.rows]}


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_PART = pa.schema(
    [("ck", pa.string()), ("conv_id", pa.int64()), ("no", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("kinds", pa.int64()), ("ends", pa.string()), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string())]
    + [("turns", _TURNS), ("edges", pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))), ("rows", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("fault", pa.int32())])))]
)
_PART_DDL = "ck string, conv_id long, no long, low long, high long, kinds long, ends string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, turns array<struct<role string, text string>>, edges array<struct<cost long, audit string>>, rows array<struct<role string, text string, fault int>>"


def parts(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Whole conversations repaired (with `turns`), and the blocks of others (with `edges` and `rows`), from sorted rows."""

    def run(batches):
        no, task = 0, TaskContext.get().partitionId() << 32
        part, full, inside, out = None, False, False, []

        def close(ended):
            nonlocal no
            whole = ended and inside and not full
            out.append(part.row(task + no, whole))
            no += 1

        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(b.num_columns)]
            for key, conv_id, turn, role, text, n, first in zip(*cols):
                if part is None or part.key != key:
                    if part is not None:
                        close(True)
                    inside = part is not None  # it begins in this task
                    part, full = _Part(key, conv_id), False
                for k in range(n):
                    if len(part.rows) == block:
                        full = True
                        close(False)
                        part = _Part(key, conv_id)
                    part.rows.append((role, text, _fault(text, not first or k > 0)))
                    part.turns.append(turn)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_PART)
                out.clear()
        if part is not None:
            close(False)  # it may go on in the next task
            yield pa.RecordBatch.from_pylist(out, schema=_PART)

    return rows.mapInArrow(run, _PART_DDL)


def folded(blocks: DataFrame) -> DataFrame:
    """For each conversation in blocks one row of its report (no null), and for each block its state before it and its audit."""

    def finish(key, conv_id, seen, choices, tails, done, sums, low, high, kinds):
        cost, tail, state = min((*tails[s], s) for s in ACCEPTING if s in tails)
        yield {"ck": key, "conv_id": conv_id, "no": None, "low": low, "high": high, "kinds": kinds, **sums, "cost": cost, "audit": "".join(done) + tail}
        plan = []
        for no, choice in zip(reversed(seen), reversed(choices)):
            before, audit = choice[state]
            plan.append({"ck": key, "no": no, "state": before, "audit": audit})
            state = before
        yield from plan

    def run(batches):
        key, out, held = None, [], None
        for b in batches:
            for x in b.to_pylist():
                if held is None or x["ck"] != key:
                    if held is not None:
                        out += finish(*held)
                    key = x["ck"]
                    held = [key, x["conv_id"], [], [], {0: (0, "")}, [], dict.fromkeys(_COUNTS[:4], 0), None, None, 0]
                    last_end, last_high = None, None
                _, _, seen, choices, tails, done, sums = held[:7]
                begin, end = x["ends"].split("\n")
                for c in _COUNTS[:4]:
                    sums[c] += x[c]
                sums["illegal"] += last_end is not None and last_end + begin not in ("su", "ua", "au")
                if x["low"] is not None:
                    held[7] = x["low"] if held[7] is None else held[7]
                    held[8], held[9] = x["high"], held[9] + x["kinds"] - (last_high == x["low"])
                    last_high = x["high"]
                last_end = end
                new, choice = {}, {}
                for a, (cost, tail) in tails.items():
                    for to in range(4):
                        e = x["edges"][4 * a + to]
                        if e is not None:
                            found = (cost + e["cost"], tail + e["audit"])
                            if to not in new or found < new[to]:
                                new[to], choice[to] = found, (a, e["audit"])
                same = os.path.commonprefix([t for _, t in new.values()])
                done.append(same)
                held[4] = {s: (c, t[len(same) :]) for s, (c, t) in new.items()}
                seen.append(x["no"])
                choices.append(choice)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
        if held is not None:
            yield pa.RecordBatch.from_pylist(list(finish(*held)), schema=schema)

    names = ("ck", "conv_id", "no", "low", "high", "kinds", *_COUNTS, "audit")
    schema = pa.schema([*(_PART.field(c) for c in names), ("state", pa.int32())])
    ddl = "ck string, conv_id long, no long, low long, high long, kinds long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, state int"
    rows = blocks.select("ck", "conv_id", "no", "low", "high", "kinds", "ends", *_COUNTS[:4], "edges").repartition("ck").sortWithinPartitions("ck", "no")
    return rows.mapInArrow(run, ddl)


def repair(conversations: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(report, turns). report: a row for each conversation with its faults, cost and audit; turns: conv_id, ck, no and the repaired turns, in parts ordered by no."""
    key = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    asked = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = saved(damaged(asked).withColumns({"ck": key, "h": F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))}))
    at = F.struct(F.col("turn").isNotNull().alias("set"), "turn")
    firsts = rows.groupBy("ck", "h").agg(F.min(at).alias("first"), F.count("*").alias("m"))
    marked = saved(lookup(rows, firsts, ["ck", "h"], ["first"], "m", rows.count()).select("ck", "conv_id", "turn", "role", "text", F.col("n").cast("long"), (at == F.col("first")).alias("is_first")))
    forget(rows)
    order = ("ck", "turn", "role", "text")
    done = saved(parts(marked.repartitionByRange(*order).sortWithinPartitions(*order), block))
    forget(marked)
    whole, blocks = done.where("turns is not null"), done.where("turns is null")
    plan = saved(folded(blocks))

    def turns_of(batches):
        for b in batches:
            t = b.select(["rows", "state", "audit"]).to_pylist()
            new = [edited([(r["role"], r["text"], r["fault"]) for r in x["rows"]], x["audit"], x["state"]) for x in t]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(new, _TURNS)], names=["ck", "conv_id", "no", "turns"])

    pieces = blocks.select("ck", "conv_id", "no", "rows").join(plan.where("no is not null").select("ck", "no", "state", "audit"), ["ck", "no"])
    pieces = pieces.select("ck", "conv_id", "no", "rows", "state", "audit").mapInArrow(turns_of, "ck string, conv_id long, no long, turns array<struct<role string, text string>>")
    names = ("ck", "low", "high", "kinds", *_COUNTS, "audit")
    found = whole.select(*names).unionByName(plan.where("no is null").select(*names))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("kinds"), F.lit(0))
    everyone = asked.select("conv_id").distinct().withColumn("ck", key)
    report = everyone.join(found, "ck", "left").select("conv_id", "ck", gaps.alias("gaps"), *[F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS], F.coalesce("audit", F.lit("")).alias("audit"))
    return report, whole.select("ck", "conv_id", "no", "turns").unionByName(pieces)


def digests(turns: DataFrame) -> DataFrame:
    """ck, repaired_sha256 of the lines `role:text` of each conversation; the text of a long one runs through one hash, part by part."""
    lines = turns.withColumn("text", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")).select("ck", "no", "text", (F.size("turns") > 0).alias("some"))

    def run(batches):
        key, sha, some, out = None, None, False, []
        for b in batches:
            for k, _, text, own in zip(*(b.column(c).to_pylist() for c in range(4))):
                if k != key:
                    if sha:
                        out.append({"ck": key, "repaired_sha256": sha.hexdigest()})
                    key, sha, some = k, hashlib.sha256(), False
                if own:
                    sha.update(("\n" if some else "").encode() + text.encode())
                    some = True
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
        if sha:
            yield pa.RecordBatch.from_pylist([{"ck": key, "repaired_sha256": sha.hexdigest()}], schema=schema)

    schema = pa.schema([("ck", pa.string()), ("repaired_sha256", pa.string())])
    return lines.repartition("ck").sortWithinPartitions("ck", "no").mapInArrow(run, "ck string, repaired_sha256 string")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    report, turns = repair(table(spark, sf_dir, "conversations"))
    out = report.join(digests(turns), "ck", "left")
    return out.select("conv_id", "gaps", *_COUNTS, "audit", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
