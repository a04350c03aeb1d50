"""Conversation repair against a plain dynamic programme and a literal reading of the damage, on small fixtures."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from packetlake.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, ck string, no long"


def brute_rows(rows):
    """conv_id -> rows after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        role = "user" if d == 4 else role
        out[conv] += [(turn, role, text)] * (2 if d == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def brute(rows):
    """gaps, counts, cost, audit and hash of one conversation by a search over all prefixes of edits."""
    seen, marked = set(), []
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not words else "dup" if (role, text) in seen else "cut" if words[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserts(layer):
        for _ in range(4):
            for s, (cost, audit, lines) in list(layer.items()):
                for role in ("user", "assistant"):
                    t = step.get((s, role[0]))
                    new = (cost + 2, audit + "I", (*lines, role + ":"))
                    if t is not None and (t not in layer or new[:2] < layer[t][:2]):
                        layer[t] = new
        return layer

    layer = inserts({0: (0, "", ())})
    for role, text, fault in marked:
        after = {}
        for s, (cost, audit, lines) in layer.items():
            new = [(s, (cost + 3, audit + "D", lines))]
            if fault not in ("blank", "dup"):
                more = int(fault == "cut")
                new.append((step.get((s, role[:1])), (cost + more, audit + "K", (*lines, f"{role}:{text}"))))
                new += [(step.get((s, r[0])), (cost + 2 + more, audit + "R", (*lines, f"{r}:{text}"))) for r in ("user", "assistant")]
            for t, x in new:
                if t is not None and (t not in after or x[:2] < after[t][:2]):
                    after[t] = x
        layer = inserts(after)
    cost, audit, lines = min(layer[s] for s in (0, 3) if s in layer)
    count = lambda f: sum(x[2] == f for x in marked)
    return gaps, count("blank"), count("dup"), count("cut"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def fixture(r):
    rows = []
    for c in range(120):
        for t in range(r.randint(1, 12)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((c, t if r.random() < 0.9 else r.choice([None, t + 2, 3]), role, r.choice(["Hi.", "No", "", " \t", "Yes!  ", None, f"x{r.randint(0, 4)}?", "é. \n"])))
    rows += [(500, t, "user" if t % 2 else "assistant", f"t {t % 40}{'.' if t % 3 else ''}") for t in range(400)]  # longer than a block
    rows += [(None, 1, "user", "a."), (None, None, "assistant", "b.")] + [(501, 1, "user", "same.")] * 30
    return rows


def check(spark, rows, partitions, block):
    df = spark.createDataFrame([(*x, "x", 7) for x in rows], SCHEMA).repartition(partitions)
    report, turns = cr.repair(df, block)
    got = {r.conv_id: tuple(r)[1:] for r in report.join(cr.digests(turns), "ck", "left").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    want = {c: brute(x) for c, x in brute_rows(rows).items()}
    assert got.keys() == want.keys()
    for c, w in want.items():
        g = got[c]
        assert (*g[:-1], g[-1] or hashlib.sha256(b"").hexdigest()) == w, c


@pytest.mark.parametrize("partitions, block", [(1, 512), (7, 512), (5, 3)])
def test_equals_a_plain_search(spark, partitions, block):
    check(spark, fixture(random.Random(block + partitions)), partitions, block)


def test_heaps_meet_on_the_least_of_all_cheapest_audits():
    r = random.Random(5)
    for _ in range(3000):
        rows = [(r.choice("suat"), r.choice((0, 0, 0, 1, 2, 3))) for _ in range(r.randint(0, 7))]
        cost, audit = cr.cheapest(rows)
        text = {1: "", 3: "x"}
        seen = []
        for k, (initial, fault) in enumerate(rows):
            seen.append((k, {"s": "system", "u": "user", "a": "assistant", "t": "tool"}[initial], text.get(fault, f"{k}.") if fault != 3 else f"{k}"))
        if all(f in (0, 1, 3) for _, f in rows):
            assert (cost, audit) == brute(seen)[5:7]


def test_empty_table_and_lost_conversations(spark):
    report, turns = cr.repair(spark.createDataFrame([], SCHEMA))
    assert report.count() == 0 and cr.digests(turns).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    report, _ = cr.repair(spark.createDataFrame([(gone, 0, "user", "Hi.", "x", 1)], SCHEMA))
    assert [tuple(r)[2:] for r in report.collect()] == [(0, 0, 0, 0, 0, 0, "")]
