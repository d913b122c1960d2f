"""Repair of conversations against a search over all edits, row by row."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import repair
from feedloom.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"
ROWS = "conv_id long, turn long, role string, text string"
STEPS = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
SET_IN = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def plain_faults(rows):
    """Per row: blank, duplicate, truncated or none, by its first fault."""
    seen, out = set(), []
    for role, text in rows:
        if not text.strip(SPACE):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if text.rstrip(SPACE)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Least (cost, audit) by state, forwards; the repaired rows go along."""
    best = {"": (0, "", [])}

    def set_in(best):
        for _ in range(4):
            for q, (c, a, r) in list(best.items()):
                role = SET_IN[q]
                new = (c + 2, a + "I", r + [(role, "")])
                best[role[0]] = min(best.get(role[0], new), new, key=lambda x: x[:2])
        return best

    for (role, text), fault in zip(rows, plain_faults(rows)):
        after = {}

        def put(q, c, a, r):
            after[q] = min(after.get(q, (c, a, r)), (c, a, r), key=lambda x: x[:2])

        for q, (c, a, r) in set_in(best).items():
            put(q, c + 3, a + "D", r)
            if fault in ("", "truncated"):
                more = fault == "truncated"
                if role and role[0] in STEPS[q]:
                    put(STEPS[q][role[0]], c + more, a + "K", r + [(role, text)])
                put(SET_IN[q][0], c + 2 + more, a + "R", r + [(SET_IN[q], text)])
        best = after
    best = set_in(best)
    return min((best[q] for q in ("", "a") if q in best), key=lambda x: x[:2])


def plain_digest(turns, rows):
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    faults = plain_faults(rows)
    numbers = [t for t in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(rows[:-1], rows[1:]))
    cost, audit, left = plain_repair(rows)
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in left))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())


def mark(conv, role, text):
    key = "n" if conv is None else f"v{conv}"
    return hashlib.sha256(f"{len(key)}:{len(role)}:{key}:{role}:{text}".encode()).digest()[:16]


def plain(rows):
    """conv_id -> digest of rows (conv_id, turn, role, text, times)."""
    convs = {}
    for conv, turn, role, text, times in rows:
        role, text = (" " if v is None else v for v in (role, text))
        convs.setdefault(conv, []).extend([(turn is not None, turn or 0, role, mark(conv, role, text), text)] * times)
    return {c: plain_digest([r[1] if r[0] else None for r in sorted(v)], [(r[2], r[4]) for r in sorted(v)]) for c, v in convs.items()}


def digests(frame, **more):
    return {r["conv_id"]: tuple(r)[1:] for r in repair.Plan(frame, **more).digests().collect()}


def conversation(rng, conv, n):
    texts = ["Yes.", "no", "", "  ", "Why? ", "So it is!", "and then\n", "ok."] + [f"Line {k}." for k in range(n)]
    return [(conv, rng.choice([k, k, k, k + 3, None]), rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]),
             rng.choice([*texts, None]), 1) for k in range(n)]


@pytest.mark.parametrize("block", [1, 3, 2048])
def test_against_all_edits(spark, block):
    rng = random.Random(block)
    rows = [r for c in range(80) for r in conversation(rng, c, rng.randrange(1, 14))] + conversation(rng, None, 9) + conversation(rng, 900, 150)
    rows += [(901, 1, "user", "Hi.", 5), (902, 1, "user", "Gone.", 0), (903, 2**60 + 1, "user", "A.", 1), (903, None, "system", "B.", 1), (904, 3, "", "", 1)]
    frame = spark.createDataFrame(rows, ROWS + ", times int").repartition(7)
    assert digests(frame, times=F.col("times"), block=block) == plain(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Yes."), (1, 2, "assistant", "Then?"), (2, 0, "user", "x y.")]
    got = [tuple(r) for r in repair.Plan(spark.createDataFrame(rows, ROWS)).repaired().orderBy("conv_id", "position").collect()]
    assert got == [(1, 0, "system", "Be brief.", "K"), (1, 1, "user", "Yes.", "R"), (1, 2, "assistant", "Then?", "K"),
                   (2, 0, "user", "x y.", "K"), (2, 1, "assistant", "", "I")]


def test_ranks_choose_between_arcs_of_one_letter():
    """Arcs that agree in their first letters: only what lies behind them tells them apart."""
    rng = random.Random(6)
    for _ in range(60):
        n = 24
        arcs = sorted({(v, rng.choice([1, 1, 2]), rng.randrange(v + 1, min(v + 5, n))) for v in range(n - 1) for _ in range(3)})
        least = {n - 1: ()}
        for v in range(n - 2, -1, -1):
            least[v] = min((a, *least[w]) for x, a, w in arcs if x == v)
        letter, to = repair.chosen_arcs(*(np.array(x) for x in zip(*arcs)), n)
        who, place, node = repair.paths(to, np.arange(n))
        for v in range(n):
            path = node[who == v]
            assert tuple(letter[path[:-1]]) == least[v] and path[-1] == n - 1 and list(place[who == v]) == list(range(len(path)))


def test_one_conversation_over_many_blocks_and_ranges(spark):
    """Ranges cut the conversation, blocks cut the ranges."""
    rng = random.Random(9)
    rows = [(7, k, rng.choice(["user", "assistant"]), f"Line {rng.randrange(400)}{rng.choice('.?, ')}", 1) for k in range(600)]
    frame = spark.createDataFrame(rows, ROWS + ", times int").repartition(5)
    found = repair.faults(repair.marked(frame, "conv_id", None))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert repair.blocks_of(found, 4).select("part").distinct().count() > 3
        assert digests(frame, block=4) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_tables(spark):
    assert digests(spark.createDataFrame([], ROWS)) == {}
    rows = [(1, 0, "user", "Say it. " * 50_000, "a"), (1, 1, "assistant", None, "b"), (1, 1, None, "x", "c")]
    crowded = spark.createDataFrame(rows, ROWS + ", mark string").withColumns({c: F.lit(c) for c in ("conv", "kind", "b", "first", "blank", "part")})
    assert digests(crowded) == plain([(*r[:4], 1) for r in rows])


def test_query(spark):
    sf, rows, originals = "/root/testdata/sf0.01", [], set()
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        c = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if c == 1 else re.sub("[.!?]", "", r.text) if c == 2 else r.text
        originals.add(r.conv_id)
        rows.append((r.conv_id, r.turn, "user" if c == 4 else r.role, text, 0 if c == 0 else 2 if c == 3 else 1))
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op11_repair_conversations"](spark, sf).collect()}
    assert got.keys() == originals and got == plain(rows)
