"""Conversation structure repair by prefix-doubling path ranking.

A conversation is in order when its role initials are ``(s?(ua)+)?``. Its rows, by turn, are edited at least cost: keep 0,
rerole to user or assistant 2, delete 3 (required for blank rows and repeats), insert an empty user or assistant row
2, and 1 for every truncated row that stays. Of the cheapest edits the one with the ASCII-least string of initials (D, I,
K, R) is the audit.

Rows become one byte each (initial and fault), in blocks of at most ``BLOCK`` rows that lie in order in range-sorted
partitions, so that a conversation of any length is spread over tasks. Every row is a min-plus matrix over the four states of the
grammar; their products by powers of two (inside a block in numpy, over blocks by joins of a block with that 2^k behind
it) give each block the cost of what follows it. With it the optimal arcs of a block are known: nodes are
(row, state), and prefix doubling ranks nodes by the least audit of 1, 2, 4, ... letters: of the places that a node's least audit of
2^k letters may lead to, those stay whose own least 2^k letters rank first, and both ranks make the next one. The ranks
choose each node's arc; pointers doubled along the chosen arcs then list the path of a start. A block answers for
each state it may be entered in, and the states blocks are entered in are composed by powers of two again.

The texts move once: sorted by conversation and order they stream past the audits of their blocks, a batch at a time, and come
back repaired. Only that last pass reads one conversation in one task, as a hash of its whole text must.

Definitions. Rows with a null turn come first; rows that share a turn come by role, then by a hash of the row. A null role or text is one
space. A row's first fault counts: blank (no character but ASCII white space), duplicate (role and text seen
earlier), truncated (the last such character is not one of ``.!?``). A role's initial is its first character; a row with
an empty role, or one that begins otherwise, cannot be kept. Equal rows count each, and all but the first are duplicates. A
null conv_id is a conversation of its own. Empty tables give no rows; other columns may have any name; long texts
are whole.
"""
from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.session import stored

#: Rows of a block, and rows whose blocks are solved at once.
BLOCK, AT_ONCE = 2048, 1 << 14
#: States: nothing yet, behind a system row, behind a user row, behind an assistant row.
STATES, OPEN_STATES = 4, (0, 3)
#: Where an initial (s, u, a, any other) leads from a state; -1: nowhere.
STEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: The state behind a user or assistant row set in or reroled, whichever the grammar allows, and that row's initial.
NEXT, PUT = np.array([2, 2, 3, 2]), np.array([1, 1, 2, 1])
ROLES = {1: "user", 2: "assistant"}
#: Costs, and letters in ASCII order.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LETTERS = np.frombuffer(b"\0DIKR", dtype=np.uint8)
FAR = 1 << 40
#: A row's byte: its initial, and marks of a row that must go and of a truncated one.
MUST_GO, CUT_OFF = 4, 8


# --- min-plus products -------------------------------------------------------------------------------------------------

def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus products of stacks of matrices (or of matrices with vectors)."""
    if b.ndim < a.ndim:
        return (a + b[..., None, :]).min(axis=-1)
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(axis=-2), FAR)


def _inserts() -> np.ndarray:
    out = np.full((STATES, STATES), FAR, dtype=np.int64)
    for q in range(STATES):
        at = q
        for k in range(3):
            out[q, at] = min(out[q, at], INSERT * k)
            at = NEXT[at]
    return out


INSERTS = _inserts()
#: Cost at the end of a conversation, from each state.
CLOSING = product(INSERTS, np.array([0 if q in OPEN_STATES else FAR for q in range(STATES)], dtype=np.int64))


def row_matrices(codes: np.ndarray) -> np.ndarray:
    """What a row costs from state to state, rows set in before it included."""
    out = np.full((len(codes), STATES, STATES), FAR, dtype=np.int64)
    go, cut = (codes & MUST_GO) > 0, ((codes & CUT_OFF) > 0) * TRUNCATED
    for q in range(STATES):
        out[:, q, q] = DELETE
        out[:, q, NEXT[q]] = np.where(go, out[:, q, NEXT[q]], np.minimum(out[:, q, NEXT[q]], REROLE + cut))
        to = STEP[q, codes & 3]
        may = np.flatnonzero(~go & (to >= 0))
        out[may, q, to[may]] = np.minimum(out[may, q, to[may]], cut[may])
    return product(np.broadcast_to(INSERTS, out.shape), out)


def suffixes(matrices: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The product of every row's matrix with all behind it in its block, whose last row is before ``end``, by doubling."""
    out, step, at = matrices.copy(), 1, np.arange(len(matrices))
    while (near := np.flatnonzero(at + step < end)).size:
        out[near] = product(out[near], out[near + step])
        step *= 2
    return out


# --- the least path of a block -----------------------------------------------------------------------------------------

def chosen_arcs(src: np.ndarray, letter: np.ndarray, dst: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Each node's letter (0 at an end) and successor on the path with the least letters, from all optimal arcs.

    Ranks by 1, 2, 4, ... letters: ``lead`` holds the pairs (node, place behind its least letters); of a node's places those
    of least rank stay. Of arcs that agree to the last letter the one to the lesser node counts.
    """
    rank = np.zeros(nodes, dtype=np.int64)
    least = np.full(nodes, 99)
    np.minimum.at(least, src, letter)
    keep = letter == least[src]
    lead_src, lead_dst = src[keep], dst[keep]
    held = np.unique(src)
    rank[held] = least[held]
    while True:
        # An end leads to itself with the least rank there is.
        best = np.full(nodes, np.iinfo(np.int64).max)
        np.minimum.at(best, lead_src, rank[lead_dst])
        keep = rank[lead_dst] == best[lead_src]
        lead_src, lead_dst = lead_src[keep], lead_dst[keep]
        both = np.zeros(nodes, dtype=np.int64)
        both[held] = rank[held] * (rank.max() + 1) + best[held]
        rank = np.unique(both, return_inverse=True)[1]
        # Places of places: every pair goes on along the pairs of where it ended, if that is no end.
        order = np.argsort(lead_src, kind="stable")
        first, count = np.searchsorted(lead_src[order], lead_dst), np.bincount(lead_src, minlength=nodes)[lead_dst]
        if not count.any():
            break
        repeat = np.maximum(count, 1)
        inside = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        onward = np.repeat(count > 0, repeat)
        far = np.repeat(lead_dst, repeat)
        far[onward] = lead_dst[order][(np.repeat(first, repeat) + inside)[onward]]
        pairs = np.unique(np.repeat(lead_src, repeat) * nodes + far)
        lead_src, lead_dst = pairs // nodes, pairs % nodes
    # The ranks of whole audits choose: the least letter, then the least rank behind it, then the least node.
    order = np.lexsort((dst, rank[dst], letter, src))
    first = np.append(True, src[order][1:] != src[order][:-1])[:len(order)]
    take = order[first]
    out, to = np.zeros(nodes, dtype=np.int64), np.arange(nodes)
    out[src[take]], to[src[take]] = letter[take], dst[take]
    return out, to


def paths(to: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start's index, position, node) of all nodes on the starts' paths, ends included, by doubled pointers."""
    jumps = [to]
    while not np.array_equal(jumps[-1], nxt := jumps[-1][jumps[-1]]):
        jumps.append(nxt)
    who, place, node = np.arange(len(starts)), np.zeros(len(starts), dtype=np.int64), starts.copy()
    for k in range(len(jumps) - 1, -1, -1):
        # A pointer that ends early stands at the end already: what is behind it is cut off below.
        who, place, node = np.tile(who, 2), np.concatenate((place, place + (1 << k))), np.concatenate((node, jumps[k][node]))
        # Of repeated ends the first position counts.
        order = np.lexsort((place, node, who))
        who, place, node = who[order], place[order], node[order]
        new = np.append(True, (who[1:] != who[:-1]) | (node[1:] != node[:-1]))
        who, place, node = who[new], place[new], node[new]
    order = np.lexsort((place, who))
    return who[order], place[order], node[order]


def solve(blocks: list[bytes], closing: np.ndarray, last: np.ndarray) -> list[tuple[list[int], list[int], list[bytes]]]:
    """For every block, whose rows cost ``closing`` behind its end: by the state it is entered in the cost, the state it is
    left in, and the audit. ``last`` blocks close their conversation, so that rows may be set in behind them."""
    sizes = np.array([len(b) for b in blocks])
    codes = np.frombuffer(b"".join(blocks), dtype=np.uint8).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    block = np.repeat(np.arange(len(sizes)), sizes)
    behind = suffixes(row_matrices(codes), (begin + sizes)[block])
    # Nodes: (row or the end of its block) x state.
    base = (begin + np.arange(len(sizes))) * STATES
    cost = np.empty((len(codes) + len(sizes), STATES), dtype=np.int64)
    row_at = np.arange(len(codes)) + block
    end_at = begin + sizes + np.arange(len(sizes))
    cost[row_at] = product(behind, closing[block])
    cost[end_at] = closing
    state = np.arange(STATES)
    node = lambda at, q: (at[:, None] * STATES + q)
    src, letter, dst = [], [], []

    def arcs(at, mark, target, price):
        """Those of the arcs that are optimal; a target below zero is none."""
        there = cost.ravel()[np.maximum(target, 0)]
        good = (target >= 0) & (cost[at] < FAR) & (price + there == cost[at])
        src.append(node(at, state)[good])
        dst.append(target[good])
        letter.append(np.full(good.sum(), mark))

    go, cut = ((codes & MUST_GO) > 0)[:, None], (((codes & CUT_OFF) > 0) * TRUNCATED)[:, None]
    arcs(row_at, 1, node(row_at + 1, state), np.full((len(codes), STATES), DELETE))
    inside = np.concatenate((row_at, end_at[last]))
    arcs(inside, 2, node(inside, NEXT), np.full((len(inside), STATES), INSERT))
    to = STEP[:, codes & 3].T
    arcs(row_at, 3, np.where(go | (to < 0), -1, (row_at[:, None] + 1) * STATES + to), np.broadcast_to(cut, to.shape))
    arcs(row_at, 4, np.where(go, -1, node(row_at + 1, NEXT)), REROLE + np.broadcast_to(cut, to.shape))
    mark, to = chosen_arcs(*(np.concatenate(x) for x in (src, letter, dst)), cost.size)
    starts = (base[:, None] + state).ravel()
    who, _, at = paths(to, starts)
    text, bounds = LETTERS[mark[at]], np.searchsorted(who, np.arange(len(starts) + 1))
    out = []
    for k in range(len(sizes)):
        spans = [(int(bounds[k * STATES + q]), int(bounds[k * STATES + q + 1])) for q in range(STATES)]
        out.append((cost[base[k] // STATES].tolist(), [int(at[b - 1] % STATES) for _, b in spans], [text[a:b - 1].tobytes() for a, b in spans]))
    return out


# --- rows, blocks and their order --------------------------------------------------------------------------------------

def _key(conv: Column) -> Column:
    """Conversations as text, so that a null one has a key too."""
    return F.coalesce(F.concat(F.lit("v"), conv.cast("string")), F.lit("n"))


def marked(rows: DataFrame, conv_col: str, times: Column | None) -> DataFrame:
    """(conv, turn, role, text, times, mark): rows with their key, and a hash of conversation, role and text."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    named = rows.select(_key(F.col(conv_col)).alias("conv"), F.col("turn"), space("role").alias("role"), space("text").alias("text"), (F.lit(1) if times is None else times).cast("long").alias("times"))
    # Lengths before the parts: no two rows read alike.
    whole = F.concat_ws(":", F.length("conv").cast("string"), F.length("role").cast("string"), "conv", "role", "text")
    return named.withColumn("mark", F.unhex(F.substring(F.sha2(whole, 256), 1, 32)))


def faults(rows: DataFrame) -> DataFrame:
    """One row for each (conversation, turn, role, text): how often it stands there, whether it stands there first, its
    initial, and whether it is blank or truncated. Aggregates only, so that a row repeated without end is no load."""
    space = r"[\x20\x09-\x0D]"
    slim = rows.select("conv", "turn", "role", "mark", "times", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
                       (~F.col("text").rlike(rf"[.!?]{space}*\z")).alias("cut"))
    once = stored(slim.groupBy("mark", "turn").agg(F.sum("times").alias("times"), *[F.first(c).alias(c) for c in ("conv", "role", "blank", "cut")]))
    # A null turn sorts before all others inside a struct.
    firsts = once.filter("times > 0").groupBy("mark").agg(F.min(F.struct("turn")).alias("at")).select("mark", F.col("at.turn").alias("turn"))
    wanted = [*once.columns, "first"]
    none = [F.lit(None).cast(once.schema[c].dataType).alias(c) for c in ("conv", "role", "blank", "cut")]
    both = once.withColumn("first", F.lit(0)).select(wanted).union(firsts.select("mark", "turn", F.lit(0).alias("times"), *none, F.lit(1).alias("first")).select(wanted))
    return both.groupBy("mark", "turn").agg(F.sum("times").alias("times"), F.max("first").alias("first"),
                                            *[F.first(c, ignorenulls=True).alias(c) for c in ("conv", "role", "blank", "cut")])


def tallies(found: DataFrame) -> DataFrame:
    """Per conversation: gaps and rows by their first fault."""
    here = lambda c: F.when(F.col("times") > 0, F.col(c))
    turns = found.groupBy("conv", "turn").agg(F.max(here("turn")).alias("there"), *[F.sum(c).alias(n) for c, n in (
        (F.when(F.col("blank"), F.col("times")).otherwise(0), "blank"),
        (F.when(~F.col("blank"), F.col("times") - F.col("first")).otherwise(0), "duplicate"),
        (F.when(~F.col("blank") & F.col("cut"), F.col("first")).otherwise(0), "truncated"))])
    gaps = F.coalesce(F.max("there") - F.min("there") + 1 - F.count("there"), F.lit(0)).cast("long")
    return turns.groupBy("conv").agg(gaps.alias("gaps"), *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])


def blocks_of(found: DataFrame, block: int) -> DataFrame:
    """(conv, part, seq, turn, role, mark, codes, illegal, head, tail): the rows in order, cut into blocks that lie in order in
    ranges of (conversation, turn), so that one conversation may lie in many. ``turn, role, mark`` are those of a block's
    first row; ``illegal`` counts neighbours inside a range, ``head`` and ``tail`` are its first and last initials."""
    from pyspark import TaskContext

    initial = F.substring("role", 1, 1)
    byte = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    gone = F.when(F.col("blank"), MUST_GO).when(F.col("first") == 0, MUST_GO).otherwise(F.when(F.col("cut"), CUT_OFF).otherwise(0))
    order = ["conv", "turn", "role", "mark"]
    ready = found.filter("times > 0").select(*order, "times", (byte + gone).cast("int").alias("code"), (byte + MUST_GO).cast("int").alias("again"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, conv, seq, held, start, illegal, before = TaskContext.get().partitionId(), None, 0, bytearray(), None, 0, None
        out = []

        def close():
            nonlocal held, illegal, seq
            if held:
                out.append((conv, part, seq, *start, bytes(held), illegal, held[0] & 3, held[-1] & 3))
                held, illegal, seq = bytearray(), 0, seq + 1

        for frame in frames:
            for key, turn, role, mark, times, code, again in zip(*[frame[c] for c in frame.columns], strict=True):
                if key != conv:
                    close()
                    conv, seq, before = key, 0, None
                now = code & 3
                while times:
                    if not held:
                        start = (turn, role, mark)
                    n = min(times, block - len(held))
                    # Equal neighbours are never in order, nor are two rows of one role.
                    illegal += (before is not None and (before, now) not in {(0, 1), (1, 2), (2, 1)}) + n - 1
                    held += bytes([code]) + bytes([again]) * (n - 1)
                    code, before, times = again, now, times - n
                    if len(held) == block:
                        close()
            if len(out) >= 512:
                yield pd.DataFrame(out, columns=names, dtype=object)
                out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=names, dtype=object)

    kind = "conv string, part int, seq int, turn string, role string, mark binary, codes binary, illegal long, head int, tail int"
    names = [c.split()[0] for c in kind.split(", ")]
    # As text, since integers with nulls would reach Python as floats.
    in_order = ready.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("turn", F.col("turn").cast("string"))
    return in_order.mapInPandas(work, kind)


def placed(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks with their number ``b`` in their conversation and their conversation's ``blocks``; and neighbours out of order by conversation.

    A conversation has a row for each range it lies in; they are fewer than the ranges, whatever its length.
    """
    ranges = cut.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("illegal").alias("illegal"),
                                             F.min_by("head", "seq").alias("head"), F.max_by("tail", "seq").alias("tail"))
    line = Window.partitionBy("conv").orderBy("part")
    before = F.lag("tail").over(line)
    pair = F.concat(before.cast("string"), F.col("head").cast("string"))
    lined = stored(ranges.select("conv", "part", (F.sum("n").over(line) - F.col("n")).alias("skip"), F.sum("n").over(Window.partitionBy("conv")).alias("blocks"),
                                 (F.col("illegal") + F.when(before.isNotNull() & ~pair.isin("01", "12", "21"), 1).otherwise(0)).alias("illegal")))
    illegal = lined.groupBy("conv").agg(F.sum("illegal").cast("long").alias("illegal"))
    where = lined.select("conv", "part", "skip", "blocks")
    return cut.join(where, ["conv", "part"]).withColumn("b", F.col("skip") + F.col("seq")).drop("skip", "seq", "part"), illegal


# --- over blocks ---------------------------------------------------------------------------------------------------------

def _min_plus(a: str, b: str) -> Column:
    n = STATES
    return F.expr(f"transform(sequence(0, {n * n - 1}), i -> least({FAR}L, array_min(transform(sequence(0, {n - 1}), "
                  f"j -> {a}[cast(i div {n} as int) * {n} + j] + {b}[j * {n} + i % {n}]))))")


def _then(a: str, b: str) -> Column:
    return F.expr(f"transform({a}, q -> {b}[q])")


def doubled(rows: DataFrame, value: str, join, behind: bool, rounds: int) -> DataFrame:
    """(conv, b, ``value``) with the values of a block and of all behind it (or before it) joined, 1, 2, 4, ... blocks at a time."""
    out = stored(rows.select("conv", "b", value))
    for k in range(rounds):
        step = -(1 << k) if behind else 1 << k
        other = out.select("conv", (F.col("b") + step).alias("b"), F.col(value).alias("other"))
        both = join(value, "other") if behind else join("other", value)
        out = stored(out.join(other, ["conv", "b"], "left").select(
            "conv", "b", F.when(F.col("other").isNull(), F.col(value)).otherwise(both).alias(value)))
    return out


def block_matrices(blocks: DataFrame) -> DataFrame:
    """(conv, b, m): each block's min-plus matrix, by rows."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for codes in frame["codes"]:
                rows = row_matrices(np.frombuffer(codes, dtype=np.uint8).astype(np.int64))
                while len(rows) > 1:
                    paired = product(rows[:-1:2], rows[1::2])
                    rows = np.concatenate((paired, rows[-1:])) if len(rows) % 2 else paired
                out.append(rows[0].ravel())
            if out:
                yield pd.DataFrame({"conv": frame["conv"], "b": frame["b"], "m": out})

    return blocks.select("conv", "b", "codes").mapInPandas(work, "conv string, b long, m array<long>")


def solved(blocks: DataFrame) -> DataFrame:
    """The blocks with the cost, the state left in and the audit, by the state entered in. ``closing`` is what follows; null: nothing."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            codes = list(frame["codes"])
            sizes = np.cumsum([len(c) for c in codes])
            cuts = np.flatnonzero(np.diff(sizes // AT_ONCE, prepend=0)).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(codes)]):
                if a == b:
                    continue
                part = frame.iloc[a:b]
                ends = [CLOSING if c is None else np.asarray(c, dtype=np.int64) for c in part["closing"]]
                out = solve(codes[a:b], np.stack(ends), np.array([c is None for c in part["closing"]]))
                costs, leaves, audits = zip(*out, strict=True)
                yield pd.DataFrame({**{c: part[c].to_numpy() for c in keep}, "costs": list(costs), "leave": list(leaves), "audits": list(audits)})

    keep = ["conv", "b", "turn", "role", "mark"]
    kind = "conv string, b long, turn string, role string, mark binary, costs array<long>, leave array<int>, audits array<binary>"
    return blocks.select(*keep, "codes", "closing").mapInPandas(work, kind)


def audited(blocks: DataFrame) -> DataFrame:
    """(conv, b, turn, role, mark, audit, cost): every block's letters of its conversation's audit, cost in block 0."""
    most = blocks.agg(F.max("blocks")).first()[0] or 0
    rounds = max(most - 1, 0).bit_length()
    single = solved(blocks.filter("blocks = 1").withColumn("closing", F.lit(None).cast("array<long>")))
    pick = lambda rows, q: rows.select("conv", "b", "turn", "role", "mark", F.element_at("audits", q + 1).alias("audit"),
                                       F.when(F.col("b") == 0, F.element_at("costs", q + 1)).alias("cost"))
    if not rounds:
        return pick(single, F.lit(0))
    long = stored(blocks.filter("blocks > 1"))
    ends = doubled(block_matrices(long), "m", _min_plus, True, rounds)
    closing = F.expr(f"transform(sequence(0, {STATES - 1}), q -> array_min(transform(sequence(0, {STATES - 1}), j -> m[q * {STATES} + j] + "
                     f"array({', '.join(map(str, CLOSING))})[j])))")
    after = ends.select("conv", (F.col("b") - 1).alias("b"), closing.alias("closing"))
    answers = stored(solved(long.join(after, ["conv", "b"], "left")))
    left = doubled(answers, "leave", _then, False, rounds)
    entered = left.select("conv", (F.col("b") + 1).alias("b"), F.element_at("leave", 1).alias("q"))
    many = answers.join(entered, ["conv", "b"], "left")
    return pick(single, F.lit(0)).unionByName(pick(many, F.coalesce("q", F.lit(0))))


# --- what comes out ------------------------------------------------------------------------------------------------------

class Plan:
    """The faults and the audits of a table of conversations (conv_id, turn, role, text); ``times`` says how often a row counts."""

    def __init__(self, rows: DataFrame, conv_col: str = "conv_id", times: Column | None = None, block: int = BLOCK):
        self.conv_col, self.kind = conv_col, rows.schema[conv_col].dataType
        self.rows = marked(rows, conv_col, times)
        found = stored(faults(self.rows))
        self.tallies = tallies(found)
        blocks, self.illegal = placed(stored(blocks_of(found, block)))
        self.audits = stored(audited(stored(blocks)))

    def _conv(self) -> Column:
        return F.when(F.col("conv") != "n", F.substring("conv", 2, 1 << 30)).cast(self.kind).alias(self.conv_col)

    def _stream(self) -> DataFrame:
        """Audits before the texts they belong to, by conversation and order."""
        texts = self.rows.filter("times > 0").select("conv", "turn", "role", "mark", F.lit(1).alias("kind"), F.lit(-1).cast("long").alias("b"), "text", "times",
                                                     F.lit(None).cast("binary").alias("audit"))
        heads = self.audits.select("conv", F.col("turn").cast(self.rows.schema["turn"].dataType), "role", "mark", F.lit(0).alias("kind"), "b",
                                   F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("times"), "audit")
        order = ["conv", "turn", "role", "mark", "kind", "b"]
        return texts.union(heads).repartition("conv").sortWithinPartitions(*order).select("conv", "role", "kind", "text", "times", "audit")

    def repaired(self) -> DataFrame:
        """(conv_id, position, role, text, edit): the rows that stay, in order. Rows set in have an empty text."""

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for done in _batched((r for r in _edited(frames) if r[-1] != "D"), 512):
                yield pd.DataFrame(done, columns=["conv", "position", "role", "text", "edit"], dtype=object)

        rows = self._stream().mapInPandas(work, "conv string, position long, role string, text string, edit string")
        return rows.select(self._conv(), "position", "role", "text", "edit")

    def digests(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation."""

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, out = None, []
            for conv, _, role, text, edit in _edited(frames):
                if conv != key:
                    if key is not None:
                        out.append((key, audit.decode(), hashed.hexdigest()))
                    key, audit, hashed, between = conv, bytearray(), hashlib.sha256(), ""
                    if len(out) >= 512:
                        yield pd.DataFrame(out, columns=["conv", "audit", "repaired_sha256"])
                        out = []
                audit += edit.encode()
                if edit != "D":
                    hashed.update(f"{between}{role}:{text}".encode("utf-8", "surrogatepass"))
                    between = "\n"
            if key is not None:
                out.append((key, audit.decode(), hashed.hexdigest()))
            yield pd.DataFrame(out, columns=["conv", "audit", "repaired_sha256"])

        done = self._stream().mapInPandas(work, "conv string, audit string, repaired_sha256 string")
        cost = self.audits.filter("b = 0").select("conv", "cost")
        whole = self.tallies.join(self.illegal, "conv", "left").join(cost, "conv", "left").join(done, "conv", "left")
        return whole.select(self._conv(), "gaps", "blank", "duplicate", "truncated", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("illegal", "cost")],
                            F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _edited(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(conv, position, role, text, edit) for every letter of the audits, as the sorted stream passes."""
    key, state, position, letters = None, 0, 0, deque()

    def set_in():
        nonlocal state, position
        while letters and letters[0] == ord("I"):
            letters.popleft()
            role, state = ROLES[PUT[state]], NEXT[state]
            yield key, position, role, "", "I"
            position += 1

    for frame in frames:
        for conv, given, kind, text, times, audit in zip(*[frame[c] for c in frame.columns], strict=True):
            if conv != key:
                yield from set_in()
                key, state, position = conv, 0, 0
            if kind == 0:
                letters.extend(audit)
            for _ in range(times):
                yield from set_in()
                edit, role = chr(letters.popleft()), given
                if edit == "R":
                    role, state = ROLES[PUT[state]], NEXT[state]
                elif edit == "K":
                    state = STEP[state, "sua".find(role[:1])]
                yield key, position, role, text, edit
                position += edit != "D"
    yield from set_in()


def _batched(rows: Iterator[tuple], n: int) -> Iterator[list[tuple]]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held
