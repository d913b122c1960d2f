"""Class-based scoring against a plain version with dictionaries, and what a language model must hold to."""
import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import class_lm
from feedloom.llm.common import fold
from feedloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SMALL = {"n_classes": 4, "rounds": 3, "exchanged": 12, "table": 20}


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def likelihood(pairs):
    h = lambda x: sum(v * math.log(v) for v in np.ravel(x) if v > 0)
    return h(pairs) - h(pairs.sum(axis=0)) - h(pairs.sum(axis=1))


def plain_model(texts, n_classes, rounds, exchanged, table):
    """word -> (n, class), transitions, all by loops; ``exchange`` alone is the library's and tested by itself."""
    streams = [["", *plain_words(t), ""] for t in texts]
    counts = collections.Counter(w for s in streams for w in s[1:])
    scale = collections.Counter(math.floor(math.log2(n) * 64) for w, n in counts.items() if w)
    fits = [s for s in scale if sum(n for o, n in scale.items() if o >= s) <= exchanged]
    top = sorted((w for w in counts if w and math.floor(math.log2(counts[w]) * 64) in fits), key=lambda w: (-counts[w], w.encode()))
    number = {w: k for k, w in enumerate(top)}
    number[""] = len(top) + 1
    of = lambda w: number.get(w, len(top))
    classes, width = np.array([*[k % n_classes for k in range(len(top))], n_classes, n_classes + 1]), n_classes + 2

    def near():
        out = np.zeros((len(classes), 2, width), dtype=np.int64)
        for s in streams:
            for a, b in zip(s[:-1], s[1:]):
                out[of(b), 0, classes[of(a)]] += 1
                out[of(a), 1, classes[of(b)]] += 1
        return out

    for k in range(rounds):
        classes = class_lm.exchange(near(), classes, n_classes, np.arange(len(top)) if k == 0 else np.arange(k % 2, len(top), 2))
    bigrams = class_lm.class_pairs(near(), classes)
    final = {w: int(classes[k]) for w, k in number.items() if w}
    around = collections.defaultdict(list)
    for s in streams:
        for a, w, b in zip(s[:-2], s[1:-1], s[2:]):
            if w not in number:
                around[w].append((classes[of(a)], classes[of(b)]))
    for w, pairs in around.items():
        gain = [sum(math.log(bigrams[a, c] + 0.5) + math.log(bigrams[c, b] + 0.5) for a, b in pairs)
                - 2 * len(pairs) * math.log(bigrams[:, c].sum() + 1) for c in range(n_classes)]
        final[w] = int(np.argmax(np.round(gain, 9)))
    final[""] = n_classes
    steps = np.zeros((n_classes + 1,) * 2)
    for s in streams:
        for a, b in zip(s[:-1], s[1:]):
            steps[final[a], final[b]] += 1
    return counts, final, steps


def plain_scores(texts, model, n_classes):
    counts, final, steps = model
    total, kinds = sum(counts.values()), len(counts)
    ones, twos = (sum(v == k for v in counts.values()) for k in (1, 2))
    give = (ones + 1) / (ones + 1 + 2 * (twos + 1))
    size, members = collections.Counter(), collections.Counter(final.values())
    for w, c in final.items():
        size[c] += counts[w]
    pull = n_classes + 1
    step = lambda a, b: (steps[a, b] + pull * size[b] / total) / (steps[a].sum() + pull)
    for text in texts:
        before, base, score, known = n_classes, 0.0, 0.0, 0
        for w in [*plain_words(text), ""]:
            base += math.log10((counts[w] + 1) / (total + kinds + 1))
            if counts[w]:
                known += 1
                now = final[w]
                score += math.log10(step(before, now)) + (math.log10((counts[w] - give) / size[now]) if w else 0)
            else:
                odds = [step(before, c) * give * members[c] / max(size[c], 1) / (ones ** 2 / (2 * twos + 1) + 1) for c in range(n_classes)]
                now = int(np.argmax(odds))
                score += math.log10(odds[now])
            before = now
        yield len(plain_words(text)) + 1, known, base, score


def corpus(rng):
    a, b = [f"le{k}" for k in range(25)], [f"The{k}" for k in range(25)]
    make = lambda kind, n: " ".join(rng.choices(kind, weights=[1 / (k + 1) for k in range(25)], k=n))
    texts = [make(rng.choice([a, b]), rng.randrange(0, 30)) for _ in range(120)]
    return texts + [None, "", " \t\n", "ÉTÉ  x y\x0bz\x0c", "one\x1ctwo never\x85seen", make(a, 4000)]


def test_against_plain_version(spark, documents):
    texts = corpus(random.Random(2))
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in class_lm.score(documents(rows).repartition(5), fold("doc_id", 7) != 2, **SMALL).collect()}
    learn = {d: zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in rows}
    model = plain_model([t for d, t in rows if learn[d]], **SMALL)
    want = dict(zip(range(len(texts)), plain_scores(texts, model, SMALL["n_classes"])))
    assert len(got) == len(rows) and {r["train_tokens"] for r in got.values()} == {sum(model[0].values())}
    for d, (n, known, base, score) in want.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"]) == (not learn[d], n, known)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)
        assert math.isclose(r["perplexity"], 10 ** (-score / n), rel_tol=1e-7)


def test_exchange_raises_the_likelihood():
    """With no stale counts (one word moves) the class found is the best of all, counted anew."""
    rng = random.Random(4)
    stream = [0] + [rng.choice([1, 2, 3, 4, 5, 6]) for _ in range(400)] + [0]
    classes, width = np.array([6, 0, 1, 2, 0, 1, 2]), 8
    stream = [s if rng.random() < 0.3 else (s % 2) * 3 + 1 if s else 0 for s in stream]
    for w in range(1, 7):
        plain = [x for x in stream]
        # No word stands beside itself, so that its own counts are no neighbours of its own.
        plain = [x for k, x in enumerate(plain) if not k or x != plain[k - 1] or x != w]
        def table(c):
            out = np.zeros((7, 2, width), dtype=np.int64)
            for a, b in zip(plain[:-1], plain[1:]):
                out[b, 0, c[a]] += 1
                out[a, 1, c[b]] += 1
            return out
        best = class_lm.exchange(table(classes), classes, 3, np.array([w]))
        scores = []
        for c in range(3):
            tried = classes.copy()
            tried[w] = c
            scores.append(likelihood(class_lm.class_pairs(table(tried), tried)))
        assert scores[best[w]] >= max(scores) - 1e-9


def test_probabilities_add_up_to_one():
    model = class_lm.Model(50, 11, 4, 3, np.array([20.0, 20, 10]), np.array([6, 4, 1]), np.array([[5.0, 12, 3], [9, 4, 7], [6, 4, 0]]))
    step, (_, unseen) = 10 ** model.transitions(), model.unseen()
    assert np.allclose(step.sum(axis=1), 1)
    for before in range(3):
        words = sum(step[before, c] * (model.sizes[c] - model.discount * model.members[c]) / model.sizes[c] for c in range(2))
        kinds = model.ones ** 2 / (2 * model.twos + 1) + 1
        assert words + step[before, 2] + kinds * 10 ** unseen[before] <= 1 + 1e-9


def test_edges(spark, documents):
    assert class_lm.score(documents([]), F.lit(True), **SMALL).count() == 0
    rows = [(None, "a b"), (1, None), (1, "a b"), (1, "a b"), (2, ""), (3, "a " * 30_000)]
    crowded = documents(rows).withColumns({c: F.lit(c) for c in ("id", "learn", "data", "row", "word", "n", "m", "class", "code", "score", "s")})
    got = class_lm.score(crowded, F.lit(True), **SMALL).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"]) for r in got) == [
        ("1", 1, 1), ("1", 3, 3), ("1", 3, 3), ("2", 1, 1), ("3", 30_001, 30_001), ("None", 3, 3)]
    nothing = class_lm.score(documents(rows), F.lit(False), **SMALL).collect()
    assert {(r["base_score"], r["score"], r["n_known"], r["train_tokens"]) for r in nothing} == {(0.0, 0.0, 0, 0)}
    empty = class_lm.score(documents([(1, None), (2, ""), (3, "x y")]), F.col("doc_id") < 3, **SMALL).collect()
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in empty)
    with pytest.raises(ValueError):
        class_lm.score(documents(rows), F.lit(True), n_classes=251)


def test_query(spark):
    """Base scores by plain counting, and a better score than the base on texts it did not learn from."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op13_class_lm"](spark, SF).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    counts = collections.Counter(w for d, t in texts.items() if not held[d] for w in [*plain_words(t), ""])
    total, kinds = sum(counts.values()), len(counts)
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        words = [*plain_words(t), ""]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words)
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(words), sum(counts[w] > 0 for w in words), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
    for part in (True, False):
        rows = [got[d] for d in texts if held[d] == part]
        assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
