"""Repeated runs of words, wherever they begin, against a brute force that knows nothing else."""
import random

import pytest

from feedloom.llm import span_dedup

RUN = 50


def kept_runs(before, after):
    """Documents that still hold a run of RUN words which an earlier document was given."""
    seen, out = {}, []
    for d in sorted(before):
        for text, found in ((after[d], True), (before[d], False)):
            words = span_dedup.tokens(text)
            for i in range(len(words) - RUN + 1):
                key = tuple(words[i:i + RUN])
                if found and seen.get(key, d) != d:
                    out.append(d)
                    break
                if not found:
                    seen.setdefault(key, d)
    return out


def all_repeats(texts):
    """Document -> the words that stay when only runs of RUN words are known."""
    first, out = {}, {}
    for d in sorted(texts):
        words = texts[d].lower().split()
        gone = [False] * len(words)
        for i in range(len(words) - RUN + 1):
            doc, at = first.setdefault(tuple(words[i:i + RUN]), (d, i))
            if doc < d or i - at >= RUN:
                gone[i:i + RUN] = [True] * RUN
        out[d] = [w for w, g in zip(words, gone, strict=True) if not g]
    return out


def removed(docs, **more):
    return {r["doc_id"]: r["text"] for r in span_dedup.remove_repeats(docs, run=RUN, **more).collect()}


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def passages(rng, sentence):
    shared, texts = [words(rng, n) for n in (50, 60, 75, 200)], {}
    for d in range(60):
        text = words(rng, rng.randrange(30, 200))
        for k in range(sentence - 1, len(text), sentence):
            text[k] += "."
        # Side by side, never one inside the other: what is left on both sides of a removed run is a new neighbourhood.
        middle = len(text) // 2
        for p, k in zip(rng.sample(shared, 2), (rng.randrange(middle, len(text)), rng.randrange(1, middle)), strict=True):
            text[k:k] = p if d % 3 else p[:49]
        texts[d] = " ".join(text)
    return texts


@pytest.mark.parametrize("sentence", [25, 60, 10_000])
def test_passages_inside_sentences_go(spark, documents, sentence):
    texts = passages(random.Random(sentence), sentence)
    got = removed(documents(list(texts.items())))
    assert kept_runs(texts, got) == []
    spans_alone = {r["doc_id"]: r["text"] for r in span_dedup.remove_repeats(documents(list(texts.items()))).collect()}
    assert kept_runs(texts, spans_alone)


def test_runs_alone_against_brute_force(spark, documents):
    """Spans of so many words that there are none: what goes is what repeats, to the word."""
    texts = passages(random.Random(3), 10_000)
    texts[70] = "a b c " * 60
    got = removed(documents(list(texts.items())), words=100_000)
    assert {d: t.split() for d, t in got.items()} == all_repeats(texts)


def test_scripts_without_spaces(spark, documents):
    rng = random.Random(5)
    shared = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(80))
    texts = {1: "\u5f00\u59cb" + shared + "\u3002", 2: "\u53e6\u4e00\u7bc7" + shared + "\u7ed3"}
    got = removed(documents(list(texts.items())))
    assert got == {1: texts[1], 2: "\u53e6\u4e00\u7bc7\u7ed3"}


def test_documents_keep_no_earlier_run(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    after = {d: t or "" for d, t in removed(docs).items()}
    assert kept_runs(before, after) == []
    assert kept_runs(before, before)
