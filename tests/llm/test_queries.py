"""The registered corpus queries against their SQL, or against brute force where SQL cannot say them."""
import collections
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

import compare
import corpus_pipeline
from feedloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    assert not compare.compare(spark, con, name, SF)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def linked(texts, threshold=0.8):
    """Links per document and the least member of its class, all pairs compared."""
    sets = {d: shingles(t) for d, t in texts.items()}
    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    links, parent = collections.Counter(), {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        shared = collections.Counter(o for x in s for o in holders[x] if o > d)
        for o, n in shared.items():
            if n >= threshold * (len(s) + len(sets[o]) - n) - 1e-9:
                links[d] += 1
                links[o] += 1
                a, b = root(d), root(o)
                parent[max(a, b)] = min(a, b)
    return {d: (root(d), links[d]) for d in sets}


def test_ngram_join(spark, texts):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in QUERIES["op1_ngram_join"](spark, SF).collect()}
    assert got == linked(texts)


def encoder():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids + [1]


def check_packing(rows, texts, size=4096):
    ids_of, by_doc, places = encoder(), collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert by_doc.keys() == texts.keys()
    for d, t in texts.items():
        ids = ids_of(t)
        cut = [ids[k:k + size] for k in range(0, len(ids), size)]
        assert sorted(by_doc[d]) == [(k, k * size, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut)]
    for slots in places.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= size
    tokens = sum(length for slots in places.values() for _, length in slots)
    assert len(places) <= 1.05 * tokens / size + 1


def test_packing(spark, texts):
    check_packing(QUERIES["op2_best_fit_packing"](spark, SF).collect(), texts)


def test_token_counts(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op3_token_counts"](spark, SF).collect()}
    want = {d: (len(t.encode()), len(model.encode(t))) for d, t in texts.items()}
    assert got == {d: (b, n, n > 4096) for d, (b, n) in want.items()}


def test_span_dedup(spark, texts):
    """No run of 50 words that an earlier document holds stays, and what loses words shares a span or such a run."""
    from test_span_dedup import brute_force
    from test_span_runs import all_repeats, kept_runs

    got = {r["doc_id"]: r["text"] or "" for r in QUERIES["op5_span_dedup"](spark, SF).collect()}
    assert got.keys() == texts.keys() and kept_runs(texts, got) == [] and kept_runs(texts, texts)
    by_span, by_run = brute_force(texts), all_repeats(texts)
    for d, text in texts.items():
        assert len(got[d].split()) <= min(len(by_span[d]), len(by_run[d]))
        if by_span[d] == text.split() and by_run[d] == text.split():
            assert got[d] == text


def test_language_id_held_out(spark):
    rows = QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert {r["doc_id"]: r["held_out"] for r in rows} == {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in truth}
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in QUERIES["op9_toxicity"](spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(rows[r["doc_id"]], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    # Some labels of this table are wrong on purpose, so recall cannot reach 1.
    assert sum(r["predicted"] for r, t in held if t) >= 0.8 * sum(t for _, t in held)
    assert sum(r["predicted"] for r, t in held if not t) <= 0.02 * len(held)


def test_pipeline(spark):
    """Each stage against what its rule says of its own input."""
    from feedloom.llm import mixing
    from feedloom.llm.queries import mix_settings
    from feedloom.session import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == tables[0].columns
        tables.append(docs)
    given, spoken, once, single, mixed = ({r["doc_id"]: r["text"] for r in t.collect()} for t in tables)
    assert spoken == {d: t for d, t in given.items() if t and any(map(str.isalpha, t))}
    last = {}
    for d, t in spoken.items():
        last[t] = max(d, last.get(t, d))
    assert once == {d: t for t, d in last.items()}
    assert single == {d: t for d, t in once.items() if linked(once)[d][0] == d}
    drawn = {r["doc_id"] for r in mixing.mix(tables[3], **mix_settings()).filter("kept").collect()}
    assert mixed == {d: t for d, t in single.items() if d in drawn} and mixed
    check_packing(corpus_pipeline.STAGES[-1][1](spark, tables[4], SF).collect(), mixed)
    check_packing(corpus_pipeline.run(spark, SF).collect(), mixed)
