"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""
import collections

import pytest
import public_tokenizers
from pyspark.sql import functions as F

from feedloom.llm import chunk_dedup, langid, mixing, ngram_join, packing, span_dedup, token_counts, topk, toxicity
from feedloom.llm.common import fold
from feedloom.llm.queries import mix_settings

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = "An endless line of words without a stop, " * 9000
EN, FR = "The cat and the dog went to the house with them.", "Le chat et le chien sont dans la maison avec nous."
ROWS = [(None, "A text without an id.", "en", None, 1), (1, None, None, "s", None), (2, "", "fr", "s", 0), (3, LONG, "en", "t", 5),
        (4, EN * 3, "en", "s", 9), (4, EN * 3, "en", "s", 9), (5, EN * 3, "en", None, 9), (6, FR, "fr", "t", 9), (7, FR, "fr", "t", 9),
        (8, "12345 !!! ...", None, "u", 1), (9, "  \t\n ", "en", "u", 1), (10, "x", "fr", "u", 1)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("row id slice hash keep_id text_sha256 class_id label doc mark begin piece length probability kept weight topic h rank "
            "size run key value tokens chunk recipe variants bucket block links root n sig score lang_pred n_removed predicted").split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def crowded(docs):
    """The same rows with columns named like the operators' own."""
    return docs.withColumns({c: F.lit(c) for c in CLASHING})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


TABLES = {
    "exact_dedup": lambda s, d: chunk_dedup.exact_dedup(d),
    "ngram_join": lambda s, d: ngram_join.ngram_join(d),
    "pack": lambda s, d: packing.pack(d, WORDS),
    "count_tokens": lambda s, d: token_counts.count_tokens(d, PIECES),
    "mix": lambda s, d: mixing.mix(d, **mix_settings()),
    "span_dedup": lambda s, d: span_dedup.remove_repeats(d).select("doc_id", "text", "n_removed"),
    "identify": lambda s, d: langid.identify(d, fold("doc_id", 4) != 2).select("doc_id", "lang_pred", "score", "ambiguous"),
    "toxicity": lambda s, d: toxicity.score(d, labels(s, [(4, 1, 1), (6, 1, 0), (None, 1, 1), (5, None, None)])).select(
        "doc_id", "score", "predicted"),
}
STAGES = {
    "keep_identified": lambda d: langid.keep_identified(d, fold("doc_id", 4) != 2),
    "keep_first_texts": chunk_dedup.keep_first_texts,
    "keep_one": ngram_join.keep_one,
    "sample": lambda d: mixing.sample(d, **mix_settings()),
    "remove_repeats": lambda d: span_dedup.remove_repeats(d),
}


def bag(df):
    return collections.Counter(tuple(map(str, r)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(TABLES))
def test_clashing_columns_change_nothing(spark, docs, crowded, name):
    plain = bag(TABLES[name](spark, docs))
    assert plain == bag(TABLES[name](spark, crowded))
    assert sum(plain.values()) >= len(ROWS)


@pytest.mark.parametrize("name", sorted(TABLES))
def test_empty_table(spark, nothing, name):
    assert TABLES[name](spark, nothing).count() == 0


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_keep_all_columns(crowded, nothing, name):
    out = STAGES[name](crowded)
    assert sorted(set(out.columns)) == sorted(crowded.columns)
    assert out.count() > 0
    assert STAGES[name](nothing).count() == 0


def test_exact_dedup_rows(docs):
    got = collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in chunk_dedup.exact_dedup(docs).collect())
    assert got == collections.Counter([
        (None, None, 1, True), (1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 5, 3, False), (4, 5, 3, False), (5, 5, 3, True),
        (6, 7, 2, False), (7, 7, 2, True), (8, 8, 1, True), (9, 9, 1, True), (10, 10, 1, True)])


def test_repeated_rows_become_one(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in chunk_dedup.keep_first_texts(twice).collect()) == [(1, "a"), (2, "b"), (2, "c")]
    assert sorted((r["doc_id"], r["kept"]) for r in chunk_dedup.exact_dedup(twice).collect()) == [
        (1, False), (1, True), (2, True), (2, True)]


@pytest.mark.parametrize("texts", [["ab", "cd", "ab", "abc"], ["x" * 9000, "x" * 8999 + "y", "x" * 9000], ["a. b\n" * 400, "a. b\n" * 399 + "a. c\n"]])
def test_shared_hashes_are_told_apart(spark, texts):
    """With the length as hash, different chunks share identifiers until their contents are compared."""
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["keep_id"] for r in chunk_dedup.exact_dedup(rows, ident=lambda c: F.length(c).cast("long")).collect()}
    assert got == {k: max(j for j, u in enumerate(texts) if u == t) for k, t in enumerate(texts)}


def test_chunks_join_to_the_text(spark):
    texts = [LONG, "", "no end", "One. Two! Three?\n\n" * 300, "日本。" * 4000, "😀" * 9000]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", chunk_dedup.chunks(F.col("text")).alias("c")).collect()
    assert all("".join(r["c"]) == r["text"] for r in rows)
    assert max(len(c) for r in rows for c in r["c"]) <= chunk_dedup.MOST


def test_ngram_join_rows(docs):
    got = collections.Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(docs).collect())
    assert got == collections.Counter([
        (None, None, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 2), (4, 4, 2), (5, 4, 2), (6, 6, 1), (7, 6, 1), (8, 8, 0), (9, 9, 0),
        (10, 10, 0)])


def test_languages_of_odd_texts(docs):
    got = {(r["doc_id"]): (r["lang_pred"], r["score"]) for r in langid.identify(docs, F.lit(True)).collect()}
    assert all(got[d] == ("und", 0.0) for d in (1, 2, 8, 9))
    assert got[4][0] == got[3][0] == "en" and got[6][0] == got[7][0] == "fr"


def test_no_language_or_one_to_learn(spark, docs):
    none = {r["lang_pred"] for r in langid.identify(docs, F.lit(False)).collect()}
    assert none == {"und"}
    one = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, F.col("lang") == "fr").collect()}
    assert one[4] == ("fr", 1.0) and one[2] == ("und", 0.0)


def test_no_labels(spark, docs):
    assert {(r["score"], r["predicted"]) for r in toxicity.score(docs, labels(spark)).collect()} == {(0.0, 0)}


def test_mixing_meets_its_targets(spark):
    rows = [(k, "w " * (5 + k % 7), ("en", "fr", None)[k % 3 if k % 5 else 0], f"s{k % 4 if k % 3 else 0}", 1) for k in range(4000)]
    dims = {"source": F.col("source"), "lang": F.col("lang")}
    wanted = {"source": {"s0": 0.4, "s1": 0.2, "s2": 0.2, "s3": 0.2}, "lang": {"en": 0.5, "fr": 0.3, "": 0.2}}
    got = mixing.mix(spark.createDataFrame(rows, DOCS), dims, F.length("text"), {d: mixing.shares(s) for d, s in wanted.items()}).toPandas()
    expected = got["weight"] * got["probability"]
    for d, target in wanted.items():
        share = expected.groupby(got[d]).sum() / expected.sum()
        assert all(abs(share[v] - s) < 1e-3 for v, s in target.items())
    assert got["probability"].max() == 1
    kept = got[got["kept"]]
    assert abs((kept["weight"].sum() / expected.sum()) - 1) < 0.1


def test_top_k_rows(spark):
    vectors = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (50, [0.5, 0.5]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (4, None), (5, [float("nan"), 1.0]),
               (6, [1.0, None]), (7, [float("inf"), 0.0]), (None, [1.0, 1.0]), (8, [1.0, 0.0, 0.0]), (9, [-1.0, 0.001])]
    got = topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, k=3).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])) if r["query_id"] == 0] == [
        (1, 2, 65536), (2, 3, 65536), (3, 50, 32768)]
    # Both rows of id 50 ask, and each finds the other.
    assert collections.Counter((r["vec_id"], r["score"]) for r in got if r["query_id"] == 50) == {
        (0, 32768): 2, (2, 32768): 2, (3, 32768): 2}
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_top_k_bounds_drop_no_candidate():
    import numpy as np

    rng = np.random.default_rng(7)
    for dims in (1, 15, 16, 17, 100):
        data = np.floor(rng.normal(size=(500, dims)) * (1 + 200 * (np.arange(dims) < 4)))
        for query in (data[3], np.zeros(dims), data[7] * 5):
            alive, score = topk.best(query, np.ascontiguousarray(data.T), 5, 3)
            want = sorted((-int(data[k] @ query), k) for k in range(500) if k != 3)[:5]
            assert sorted(zip(-score.astype(int), alive))[:5] == want


@pytest.mark.parametrize("counts", [{}, {4096: 3}, {1: 100000}, {4096: 2, 2048: 3, 2047: 3, 1: 5, 1365: 7}, {3000: 5, 1000: 9, 96: 40}])
def test_plan_places_every_piece_once(counts):
    ends, plan = collections.Counter(), packing.best_fit(counts, 4096)
    spans = collections.defaultdict(list)
    for length, a, b, first, each, offset in plan:
        assert a == ends[length] and b > a
        ends[length] = b
        for r in range(b - a):
            spans[first + r // each].append((offset + r % each * length, length))
    assert +ends == collections.Counter(counts)
    for slots in spans.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(plan) <= 4 * len(counts) + 1
