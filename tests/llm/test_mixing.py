"""Sampling to a stated size."""
import pytest
from pyspark.sql import functions as F

from feedloom.llm import mixing

TARGETS = {"source": mixing.tempered(0.7), "lang": mixing.tempered(0.8)}


def dims():
    return {"source": F.col("source"), "lang": F.col("lang")}


def rows():
    return [(k, "w " * (50 + k % 70), ("en", "fr")[k % 5 == 0], f"s{min(k % 7, 3)}") for k in range(3000)]


@pytest.mark.parametrize("rare", [(9000, "w", "en", None), (9000, "w " * 100, None, None)])
def test_one_rare_row_scales_no_other(spark, documents, rare):
    def drawn(extra):
        return mixing.mix(documents(rows() + extra), dims(), F.length("text"), TARGETS, size=0.5).toPandas()

    without, with_rare = drawn([]), drawn([rare])
    for got in (without, with_rare):
        assert abs((got["weight"] * got["probability"]).sum() / got["weight"].sum() - 0.5) < 0.005
    assert with_rare["probability"].max() <= 1
    both = without.merge(with_rare, on="doc_id")
    assert ((both["probability_x"] - both["probability_y"]).abs() < 0.01).all()
    # The rare row's target is beyond its mass, so it stays.
    assert with_rare.set_index("doc_id").loc[9000, "kept"]


def test_what_cannot_be_reached_is_told(spark, documents):
    docs = documents([*rows(), (9000, "w", "en", None)])
    wanted = {"source": mixing.shares({"s0": 0.3, "s1": 0.3, "s2": 0.2, "s3": 0.1, "": 0.1}), "lang": mixing.tempered(1.0)}
    got = {(r["dimension"], r["value"]): r for r in mixing.reach(docs, dims(), F.length("text"), wanted, 0.2).collect()}
    mass = sum(r["seen"] for (d, _), r in got.items() if d == "lang")
    assert got["source", ""]["seen"] == got["source", ""]["expected"] == 1
    assert abs(got["source", ""]["wanted"] - 0.02 * mass) < 1
    for value, share in {"s0": 0.3, "s1": 0.3, "s2": 0.2, "s3": 0.1}.items():
        # The others take what the rare value leaves.
        assert abs(got["source", value]["expected"] / (0.2 * mass) - share / 0.9) < 0.002


@pytest.mark.parametrize("size", [0, 1.5])
def test_sizes_are_shares(spark, documents, size):
    with pytest.raises(ValueError):
        mixing.mix(documents(rows()), dims(), F.length("text"), TARGETS, size=size)


def test_query_with_one_rare_row(spark, tmp_path):
    """The registered query: a one-token row of a new source leaves what the others keep."""
    from feedloom.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.union(spark.createDataFrame([(10**9, "w", "en", "new", 1)], docs.schema)).write.parquet(f"{tmp_path}/b/documents.parquet")
    kept = [{r["doc_id"] for r in QUERIES["op4_mix_sources"](spark, f"{tmp_path}/{x}").filter("kept").collect()} for x in "ab"]
    assert len(kept[0] ^ (kept[1] - {10**9})) <= 5 and len(kept[0]) > 400
