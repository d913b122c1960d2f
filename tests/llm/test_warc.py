import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from feedloom.llm import warc

PAGES = "page_id long, url string, html string"


def round_trip(spark, tmp_path, rows, schema=PAGES, **how):
    path = f"file://{tmp_path}/archives"
    when = F.timestamp_seconds(F.col("page_id") + 1_600_000_000)
    warc.write_archives(spark.createDataFrame(rows, schema), path, when, **how)
    return warc.merge_runs(warc.read_runs(spark, path), range_rows=7)


def test_payloads_come_back_whole(spark, tmp_path):
    texts = ["", "a", "é日本\r\n\r\nWARC/1.1\r\nx", "long " * 200_000, "same", "same", "same", None, "\x00\x01"]
    rows = [(k, f"https://www.Example.org:80/p/{k % 3}?q=A", t) for k, t in enumerate(texts)]
    got = {r["page_id"]: r for r in round_trip(spark, tmp_path, rows).collect()}
    assert len(got) == len(rows)
    for k, t in enumerate(texts):
        payload = (t or "").encode()
        last = max(j for j, u in enumerate(texts) if (u or "") == (t or ""))
        r = got[k]
        assert r["payload_bytes"] == len(payload)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last == k else ("revisit", last))
    # The archives themselves: every response holds its payload, every revisit only its header lines.
    held = {}
    for f in Path(tmp_path, "archives").glob("part-*"):
        for _, head, block in warc.parse(gzip.decompress(f.read_bytes())):
            held[int(head["warc-record-id"][len("<urn:page:"):-1])] = (head["warc-type"], block.partition(b"\r\n\r\n")[2])
    assert held == {k: (got[k]["record_type"], (t or "").encode() if got[k]["record_type"] == "response" else b"")
                    for k, t in enumerate(texts)}


def test_small_payloads_are_responses(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in round_trip(spark, tmp_path, rows, least=3).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, "x"), (1, None, "x"), (1, "a\r\nb", "y"), (None, "http://b", "x"), (2, "http://b", "y"), (None, "c", "own"), (None, "c", "own")]
    got = round_trip(spark, tmp_path, [(*r, "z") for r in rows], PAGES + ", payload string").collect()
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in got) == [
        (0, 1, "revisit", 1), (0, 3, "response", 0), (0, 3, "response", 0), (1, 1, "response", 0), (1, 1, "response", 0), (1, 1, "revisit", 2), (2, 1, "response", 0)]


def test_empty_table(spark, tmp_path):
    assert round_trip(spark, tmp_path, []).count() == 0


def test_index_is_in_global_order(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, rng.choice(["http://a.org/x", f"https://b.{k % 5}.net/{rng.random()}", "http://hot.org/"]), str(k)) for k in range(200)]
    merged = round_trip(spark, tmp_path, rows)
    found = [(r["url_key"], r["captured"], r["page_id"]) for r in merged.collect()]
    assert found == sorted(found) and len(found) == 200
    assert merged.rdd.getNumPartitions() > 10


@pytest.mark.parametrize("sizes", [[], [0], [3], [0, 2], [5, 1, 4], [1] * 7, [2, 0, 9, 3, 3]])
def test_loser_tree(sizes):
    rng = random.Random(sum(sizes))
    runs = [sorted(rng.randrange(10) for _ in range(n)) for n in sizes]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("https://www.Example.org:8080/A/b?Q#frag") == "org,example)/a/b?q"
    assert warc.url_key("http://example.org") == "org,example)/" and warc.url_key("") == ""
