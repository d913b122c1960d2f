"""WARC archives: write captures, read them back, and merge their indexes into one ordered by URL key and time.

Of captures with equal payloads the one with the largest id is written as a response; the others are revisits that refer
to it and repeat its digest and length. Archives are written by Spark's text writer, one record after the other with the
two line ends that close a record between them, and compressed. Reading parses each archive, checks every payload against
its digest and sorts the archive's captures: a run. Runs are cut at common key ranges, and each range is merged by a
loser tree, so that the parts of the index in order are the whole history in order. A range is cut inside a URL too, so
one URL with a third of all captures is shared out.

Null payloads are empty, null times are the epoch, null URLs leave out their header and have the empty key. Rows that repeat an id with the same
payload are written alike, each as its own record. Payloads below ``least`` bytes are always responses.

Empty tables give no rows and other columns may have any name; captures equal in key, time and id stand side by side.
"""
from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedloom.llm.common import rows_frame
from feedloom.session import stored

#: Uncompressed bytes an archive holds, about; captures in a range of the merged index, about.
ARCHIVE_BYTES, RANGE_ROWS = 48 << 20, 100_000
#: Fixed values of the format.
CRLF = "\r\n"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CAPTURE_SCHEMA = ("url_key string, captured string, page_id long, url string, record_type string, payload_bytes long, "
                  "payload_digest string, refers_to long, archive string, at long, run string, place long")
CAPTURE_COLUMNS = tuple(f.split()[0] for f in CAPTURE_SCHEMA.split(", "))


def base32_sha1(payload: Column) -> Column:
    """Base32 of the SHA-1: ten hex digits are eight digits to the base 32, spelled in another alphabet."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def shared_payloads(pages: DataFrame, least: int) -> DataFrame:
    """(sha, keep): payloads of several captures, and the greatest id among them. Slim rows only, summed on the map side."""
    slim = pages.select("page_id", F.sha2("payload", 256).alias("sha"), F.length("payload").alias("bytes"))
    return slim.filter(F.col("bytes") >= least).groupBy("sha").agg(
        F.max("page_id").alias("keep"), F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter(
        "first < keep or n > 1 and keep is not null").select("sha", "keep")


def plan_records(pages: DataFrame, groups: DataFrame) -> DataFrame:
    """(page_id, keeps): for ids whose captures revisit others, the response by payload digest."""
    slim = pages.select("page_id", F.sha2("payload", 256).alias("sha"))
    again = slim.join(groups, "sha").filter("page_id < keep")
    return again.groupBy("page_id").agg(F.map_from_entries(F.collect_set(F.struct("sha", "keep"))).alias("keeps"))


def records(pages: DataFrame, least: int, archives: int) -> DataFrame:
    """(page_id, value): one record per capture, without its closing line ends, in as many partitions as archives.

    Payloads move once: they are dealt to archives by id, and the join takes them as they lie. Captures without an id, if
    there are any, find their response by digest and make archives of their own.
    """
    groups = shared_payloads(pages, least)
    revisits = plan_records(pages, groups)
    named, unnamed = pages.filter("page_id is not null"), pages.filter("page_id is null")
    joined = named.repartition(archives, "page_id").join(revisits, "page_id", "left").withColumn(
        "keep", F.try_element_at("keeps", F.sha2("payload", 256))).drop("keeps")
    if not unnamed.isEmpty():
        found = unnamed.withColumn("sha", F.sha2("payload", 256)).join(groups, "sha", "left")
        joined = joined.unionByName(found.drop("sha"))
    size = F.length("payload").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(RECORD_END))
    again = F.col("keep").isNotNull()
    body = F.when(again, F.lit("")).otherwise(F.col("payload").cast("string"))
    # A line end inside a URL would end its header.
    url = F.regexp_replace("url", r"[\r\n\x00]", "")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f">{CRLF}WARC-Date: "), F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.coalesce(F.concat(F.lit(f"{CRLF}WARC-Target-URI: "), url), F.lit("")),
        F.when(again, F.concat(F.lit(f"{CRLF}WARC-Profile: {REVISIT_PROFILE}{CRLF}WARC-Refers-To: <urn:page:"),
                               F.col("keep").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), base32_sha1(F.col("payload")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        (F.length(http.cast("binary")) + F.length(body.cast("binary"))).cast("string"), F.lit(RECORD_END))
    return joined.select("page_id", F.concat(head, http, body).alias("value"))


def write_archives(pages: DataFrame, path: str, captured: Column, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", least: int = 0) -> None:
    """Write one record per row into compressed archives under ``path``."""
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(captured, F.timestamp_seconds(F.lit(0))).alias("captured"),
                        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    total = slim.agg(F.sum(F.length("payload") + 512)).first()[0] or 0
    records(slim, least, int(total // ARCHIVE_BYTES) + 1).select("value").write.option(
        "lineSep", RECORD_END).option("compression", "gzip").text(path)


_KEY = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\d*\.)?([^/?#:]*)(?::\d+)?([^#]*)", re.I)


def url_key(url: str) -> str:
    """Host labels from the right, then the path and query in lower case: pages of a site sort together."""
    found = _KEY.match(url.strip())
    if not found:
        return url.strip().lower()
    return ",".join(reversed(found[1].lower().split("."))) + ")" + (found[2].lower() or "/")


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of every record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogateescape").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        begin, length = end + 4, int(headers["content-length"])
        if data[begin + length:begin + length + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is not closed")
        yield at, headers, data[begin:begin + length]
        at = begin + length + 4


def capture(archive: str, at: int, headers: dict[str, str], block: bytes) -> tuple:
    """One row of a run; the payload of a response must have the digest its header names."""
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    digest = headers["warc-payload-digest"].partition(":")[2]
    kind = headers["warc-type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the payload at {at} in {archive} is damaged")
    name = headers["warc-record-id"][len("<urn:page:"):-1]
    refers = headers.get("warc-refers-to", "")[len("<urn:page:"):-1]
    url = headers.get("warc-target-uri")
    return (url_key(url or ""), headers["warc-date"], int(name) if name else None, url, kind, size, digest,
            int(refers) if refers else None, archive, at)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives, each archive sorted by URL key, time and id: its run."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, content in zip(frame["path"], frame["content"], strict=True):
                name = archive.rpartition("/")[2]
                found = [capture(name, *r) for r in parse(zlib.decompress(content, 31))]
                found.sort(key=order_of)
                rows = [(*c, name, k) for k, c in enumerate(found)]
                yield rows_frame(rows, CAPTURE_COLUMNS)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInPandas(
        work, CAPTURE_SCHEMA)


def order_of(c: Sequence) -> tuple:
    """URL key, time and id; an unknown id comes first."""
    return c[0], c[1], -1 if c[2] is None else c[2], c[8], c[9]


class LoserTree:
    """k-way merge of sorted lists: each inner node keeps the loser of its match, so the next winner takes one match per
    level on the path of the last one."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key = runs, key
        self.at = [0] * len(runs)
        self.k = max(1, len(runs))
        self.heads = [key(r[0]) if r else None for r in runs]
        self.losers = [-1] * self.k
        self.winner = self._play(1)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._before(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head comes first; a run that is used up loses against all."""
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x <= y)

    def __iter__(self):
        while self.runs and self.heads[self.winner] is not None:
            run = self.winner
            row = self.runs[run][self.at[run]]
            self.at[run] += 1
            self.heads[run] = self.key(self.runs[run][self.at[run]]) if self.at[run] < len(self.runs[run]) else None
            node, win = (run + self.k) // 2, run
            while node >= 1:
                if self._before(self.losers[node], win):
                    self.losers[node], win = win, self.losers[node]
                node //= 2
            self.winner = win
            yield row


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in order of URL key, time and id, over the partitions and inside them."""
    runs = stored(runs)
    ranges = -(-max(1, runs.count()) // range_rows)
    by_range = runs.repartitionByRange(ranges, "url_key", "captured", F.col("page_id").asc_nulls_first(), "archive", "at")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists: dict[str, list] = {}
        for frame in frames:
            ids = {c: [None if x is None else int(x) for x in frame[c]] for c in ("page_id", "refers_to")}
            for row in zip(*(ids.get(c, frame[c]) for c in CAPTURE_COLUMNS), strict=True):
                lists.setdefault(row[10], []).append(row)
        merged = list(LoserTree(list(lists.values()), order_of))
        if merged:
            yield rows_frame(merged, CAPTURE_COLUMNS)

    # Ids pass through Python as text, so that a null among them does not turn them into floats.
    texts = by_range.sortWithinPartitions("run", "place").withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return texts.mapInPandas(work, CAPTURE_SCHEMA)
