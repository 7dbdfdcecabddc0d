"""WARC archives of pages, read back through an index made by an external merge.

Writing: every page becomes one WARC/1.1 record. Of the pages with one and the same payload of at least MIN_SHARED
bytes, that with the smallest page_id is a response, the others are revisits that refer to it. A record ends with two
line ends, which is the line separator of Spark's text writer here, so each part file it writes (gzip) is an archive,
wherever the shared folder lies.

Reading: each archive is parsed by content lengths and gives a capture run, sorted by URL key and time. The runs are
dealt by ranges of (URL key, time, page) and each range merges its k pieces of runs with a loser tree, which gives
capture histories in global order: range i precedes range i + 1, and inside a range each capture follows the last.
A hot host or URL is split between ranges, since page_id is part of the key; no range holds a whole group.

Defined results: null html is an empty payload, null url an empty key; repeated rows give repeated records; rows without
page_id are kept, but never referred to; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chimerant.llm.common import shared_dir

MIN_SHARED = 100
#: Records of one archive at most, so that an archive can be read as a whole.
RECORDS_PER_FILE = 5_000
CRLF = "\r\n"
CAPTURE = "page_id long, url string, url_key string, ts string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"


def url_key(url: str) -> str:
    """The host's labels in reverse, then path and query, all in lower case: com,example,www)/path?query."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].partition(":")[0], rest[cut:] or "/"
    return f"{','.join(reversed(host.split('.')))}){path}".lower()


def records(pages: DataFrame) -> DataFrame:
    """One row per page with the text of its WARC record, without the two line ends after it."""
    base = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("size", F.octet_length("html").cast("long")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    first = base.filter(F.col("size") >= MIN_SHARED).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("origin"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 AND origin IS NOT NULL").drop("copies")
    marked = base.join(first, (F.col("digest") == F.col("d")) & (F.col("size") >= MIN_SHARED), "left")
    revisit = F.col("origin").isNotNull() & (F.col("origin") != F.coalesce("page_id", F.lit(-1)))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_577_836_800) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(100_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    clean = F.regexp_replace("url", r"[\x00-\x20\x7f]", "")
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Target-URI", clean),
        line("WARC-Date", stamp),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Length", F.col("size").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("origin").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("size").cast("string"))),
        F.lit(CRLF),
    )
    return marked.select(F.concat(header, F.when(revisit, "").otherwise(F.col("html"))).alias("value"))


def write_archives(pages: DataFrame, folder: str) -> None:
    records(pages).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def parse_archive(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and payload of each record, by content lengths: what the payload holds doesn't matter."""
    at = 0
    while at < len(raw):
        head = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:head].decode().split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        size = int(fields["Content-Length"])
        yield at, fields, raw[head + 4 : head + 4 + size]
        at = head + 4 + size + 4


def capture(archive: str, offset: int, fields: dict[str, str], payload: bytes) -> dict:
    """The index entry of a record, with its archive and the offset in that; a response's payload is checked against its digest."""
    number = lambda name: int(x) if (x := fields.get(name, "")[len("<urn:page:") : -1]) else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": number("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "url_key": url_key(fields["WARC-Target-URI"]), "ts": fields["WARC-Date"],
        "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "archive": archive, "offset": offset,
    }


def order(row: dict) -> tuple:
    return row["url_key"], row["ts"], -1 if row["page_id"] is None else row["page_id"]


class LoserTree:
    """Merges k sorted iterators; each inner node keeps the loser of its match, so an item costs log2(k) comparisons."""

    END = (1,)

    def __init__(self, runs: list[Iterable], key):
        self.its, self.key = [iter(r) for r in runs], key
        self.k = len(self.its)
        self.heads = [self._pull(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _pull(self, i: int) -> tuple:
        item = next(self.its[i], None)
        return (self.END, i, None) if item is None else ((0, self.key(item)), i, item)

    def _beats(self, a: int, b: int) -> bool:
        return a == -1 or (b != -1 and self.heads[a][:2] < self.heads[b][:2])

    def _replay(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            if self._beats(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and self.heads[w := self.losers[0]][0] is not self.END:
            yield self.heads[w][2]
            self.heads[w] = self._pull(w)
            self._replay(w)


def read_runs(spark, folder: str) -> DataFrame:
    """Captures of all archives, each archive's a sorted run: (run, seq) tell run and place."""
    schema = f"run string, seq long, {CAPTURE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema([("run", pa.string()), ("seq", pa.int64()), *((n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in CAPTURE.split(", ")))])
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                name = path.as_py().rsplit("/", 1)[-1]
                found = sorted((capture(name, *r) for r in parse_archive(zlib.decompress(content.as_py(), 47))), key=order)
                yield pa.RecordBatch.from_pylist([{"run": path.as_py(), "seq": i} | c for i, c in enumerate(found)], target)

    return spark.read.format("binaryFile").load(f"{folder}/*.txt.gz").select("path", "content").mapInArrow(run, schema)


def read_record(content: bytes, offset: int) -> tuple[dict[str, str], bytes]:
    """Headers and payload of the record at an offset that the index gives, from an archive's bytes as written."""
    return next(parse_archive(zlib.decompress(content, 47)[offset:]))[1:]


def merge_runs(runs: DataFrame) -> DataFrame:
    """Globally ordered captures. A range is held as columns; only the keys of its rows become objects."""
    dealt = runs.repartitionByRange(F.col("url_key"), F.col("ts"), F.coalesce("page_id", F.lit(-1))).sortWithinPartitions("run", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        rows = pa.Table.from_batches(tables).combine_chunks()
        run_of, url, ts, page = (rows.column(c) for c in ("run", "url_key", "ts", "page_id"))
        names = run_of.dictionary_encode().combine_chunks().indices.to_numpy()
        begins = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        key = lambda i: (url[i].as_py(), ts[i].as_py(), -1 if (p := page[i].as_py()) is None else p)
        merged = np.fromiter(LoserTree([range(a, b) for a, b in zip(begins, begins[1:], strict=False)], key), np.int64, len(names))
        out = rows.drop_columns(["run", "seq"])
        for at in range(0, len(merged), 10_000):
            yield from out.take(pa.array(merged[at : at + 10_000])).combine_chunks().to_batches()

    return dealt.mapInArrow(run, CAPTURE)


def archive_and_index(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder, read them back and return the merged captures."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    return merge_runs(read_runs(spark, folder))
