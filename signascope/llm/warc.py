"""WARC archives: write one record per page, read them back, merge the capture indexes.

Writing is plain Spark: a row's record is ``headers + CRLF CRLF + payload`` and the text writer ends it
with CRLF CRLF, which is how a WARC record ends.  Reading takes whole archives (``binaryFile``; their size is
bounded by ``records_per_file``) and walks them by Content-Length, so payloads that hold WARC headers are safe.

Every archive gives one capture run sorted by (URL key, timestamp, page).  The runs are dealt out by range of
that key and each range is merged by a loser tree; the ranges in order are the global capture history.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signascope.llm.common import scratch

SCHEMA = (
    "url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, url string, run string, offset long"
)
FIELDS = [
    ("url_key", pa.string()), ("captured_at", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
    ("run", pa.string()), ("offset", pa.int64()),
]
ARROW = pa.schema(FIELDS)


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host labels reversed, lower case, no scheme, ``www`` or fragment."""
    if not url:
        return ""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", url.strip(), flags=re.I).split("#")[0]
    host, slash, path = rest.partition("/")
    host = host.rpartition("@")[2].lower()
    name, _, port = host.partition(":")
    labels = [x for x in name.split(".") if x]
    if labels[:1] == ["www"]:
        labels = labels[1:]
    return ",".join(reversed(labels)) + (f":{port}" if port and port != "80" else "") + ")" + slash + path


def duplicate_payloads(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(digest, first_page) of payloads of at least ``min_bytes`` that several pages hold."""
    return (
        pages.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first_page is not null")
        .select("payload_digest", "first_page")
    )


def records(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """One column ``value``: the WARC record of each row of ``pages`` (page_id, url, html).

    Null html is an empty payload, a null url an empty target, a null page_id a record without an id header.
    Of equal payloads of at least ``min_bytes`` the smallest page_id is the response; others, and rows
    without an id, revisit it.  Repeated rows of the smallest page_id are all responses.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long"), F.coalesce(F.col("url"), F.lit("")).alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(F.encode(html, "UTF-8"), 256).alias("payload_digest"),
    )
    firsts = duplicate_payloads(rows.drop("html", "url"), min_bytes)
    rows = rows.join(firsts, "payload_digest", "left")
    revisit = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    safe_url = F.regexp_replace("url", r"[\r\n]", "")
    when = F.date_format(F.timestamp_seconds(F.lit(1577836800) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"), F.lit(">")), F.lit("")),
        F.lit("\r\nWARC-Target-URI: "), safe_url, F.lit("\r\nWARC-Date: "), when,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("first_page").cast("string"), F.lit(">\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"))).otherwise(""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string")),
        F.lit("\r\n\r\n"),
    )
    return rows.select(F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("html"))).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 100, records_per_file: int = 500) -> None:
    """Write gzip-compressed WARC files under ``path``; ``records_per_file`` bounds what a reader holds."""
    (
        records(pages, min_bytes).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file)
        .option("compression", "gzip").text(path)
    )


def parse_archive(data: bytes) -> Iterator[tuple[int, dict[str, str], memoryview]]:
    """(offset, headers, body) of each record; raises ValueError on a broken archive."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.1\r\n", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in data[at + 10 : end].decode().split("\r\n"))
        start = end + 4
        stop = start + int(head["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield at, head, view[start:stop]
        at = stop + 4


def _page(ref: str | None) -> int | None:
    return int(ref.removeprefix("<urn:page:").removesuffix(">")) if ref else None


def captures_of(path: str, data: bytes) -> list[tuple]:
    """The archive's captures as one sorted run; a response whose digest does not fit its body raises."""
    run, found = path.rsplit("/", 1)[-1], []
    for at, head, body in parse_archive(gzip.decompress(data)):
        said, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
        if kind == "response":
            size, digest = len(body), hashlib.sha256(body).hexdigest()
            if digest != said:
                raise ValueError(f"digest mismatch in {run} at byte {at}")
        else:
            size, digest = int(head["X-Payload-Length"]), said
        url = head["WARC-Target-URI"]
        found.append((url_key(url), head["WARC-Date"], _page(head.get("WARC-Record-ID")), size, digest, kind, _page(head.get("WARC-Refers-To")), url, run, at))
    found.sort(key=order_of)
    return found


def order_of(capture: tuple) -> tuple:
    """URL key, timestamp, then page (records without an id first) and place."""
    return capture[0], capture[1], -1 if capture[2] is None else capture[2], capture[8], capture[9]


class LoserTree:
    """k-way merge: the loser of each match stays in its node, so a new item replays one path of log2(k) matches."""

    def __init__(self, runs: Iterable[Iterable], key):
        self.sources, self.key = [iter(r) for r in runs], key
        k = len(self.sources)
        self.heads: list = [next(s, None) for s in self.sources]
        self.losers = [-1] * k
        self.winner = self._build(1) if k else -1

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        kx, ky = self.key(x), self.key(y)
        return kx < ky or (kx == ky and a < b)

    def _build(self, node: int) -> int:
        k = len(self.sources)
        if node >= k:
            return node - k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self):
        k = len(self.sources)
        while k and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = next(self.sources[w], None)
            node = (w + k) // 2
            while node:
                if self._beats(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def _rows(captures: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*captures), FIELDS)], schema=ARROW)


def _read_runs(batches):
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
            if found := captures_of(path, data.as_py()):
                yield _rows(found)


def _merge(batches):
    """Rows come with equal runs together and sorted; what one range holds is bounded by the range dealing."""
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            runs.setdefault(row[8], []).append(row)
    out: list[tuple] = []
    for row in LoserTree(runs.values(), order_of):
        out.append(row)
        if len(out) == 5000:
            yield _rows(out)
            out = []
    if out:
        yield _rows(out)


def read_runs(spark, path: str) -> DataFrame:
    """Captures of every archive under ``path``, sorted within each archive; no archive: no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("path", "content")
    return files.mapInArrow(_read_runs, SCHEMA)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Capture histories in global order: partitions are ranges of (url_key, captured_at, page_id)."""
    dealt = runs.repartitionByRange("url_key", "captured_at", "page_id")
    return dealt.sortWithinPartitions("run", "url_key", "captured_at", "page_id", "offset").mapInArrow(_merge, SCHEMA)


def archive(pages: DataFrame, path: str | None = None, min_bytes: int = 100, records_per_file: int = 500) -> DataFrame:
    """Write ``pages`` to WARC archives (in the shared folder unless ``path`` is given) and return the merged index.

    An empty table gives an index without rows.  Other columns than page_id, url and html are ignored.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archives(pages.select("page_id", "url", "html"), path, min_bytes, records_per_file)
    return merge_runs(read_runs(spark, path))
