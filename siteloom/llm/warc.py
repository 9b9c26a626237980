"""Web archives: written, read back and indexed in one global order.

Every page becomes one WARC/1.1 record. Of equal payloads of at least `least` bytes,
the page with the largest id is the response and the others are revisits of it. The
archives are text files whose record separator is the one that WARC asks for; reading
follows Content-Length, so payloads may hold anything.

The index of an archive is a run sorted by URL key and time. Runs are dealt by ranges
of (URL key, time, page), and in each range the runs are merged with a loser tree, so
the ranges in order are the capture histories in global order.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path

LEAST = 1000
#: About so many bytes of payload in one archive file, and of index rows in one range.
ARCHIVE_BYTES, RANGE_BYTES = 16 << 20, 32 << 20
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_INDEX = "url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"


def url_key(url: str | None) -> str:
    """Host labels from the right, then path and query, in lower case; no scheme,
    default port or fragment."""
    try:
        parts = urlsplit((url or "").strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").lower()
    labels = [x for x in host.removeprefix("www.").split(".") if x]
    place = ",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{place}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "") if host else parts.path


def loser_tree_merge(runs: list[list]):
    """Numbers of the runs, in the order in which their heads are to be taken; runs are
    sorted lists, and equal heads go by the number of the run."""
    k = len(runs)
    at, tree = [0] * k, [-1] * k

    def beats(a: int, b: int) -> bool:
        if at[b] >= len(runs[b]):
            return True
        return at[a] < len(runs[a]) and (runs[a][at[a]], a) < (runs[b][at[b]], b)

    for run in range(k):
        winner, node = run, (run + k) // 2
        while node:
            if tree[node] < 0:
                tree[node] = winner
                break
            if beats(tree[node], winner):
                tree[node], winner = winner, tree[node]
            node //= 2
        else:
            tree[0] = winner
    while k and at[tree[0]] < len(runs[tree[0]]):
        winner = tree[0]
        yield winner
        at[winner] += 1
        node = (winner + k) // 2
        while node:
            if beats(tree[node], winner):
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner


def _payloads(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
        F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"),
    )


def write_archives(pages: DataFrame, least: int = LEAST) -> tuple[str, int]:
    """Write all pages as WARC files in the shared folder: (path, bytes of their index, about).
    A target URI is written without blanks and control characters, which a header can't hold.
    The payload goes from the scan to its archive without a shuffle if the table of
    repeated payloads is small enough for Spark to broadcast it, else by a join."""
    rows = _payloads(pages)
    facts = materialize(rows.select("page_id", "digest", "bytes", F.coalesce(F.octet_length("url"), F.lit(0)).cast("long").alias("url_bytes")), "payloads")
    size = facts.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"), F.coalesce(F.sum("url_bytes"), F.lit(0)).alias("u")).first()
    first = materialize(
        facts.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"),
        "repeats",
    )
    joined = rows.join(first, "digest", "left").withColumn("first", F.when(F.col("bytes") >= least, F.col("first")))
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    moment = F.expr("to_utc_timestamp(timestamp_seconds(1704067200 + pmod(coalesce(page_id, 0), 300000000)), current_timezone())")
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    head = [
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: <urn:page:"), text(F.col("page_id")),
        F.lit(">\r\nWARC-Date: "),
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\p{Cntrl}\s]+", ""))).otherwise(F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(
            revisit,
            F.concat(
                F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"),
                text(F.col("first")), F.lit(">"),
            ),
        ).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.lit(len(HTTP)) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))).cast("string"),
        F.lit("\r\n\r\n" + HTTP),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    ]
    path = new_path(pages.sparkSession, "warc")
    a_file = max(1, ARCHIVE_BYTES // max(1, size["b"] // max(1, size["n"])))
    joined.select(F.concat(*head).alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", a_file).text(path)
    return path, size["u"] + 200 * size["n"]  # a row has 200 bytes besides its key


_FIELD = re.compile(rb"([A-Za-z-]+): ?([^\r\n]*)")


def records(archive: bytes):
    """(offset, headers, payload) of each record of an archive."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        head = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(archive, at, end)}
        length = int(head["content-length"])
        block = archive[end + 4 : end + 4 + length]
        if not archive.startswith(b"WARC/1.1\r\n", at) or len(block) != length:
            raise ValueError(f"no record at {at}")
        yield at, head, block[block.index(b"\r\n\r\n") + 4 :]
        at = end + 4 + length + 4


def read_archives(spark, path: str) -> DataFrame:
    """The index of each archive, a sorted run. Digests and lengths of responses are
    taken from their payloads again and must agree with their headers."""
    names = [x.split()[0] for x in _INDEX.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    page = lambda urn: None if urn == "null" else int(urn)

    def run(it):
        for batch in it:
            for name, archive in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = []
                for offset, head, payload in records(archive.as_buffer().to_pybytes()):
                    kind, digest, length = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                    if kind == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, length):
                        raise ValueError(f"payload damaged in {name} at {offset}")
                    refers = page(head["warc-refers-to"][len("<urn:page:") : -1]) if kind == "revisit" else None
                    out.append((url_key(head.get("warc-target-uri")), head["warc-date"], page(head["warc-record-id"][len("<urn:page:") : -1]), length, digest, kind, refers, name, offset))
                out.sort(key=_order)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _INDEX)


def _order(row: tuple) -> tuple:
    return row[0], row[1], -1 if row[2] is None else row[2], row[8]


def merge_index(runs: DataFrame, size: int) -> DataFrame:
    """All runs as one index of about `size` bytes, in the order of url_key, captured_at, page_id."""
    runs = materialize(runs, "runs")

    def merge(it):
        table = [b for b in it if b.num_rows]
        if not table:
            return
        table = pa.Table.from_batches(table)
        cols = [table.column(c).to_pylist() for c in ("url_key", "captured_at", "page_id", "offset", "archive")]
        heads: list[list] = []
        starts: list[int] = []
        for i, (key, when, page, offset, archive) in enumerate(zip(*cols, strict=True)):
            if not i or archive != cols[4][i - 1]:
                heads.append([])
                starts.append(i)
            heads[-1].append((key, when, -1 if page is None else page, offset))
        at, order = list(starts), []
        for run in loser_tree_merge(heads):
            order.append(at[run])
            at[run] += 1
        yield from table.take(pa.array(order, pa.int64())).to_batches()

    dealt = runs.repartitionByRange(max(1, -(-size // RANGE_BYTES)), "url_key", "captured_at", "page_id")
    return dealt.sortWithinPartitions("archive", "url_key", "captured_at", F.coalesce("page_id", F.lit(-1)), "offset").mapInArrow(merge, _INDEX)


def archive_pages(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """The merged index of all pages, written as WARC and read back: url_key,
    captured_at, page_id, payload_bytes, payload_digest, record_type, refers_to,
    archive, offset.

    Null html: an empty payload. Null url: no target, key ''. Rows that repeat the
    largest page_id of equal payloads are all responses. The time of a capture is made
    from its page_id. Payloads of any length are written whole. Other columns are ignored; an
    empty table gives an empty index.
    """
    path, size = write_archives(pages, least)
    return merge_index(read_archives(pages.sparkSession, path), size)
