"""Web archives: writing WARC files, reading them back, and merging their indexes into capture histories.

Writing: records are packed into chunks that end with the record that passes CHUNK_BYTES, each of which Spark's text
writer puts into a gzip file of the shared folder (offsets count uncompressed bytes), so files are whole on any Hadoop file system and a lost task is written
again.  Of equal payloads of at least `least` bytes the capture with the largest id is a response and the others are
revisits that refer to it: repeated digests with their largest id are one aggregate, which meets the pages by broadcast
up to a checked number of rows, so payloads stay where they are read, and by a shuffle of them beyond.

Reading: each file is parsed by its Content-Length headers and yields a run of index entries, sorted by (URL key,
timestamp, id).  Runs are dealt out by ranges of that whole key, so the captures of one URL can span tasks, and each
task merges its pieces of k runs, some PER_SHARD entries in all, with a loser tree.  The result is ordered by URL key and timestamp within and across
partitions; `shard` numbers the partitions.

Defined cases: null html is an empty payload, null url an empty URL; repeated rows are records each (those with the
largest id are all responses); a null id counts as smallest; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import itertools
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyspark.sql.types as T
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joinable, prepare, shared_dir, tasks_for

CHUNK_BYTES, PER_SHARD, END = 16 << 20, 200_000, "\r\n\r\n"
EPOCH = dt.datetime(2024, 1, 1)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed, then port, path and query; scheme, www and fragment don't count."""
    try:
        u = urlsplit((url or "").strip())
        host, port = (u.hostname or "").removeprefix("www."), u.port
    except ValueError:
        return (url or "").strip().lower()
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def classified(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages (page_id, url, html) with payload digest and size, and refers_to for captures that revisit another."""
    own = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("bigint")})
    groups = own.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    out = own.join(joinable(groups), ["digest", "size"], "left")
    return out.select("page_id", "url", "html", "digest", "size", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def _record(page_id, url: str, html: str, digest: str, size: int, refers_to) -> str:
    at = (EPOCH + dt.timedelta(seconds=int(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    revisit = refers_to is not None and not pd.isna(refers_to)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    body = http if revisit else http + html
    clean = "".join(c if " " < c else "%20" for c in url)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>",
        f"WARC-Date: {at}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{sha}", f"X-Capture-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Capture: {int(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body.encode())}"]
    return "\r\n".join(head) + END + body


def write_archives(pages: DataFrame, path: str, least: int = 1000) -> None:
    """One WARC record for each row of pages (page_id, url, html), in files below path."""
    prepare(pages.sparkSession)

    def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for f in frames:
            ids = [None if pd.isna(x) else int(x) for x in f["page_id"]]
            for page_id, url, html, digest, n, ref in zip(ids, f["url"], f["html"], f["digest"], f["size"], f["refers_to"], strict=True):
                held.append(_record(page_id, url, html, digest, int(n), ref))
                size += len(held[-1].encode())
                if size >= CHUNK_BYTES:
                    yield pd.DataFrame({"value": [END.join(held)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"value": [END.join(held)]})

    (
        classified(pages, least).withColumns({"page_id": F.col("page_id").cast("decimal(38,0)").cast("string"), "refers_to": F.col("refers_to").cast("string")})
        .mapInPandas(chunks, "value string").write.option("lineSep", END).option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    )


def parsed(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of a WARC file."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        end = stop + 4 + int(headers["Content-Length"])
        yield at, end + 4 - at, headers, data[stop + 4 : end]
        at = end + 4


ENTRY = T.StructType([
    T.StructField("url_key", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("record_type", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("file", T.StringType()),
    T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
])
ORDER = ("url_key", "timestamp", "page_id", "offset")
NO_ID = -(1 << 63)  #: stands for a null id inside the index


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives below path; those of each file are a sorted run."""
    prepare(spark)

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, data in zip(f["path"], f["content"], strict=True):
                run = []
                for offset, length, h, block in parsed(gzip.decompress(data) if name.endswith(".gz") else data):
                    http, _, body = block.partition(b"\r\n\r\n")
                    size = int(http.rsplit(b"Content-Length: ", 1)[1])
                    kind = h["WARC-Type"]
                    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if kind == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
                        raise ValueError(f"{name} at {offset}: the payload isn't what its headers say")
                    ref = h.get("X-Refers-To-Capture")
                    run.append((
                        url_key(h["WARC-Target-URI"]), h["WARC-Date"], int(h["X-Capture-ID"] or NO_ID), kind, size, digest,
                        int(ref or NO_ID), name, offset, length,
                    ))
                run.sort(key=_key)
                if run:  # an empty table leaves a file without records
                    yield _frame(run)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a file at a time
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInPandas(entries, ENTRY)


def _key(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2], entry[8]


def _frame(entries: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(ENTRY.names, map(list, zip(*entries, strict=True)), strict=True)))


def merged_runs(runs: list[list], key=lambda x: x) -> Iterator:
    """k-way merge of sorted lists with a loser tree: each inner node keeps the loser of its match, so the next least
    element costs one match for each level."""
    k = len(runs)
    at = [0] * k
    heads: list = [(key(r[0]), i) if r else None for i, r in enumerate(runs)]  # None: exhausted, loses to all
    losers = [-1] * max(k, 1)

    def wins(a: int, b: int) -> bool:
        return heads[b] is None or heads[a] is not None and heads[a] < heads[b]

    winner = -1
    if k:
        best = [-1] * (2 * k)
        best[k:] = range(k)
        for node in range(k - 1, 0, -1):
            a, b = best[2 * node], best[2 * node + 1]
            best[node], losers[node] = (a, b) if wins(a, b) else (b, a)
        winner = best[1]
    while winner >= 0 and heads[winner] is not None:
        i = winner
        yield runs[i][at[i]]
        at[i] += 1
        heads[i] = (key(runs[i][at[i]]), i) if at[i] < len(runs[i]) else None
        node = (i + k) // 2
        while node:
            if not wins(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node //= 2


def merge_indexes(entries: DataFrame, per_shard: int = PER_SHARD) -> DataFrame:
    """entries in the order of URL key and timestamp, with `shard`; each task merges the sorted pieces it receives."""
    prepare(spark := entries.sparkSession)

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        runs: list[list] = []
        for f in frames:
            for x in f.itertuples(index=False, name=None):
                if not runs or _key(x) < _key(runs[-1][-1]):
                    runs.append([])  # a piece ends where the order breaks
                runs[-1].append(x)
        out = merged_runs(runs, _key)
        while some := list(itertools.islice(out, 10_000)):
            yield _frame(some).assign(shard=TaskContext.get().partitionId())

    shards = tasks_for(spark, entries.count(), per_shard)
    dealt = entries.repartitionByRange(shards, *ORDER)
    out = dealt.mapInPandas(merge, T.StructType([*ENTRY.fields, T.StructField("shard", T.IntegerType())]))
    return out.withColumns({c: F.nullif(c, F.lit(NO_ID)) for c in ("page_id", "refers_to")})


def capture_histories(pages: DataFrame, path: str | None = None, least: int = 1000) -> DataFrame:
    """Write pages to archives (below path, else the shared folder), read them back and merge their indexes."""
    from .common import materialize

    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/siftwell-warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least)
    return merge_indexes(materialize(read_archives(spark, path)))
