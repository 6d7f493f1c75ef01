"""Deterministic sharded WARC archives.

Records are dealt to shards by ranges of their key, as many as the payloads' bytes ask for; the ranges' borders are
quantiles, by bytes, of the keys of rows whose hash falls in a fixed slice, so they depend on the rows and the number of
shards alone, not on how the input is partitioned. A key that many rows repeat is split further by its rows' digests. A
shard is one sorted run, written record by record into gzip members; a file is closed once it has `roll_bytes` compressed bytes.
Headers (lengths, SHA-256 digests, record types, references) are made anew from the payloads, dates are a parameter:
the same rows give the same bytes.

A task writes each file under a temporary name of its own and renames it when it is whole; a repeated or speculative
task renames equal bytes over it. Its rows of the manifest (file, size, records, SHA-256) are written by Spark's own
committer. Only files that the manifest names belong to the archive, and a reader checks their digests.

Of records with equal payloads of at least `least` bytes the one with the smallest key is a response and the others
revisit it; a revisit has no payload of its own but the payload's digest and length in its header. Which rows revisit
which is found over (key, digest) alone; these rows then travel beside the pages into the same sorted runs, so that
payloads are shuffled once.

A null payload is an empty one. Rows that repeat a key are records of their own; of several with equal payloads and the
smallest key one is the response, the others revisit that key. A null key is written as a record without one and comes
back as null; it revisits as any other does but is never a response that others refer to, unless there is no other.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common

NO_KEY = -(1 << 63)
MANIFEST = "shard int, file string, bytes long, records long, sha256 string"
RECORD = "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def record(key: int | None, nth: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as WARC/1.1, uncompressed; nth: of those with this key and digest."""
    name = lambda k, n: f"<urn:page:{'' if k is None else k}:{digest[:16]}:{n}>"
    revisit = refers_to is not None
    body = b"" if revisit else payload
    block = hashlib.sha256(body).hexdigest()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(key, nth)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {base64.b64encode((url or '').encode()).decode() if not (url or '').isprintable() else (url or '')}",
        f"X-URI-Encoding: {'none' if url is None else 'base64' if not url.isprintable() else 'plain'}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{block}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to, 0)}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(stream: io.BufferedIOBase) -> Iterator[dict]:
    """The records of an uncompressed stream: header names in lower case, and "payload". Raises if a digest or length is wrong."""
    while line := stream.readline():
        if line.rstrip(b"\r\n") != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        found: dict = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.decode().partition(":")
            found[name.lower()] = value.strip()
        found["payload"] = stream.read(int(found["content-length"]))
        if stream.read(4) != b"\r\n\r\n" or f"sha256:{hashlib.sha256(found['payload']).hexdigest()}" != found["warc-block-digest"]:
            raise ValueError(f"broken record {found['warc-record-id']}")
        yield found


class _Rolling:
    """The files of one shard."""

    def __init__(self, folder: str, shard: int, roll_bytes: int) -> None:
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.shard, self.roll_bytes, self.n, self.out = shard, roll_bytes, 0, None
        self.fs.create_dir(f"{self.root}/data", recursive=True)

    def write(self, content: bytes) -> dict | None:
        if self.out is None:
            self.temporary = f"{self.root}/data/.{uuid.uuid4().hex}.tmp"
            self.out, self.hash, self.size, self.records = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0, 0
        member = gzip.compress(content, 6, mtime=0)
        self.out.write(member)
        self.hash.update(member)
        self.size += len(member)
        self.records += 1
        return self.close() if self.size >= self.roll_bytes else None

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        name = f"data/part-{self.shard:05d}-{self.n:05d}.warc.gz"
        self.fs.move(self.temporary, f"{self.root}/{name}")
        self.n += 1
        return {"shard": self.shard, "file": name, "bytes": self.size, "records": self.records, "sha256": self.hash.hexdigest()}


def borders(rows: DataFrame, shards: int, most: int = 100_000) -> np.ndarray:
    """Keys at which shards 1, 2, ... begin, each of about the same bytes, from about `most` rows (key, size) of a slice of the hash values. A null key is the least."""
    take = max(1, -(-rows.count() // most))
    key = F.coalesce("key", F.lit(NO_KEY))
    seen = rows.where(F.pmod(F.xxhash64("key", "digest"), F.lit(take)) == 0).select(key, F.col("size") + 1).collect()
    keys, sizes = np.array([r[0] for r in seen], np.int64), np.array([r[1] for r in seen], float)
    order = np.argsort(keys, kind="stable")
    ends = np.cumsum(sizes[order])
    return keys[order][np.minimum(np.searchsorted(ends, ends[-1] * np.arange(1, shards) / shards), len(keys) - 1)] if len(keys) else keys


def write(pages: DataFrame, folder: str, *, shards: int | None = None, shard_bytes: int = 64 << 20, roll_bytes: int = 64 << 20, least: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the archive of pages (key, url, payload) into a new folder, and returns its manifest. shards: as many as hold `shard_bytes` of payload each, if not given."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("payload"), F.lit(""))
    pages = pages.select(F.col("key").cast("long").alias("key"), "url", payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    narrow = common.saved(pages.select("key", "digest", F.octet_length("payload").alias("size")), "warc-digests")
    shards = shards or max(1, -(-(narrow.agg(F.sum("size")).first()[0] or 0) // shard_bytes))
    starts = borders(narrow, shards)
    long_ones = narrow.where(F.col("size") >= least)
    first = long_ones.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("uses")).where("uses > 1 AND first IS NOT NULL").drop("uses")
    # one row for each key and digest that revisits; "all" if the key itself is not the response
    revisits = long_ones.groupBy("key", "digest").agg(F.count("*").alias("n")).join(first, "digest").where("key IS NULL OR key <> first OR n > 1")
    notes = revisits.select("key", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"), "digest", F.lit(0).alias("kind"), "first")
    rows = notes.unionByName(pages.select("*", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first")))

    @F.pandas_udf("int")
    def shard_of(key: pd.Series, digest: pd.Series) -> pd.Series:
        # a key that is several borders at once is dealt to all of their shards by ranges of the digest
        low, high = (np.searchsorted(starts, key.to_numpy(), side) for side in ("left", "right"))
        low = np.where(high > low, low + 1, high)
        part = digest.str[:8].map(lambda x: int(x, 16)).to_numpy(np.int64) if len(digest) else np.zeros(0, np.int64)
        return pd.Series((low + (part * (high - low + 1) >> 32)).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last, note, seen, done = None, None, None, 0, []
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("shard", "key", "digest", "kind", "first", "url")]
            for k, (shard, key, digest, kind, of, url) in enumerate(zip(*columns, strict=True)):
                if out is None or out.shard != shard:
                    if out:
                        done.append(out.close())
                    out = _Rolling(folder, shard, roll_bytes)
                if (shard, key, digest) != last:
                    last, note, seen = (shard, key, digest), None, 0
                if kind == 0:
                    note = of
                    continue
                refers = note if note is not None and (note != key or seen) else None
                done.append(out.write(record(key, seen, url, b.column("payload")[k].as_py().encode(), digest, refers, date)))
                seen += 1
            done = [x for x in done if x]
            yield pa.RecordBatch.from_pylist(done, schema=manifest)
            done = []
        if out and (x := out.close()):
            yield pa.RecordBatch.from_pylist([x], schema=manifest)

    manifest = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())])
    dealt = rows.withColumn("shard", shard_of(F.coalesce("key", F.lit(NO_KEY)), "digest")).repartitionByRange(4 * (len(starts) + 1), "shard")  # more ranges than shards, so that no two are drawn together
    dealt.sortWithinPartitions("shard", "key", "digest", "kind", "url").select("shard", "key", "digest", "kind", "first", "url", "payload").mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, *, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest names. Fails if a file is not what the manifest says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, digest in zip(b.column("file").to_pylist(), b.column("sha256").to_pylist(), strict=True):
                check = hashlib.sha256()
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    while part := f.read(1 << 20):
                        check.update(part)
                if check.hexdigest() != digest:
                    raise ValueError(f"{name} differs from the manifest")
                rows, size = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as f, gzip.GzipFile(fileobj=f) as g:
                    for r in parse(io.BufferedReader(g, 1 << 16)):
                        rows.append(_row(r, payloads))
                        size += len(r["payload"])
                        if size > 4 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                yield _batch(rows)

    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file", "sha256")
    return files.repartitionByRange(4 * max(1, files.count()), "file").mapInArrow(run, RECORD)  # a task for each file


def _number(urn: str) -> int | None:
    digits = urn.split(":")[2]
    return int(digits) if digits else None


def _row(r: dict, payloads: bool) -> dict:
    url = {"none": None, "plain": r["warc-target-uri"]}.get(r["x-uri-encoding"]) if r["x-uri-encoding"] != "base64" else base64.b64decode(r["warc-target-uri"]).decode()
    return {
        "key": _number(r["warc-record-id"]), "url": url, "payload_bytes": int(r["x-payload-length"]), "payload_digest": r["warc-payload-digest"].removeprefix("sha256:"), "record_type": r["warc-type"],
        "refers_to": _number(r["warc-refers-to"]) if "warc-refers-to" in r else None, "payload": r["payload"].decode() if payloads else None,
    }


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())]))


def digest_table(pages: DataFrame, **options) -> DataFrame:
    """Writes pages (page_id, url, html) as an archive in the shared folder, and returns what its records say."""
    spark = pages.sparkSession
    folder = f"{common.shared_dir(spark)}/lodestone/warc-{uuid.uuid4().hex}"
    write(pages.select(F.col("page_id").alias("key"), "url", F.col("html").alias("payload")), folder, **options)
    return read(spark, folder, payloads=False).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
