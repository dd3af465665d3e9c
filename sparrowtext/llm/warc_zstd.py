"""WARC 1.1 archives with a Zstandard dictionary.

Records are compressed one by one, each a frame of its own, so any record can be read at its
offset. The dictionary they share is built from archived records: a bounded sample (`sample_rows`
records, `sample_bytes` of each, chosen by the hash of id and URL) and
stands uncompressed in a skippable frame (magic 0x184D2A5D) at the head of every archive.

Payloads are compared by SHA-1. Of records with equal payloads of at least `least_bytes` bytes the
one with the largest id is a response, the others are revisits of it; smaller ones are responses.
Which is which is one aggregate per digest joined back on the digest; the payloads themselves move
once, dealt evenly by record id and never by digest. Each task writes its archives under a name of
its own and renames each when it is whole, and the table of archives it returns is written once by
Spark, so a task that runs twice leaves at most files that no table names.

Paths: archives go to any file system that pyarrow can open by its URI and all executors share.

Edge cases: null html is an empty payload; a null id is written as an empty id and its record is
never the target of a revisit unless no other has the payload; rows with equal id and payload are records
of their own, of one type; an empty table writes no archive.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, new_path, ship

SKIPPABLE = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"


def record_urn(record_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id}:{digest}')}>"


def record_bytes(record_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One uncompressed record: a response, or a revisit without its payload's bytes."""
    import base64

    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_urn(record_id, digest)}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-ID: {'' if record_id is None else record_id}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_urn(refers_to, digest)}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload (of a revisit: none)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n].partition(b"\r\n\r\n")[2]


def train(samples: list[bytes], size: int) -> bytes:
    """A Zstandard dictionary; with too little to learn from, raw content of the samples."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b"WARC/1.1\r\n"


def write_archive(out: io.BufferedIOBase, records: Iterator[bytes], dictionary: bytes, level: int = 3) -> Iterator[tuple[int, int]]:
    """Write the head and then each record; gives each record's (offset, compressed bytes)."""
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary)
    shared.precompute_compress(level=level)
    comp = zstandard.ZstdCompressor(level=level, dict_data=shared)
    out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
    at = 8 + len(dictionary)
    for r in records:
        frame = comp.compress(r)
        out.write(frame)
        yield at, len(frame)
        at += len(frame)


def read_archive(src: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive in order, by nothing but the archive itself; one in memory at a time."""
    import zstandard

    magic, n = struct.unpack("<II", src.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    dec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(src.read(n)))
    left = b""
    while True:
        obj, out = dec.decompressobj(), []
        while not obj.eof:
            left = left or src.read(1 << 16)
            if not left:
                if out:
                    raise ValueError("the archive ends within a record")
                return
            out.append(obj.decompress(left))
            left = obj.unused_data
        yield parse_record(b"".join(out))


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000, records: int = 20_000, dict_size: int = 64 << 10, sample_rows: int = 2_000, sample_bytes: int = 16 << 10) -> DataFrame:
    """Write the archives; gives path, n_records, n_bytes of each."""
    import pyarrow as pa

    spark = pages.sparkSession
    ship(spark)
    path = path or new_path(spark, "warc")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    named = src.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n"))
    # a bounded sample: the records of the smallest hashes. The share of hashes asked for hangs on the count, so
    # tasks send about as many rows as are wanted in all, whatever their number
    n_rows = src.count()
    share = min(1.0, 1.5 * sample_rows / max(1, n_rows) + (100 / max(1, n_rows)))
    hashed = src.withColumn("h", F.xxhash64("page_id", "url")).where(F.col("h") <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 1025))))
    picked = hashed.select("h", F.substring("payload", 1, sample_bytes).alias("s")).where("octet_length(s) > 0").orderBy("h")
    picked = sorted((r.h, bytes(r.s)) for r in picked.limit(sample_rows).collect())[:sample_rows]
    samples = [record_bytes(0, "", s, hashlib.sha1(s).hexdigest()) for _, s in picked]
    dictionary = spark.sparkContext.broadcast(train(samples, dict_size))

    big = named.where(F.col("n") >= least_bytes)
    copied = big.groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("times")).where("times > 1")
    revisits = cut(big.join(copied, "digest").where("page_id IS NULL AND target IS NOT NULL OR page_id < target").select("page_id", "digest", "target").distinct(), "revisits")
    same = src.page_id.eqNullSafe(revisits.page_id) & (F.sha1(src.payload) == revisits.digest)
    rows = src.join(revisits, same, "left").select(src.page_id, "url", "payload", "target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = _open(path)
        store.create_dir(base, recursive=True)
        ctx, part = TaskContext.get(), 0
        flow = (r for b in batches for r in zip(*(b.column(c) for c in ("page_id", "url", "payload", "target"))))
        pending = next(flow, None)
        while pending is not None:
            name = f"{base}/part-{ctx.partitionId():06d}-{part:04d}-{uuid.uuid4().hex}.warc.zst"
            count = size = 0

            def some(first):
                yield first
                for _, r in zip(range(records - 1), flow):
                    yield r

            def encoded(rows):
                for page_id, url, p, target in ((x.as_py() for x in r) for r in rows):
                    yield record_bytes(page_id, url, p, hashlib.sha1(p).hexdigest(), target)

            with store.open_output_stream(f"{name}.part", compression=None) as out:
                for at, n in write_archive(out, encoded(some(pending)), dictionary.value):
                    count, size = count + 1, at + n
            store.move(f"{name}.part", name)
            yield pa.RecordBatch.from_pydict({"path": [f"{path}/{name.rsplit('/', 1)[1]}"], "n_records": [count], "n_bytes": [size]})
            part += 1
            pending = next(flow, None)

    return cut(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "archives")


def read_back(archives: DataFrame) -> DataFrame:
    """page_id, url, record_type, payload_digest (hex), payload_bytes, refers_to, payload (null of revisits), payload_ok."""
    import base64

    import pyarrow as pa

    spark = archives.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                store, name = _open(path)
                with store.open_input_stream(name, compression=None) as src:
                    rows, held = [], 0
                    for h, payload in read_archive(src):
                        kind = h["warc-type"]
                        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(h["x-payload-length"])):
                            raise ValueError(f"{path}: a payload does not match its digest")
                        ids = [int(v) if (v := h.get(k)) else None for k in ("x-page-id", "x-refers-to-page-id")]
                        rows.append((ids[0], h["warc-target-uri"], kind, digest, int(h["x-payload-length"]), ids[1], payload if kind == "response" else None))
                        held += len(payload)
                        if held > 8 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                    if rows:
                        yield frame(rows)

    def frame(rows):
        types = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)], [k for k, _ in types])

    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
    parts = max(1, min(archives.count(), 100_000))
    return archives.select("path").repartition(parts, "path").mapInArrow(run, schema)


def digests(pages: DataFrame, **how) -> DataFrame:
    """Write, read back, and give one row per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    back = read_back(archive(pages, **how))
    return back.select("page_id", F.col("payload_bytes").cast("long"), "payload_digest", "record_type", "refers_to", "url")


#: DuckDB: what digests() gives of pages whose URLs are plain ASCII.
ORACLE_SQL = """
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS target FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id < target THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < target THEN target END AS refers_to, coalesce(url, '') AS url
FROM t
"""
