"""WARC archives of pages, compressed record by record with a dictionary of their own.

``write_archives`` turns rows into WARC/1.1 records, gathers about ``archive_bytes`` of them,
trains a Zstandard dictionary on all the records gathered, and writes one archive: the
dictionary in a leading skippable frame, then each record as a frame of its own. Records whose
payload an earlier one (the one with the smallest id) already holds are revisits, which refer
to it and repeat no payload. ``read_archives`` streams the frames back into rows.

Plan: which pages are revisits is an aggregate per payload digest, pre-summed before the
shuffle, so a payload that a third of all pages share is one row per task. Only the revisits
(id, first id), a written table, join the pages, and its size on disk decides whether it is
broadcast. Writing is one narrow pass that holds one archive's records at a time. Writer tasks
name their files uniquely and only archives named in the written manifest are read, so a task
that ran twice leaves nothing that counts. Archives are read in pieces of a megabyte.

Defined results: a null payload is empty; a null URL is left out of the record; rows equal in
payload and id are all responses; a payload whose rows have no ids has responses only; rows
without id are revisits of the smallest id with their payload, and come back without id; payloads under ``min_bytes``
are all responses; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spantide.llm.common import materialise, shared_file, spread
from spantide.session import scratch_path

# Fixed values of the format: the skippable frame that holds a dictionary, and its size limit here.
DICT_MAGIC, DICT_BYTES = 0x184D2A5D, 65536
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_URN = "urn:page:"
ARCHIVE_BYTES, MIN_BYTES, LEVEL, DATE = 8 << 20, 0, 3, "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    import base64
    import hashlib
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(name: str | None) -> str:
    """The record's own name: a row without id gets a random UUID, which is read back as null."""
    import uuid
    return uuid.uuid4().urn if name is None else f"{PAGE_URN}{name}"


def record_bytes(kind: str, name: str | None, url: str | None, date: str, digest: str, payload: bytes, first: str | None) -> bytes:
    """One WARC record: the HTTP head, and for a response the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id(name)}>"), ("WARC-Date", date),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if url:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{PAGE_URN}{first}>")]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def archive_bytes_of(records: list[bytes], level: int = LEVEL):
    """The parts of an archive: the dictionary frame, then a frame for each record."""
    import struct

    import zstandard as zstd
    try:        # too few or too uniform records give no dictionary; their own text then serves as one
        trained = zstd.train_dictionary(DICT_BYTES, records, k=256, d=8)
    except zstd.ZstdError:
        trained = zstd.ZstdCompressionDict(b"".join(r[:4096] for r in records[:16]), dict_type=zstd.DICT_TYPE_RAWCONTENT)
    yield struct.pack("<II", DICT_MAGIC, len(trained.as_bytes())) + trained.as_bytes()
    packer = zstd.ZstdCompressor(level=level, dict_data=trained)
    for r in records:
        yield packer.compress(r)


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Write (name, url, payload, first) rows; the manifest (archive, n_records)."""
    def write(batches):
        import uuid

        import pyarrow as pa

        from spantide.llm.tokens import blocks_of

        def flush(records):
            name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            fs, path = shared_file(name)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(path) as out:
                for part in archive_bytes_of(records):
                    out.write(part)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(records)], pa.int64())], names=["archive", "n_records"])

        records, size = [], 0
        for block in blocks_of(batches, "payload"):
            for row in block.to_pylist():
                payload = row["payload"] or b""
                kind = "revisit" if row["revisits"] else "response"
                records.append(record_bytes(kind, row["name"], row["url"], date, base32_sha1(payload), payload, row["first"]))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield flush(records)
                    records, size = [], 0
        if records:
            yield flush(records)

    return pages.select("name", "url", F.col("payload").cast("binary").alias("payload"), "first", "revisits").mapInArrow(
        write, "archive string, n_records long")


def frames(stream, chunk: int = 1 << 20):
    """The records of an archive, read in pieces."""
    import struct

    import zstandard as zstd
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICT_MAGIC:
        raise ValueError("no dictionary frame at the start of the archive")
    raw = stream.read(size)
    kind = zstd.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstd.DICT_TYPE_RAWCONTENT
    unpacker = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw, dict_type=kind))
    rest = stream.read(chunk)
    while rest:
        one, parts = unpacker.decompressobj(), []
        while not one.eof:
            if not rest and not (rest := stream.read(chunk)):
                raise ValueError("the archive ends within a record")
            parts.append(one.decompress(rest))
            rest = one.unused_data
        yield b"".join(parts)
        rest = rest or stream.read(chunk)


def parse_record(record: bytes) -> dict:
    """The fields of one record; digest and size of a response come from its payload."""
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    field = dict(x.split(": ", 1) for x in lines[1:])
    http, _, payload = block[:int(field["Content-Length"])].partition(b"\r\n\r\n")
    own = field["WARC-Record-ID"][1:-1]
    name = own[len(PAGE_URN):] if own.startswith(PAGE_URN) else None
    out = {"name": name, "url": field.get("WARC-Target-URI"), "record_type": field["WARC-Type"], "refers_to": None,
           "payload": payload, "payload_bytes": len(payload), "payload_digest": base32_sha1(payload)}
    if out["record_type"] == "revisit":
        size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
        out |= {"payload": None, "payload_bytes": size, "payload_digest": field["WARC-Payload-Digest"].partition(":")[2],
                "refers_to": field["WARC-Refers-To"][1 + len(PAGE_URN):-1]}
    elif "sha1:" + out["payload_digest"] != field["WARC-Payload-Digest"]:
        raise ValueError(f"payload of {name} does not match its digest")
    return out


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """(name, url, record_type, refers_to, payload, payload_bytes, payload_digest) of every record."""
    cols = ["name", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]

    def read(batches):
        import pyarrow as pa
        kinds = {"payload": pa.binary(), "payload_bytes": pa.int64()}

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in cols], names=cols)

        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                fs, path = shared_file(archive)
                rows, size = [], 0
                with fs.open_input_stream(path) as stream:
                    for record in frames(stream):
                        r = parse_record(record)
                        rows.append(r if payloads else r | {"payload": None})
                        size += len(record)
                        if size > 1 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return spread(manifest.select("archive"), "archive").mapInArrow(
        read, "name string, url string, record_type string, refers_to string, payload binary, payload_bytes long, payload_digest string")


def archive_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                 min_bytes: int = MIN_BYTES) -> DataFrame:
    """(name, url, payload, first, revisits): what each record says, ids as text."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    keys = materialise(p.where(F.octet_length("payload") >= min_bytes).select("id", F.unhex(F.sha1("payload")).alias("digest")), "digests")
    first = materialise(keys.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
                        .where("n > 1 AND first IS NOT NULL").select("digest", "first"), "first")
    revisits = materialise(keys.join(first, "digest").where(~F.col("id").eqNullSafe(F.col("first")))
                           .select(F.col("id").alias("rid"), F.col("digest").alias("rdigest"), "first").distinct(), "revisits")
    p = p.withColumn("digest", F.unhex(F.sha1("payload")))
    j = p.join(revisits, p.id.eqNullSafe(revisits.rid) & (p.digest == revisits.rdigest), "left")
    return j.select(F.col("id").cast("string").alias("name"), "url", "payload", F.col("first").cast("string").alias("first"),
                    F.col("first").isNotNull().alias("revisits"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    manifest = materialise(write_archives(archive_rows(pages), scratch_path(spark, "llm-warc")), "manifest")
    kind = pages.schema["page_id"].dataType
    return read_archives(manifest, payloads=False).select(
        F.col("name").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))


# The digest in base32: the 40 hex digits as 160 bits, five at a time.
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= {MIN_BYTES} GROUP BY h),
b AS (SELECT p.*, f.first, list_aggregate(list_transform(range(1, 41), lambda i:
        right(bin(CAST(('0x' || substr(p.h, i, 1)) AS INTEGER) + 16), 4)), 'string_agg', '') AS bits
      FROM p LEFT JOIN f ON f.h = p.h AND p.n >= {MIN_BYTES})
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST(list_aggregate(list_transform(range(1, 6), lambda j:
           CAST(substr(bits, CAST(5 * k + j AS BIGINT), 1) AS INTEGER) * (32 >> CAST(j AS INTEGER))), 'sum') AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM b
"""
