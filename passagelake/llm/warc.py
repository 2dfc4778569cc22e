"""WARC archives: writer, monolithic gzip normaliser, sidecar offset index, reader.

Pages become WARC/1.1 records. Archives arrive as one gzip stream over the whole
file, the form that cannot be read at an offset. The normaliser inflates such a
stream once, rewrites every record as a gzip member of its own and writes a sidecar
index (offset, length, record id, type). The reader fetches single members by that
index, checks the digest of each response and returns one row per record.

Equal payloads of at least ``revisit_from`` bytes are stored once: the page with the
smallest id is the response, the others are revisits that name it. Only the ids and
digests meet by digest; payloads never do, so a payload shared by a third of all
pages is not gathered anywhere. Pages whose digest no other page has are written where
they were read: a bitmap of bounded size tells most of them from those that are shuffled
to meet what they refer to.

Defined cases: null html is an empty payload; null url becomes ``urn:x-none``; a null
page_id never leads a group unless all its ids are null (then all are responses);
rows that repeat the smallest id of a group are responses too; an empty table gives
an empty result. Files are named by partition and attempt and listed in a manifest table,
so what a lost task left behind is never read and nothing is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, create_file, hub_join, new_path, open_folder, table, written

CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 64 << 20
LEVEL = 1
#: Words of 64 bits in the bitmap of digests that several pages have (10.5 MB as a broadcast when full).
WORDS = 1 << 18


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def make_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; ``refers_to`` is the response's page id for a revisit."""
    safe = re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:x-none"
    revisit = refers_to is not None
    block = HTTP_HEAD % len(payload) + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}"]
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + CRLF * 2 + block + CRLF * 2


def read_records(chunks):
    """Whole records (bytes) from an iterable of byte chunks of a WARC stream."""
    held = bytearray()
    need = 0  # bytes of the current record, once its header is known
    for chunk in chunks:
        held += chunk
        while True:
            if not need:
                end = held.find(CRLF * 2)
                if end < 0:
                    break
                m = re.search(rb"\r\nContent-Length:\s*(\d+)", held[: end + 2], re.I)
                if not m:
                    raise ValueError("a WARC record without Content-Length")
                need = end + 4 + int(m[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held.strip():
        raise ValueError("a WARC stream ends inside a record")


def inflate(stream, size: int = 1 << 20):
    """Chunks of a gzip stream of one or more members, inflated once."""
    d = zlib.decompressobj(wbits=31)
    while data := stream.read(size):
        while data:
            out = d.decompress(data)
            if out:
                yield out
            data = d.unused_data
            if d.eof:
                d = zlib.decompressobj(wbits=31)
            else:
                break
    tail = d.flush()
    if tail:
        yield tail


def parse_record(record: bytes) -> dict:
    head, _, block = record.partition(CRLF * 2)
    fields = {}
    for line in head.split(CRLF)[1:]:
        k, _, v = line.partition(b":")
        fields[k.strip().lower().decode()] = v.strip().decode()
    fields["block"] = block[: int(fields["content-length"])]
    return fields


def _write_batches(base: str):
    def run(batches):
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        made, archive, gz, size = [], None, None, 0

        def finish():
            archive.write(gz.flush())
            archive.close()

        for batch in batches:
            ids, urls, pages, digests, refers = (batch.column(i).to_pylist() for i in range(5))
            for page_id, url, page, digest, to in zip(ids, urls, pages, digests, refers):
                if archive is None:
                    name = f"part-{part:06d}-{attempt}-{len(made):04d}.warc.gz"
                    archive, gz, size = create_file(base, name), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
                    made.append(name)
                record = make_record(page_id, url, (page or "").encode(), base32(digest), to)
                archive.write(gz.compress(record))
                size += len(record)
                if size >= FILE_BYTES:
                    finish()
                    archive = None
        if archive is not None:
            finish()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(made)], ["name"])

    return run


def normalise(fs, source: str, target_base: str, name: str) -> int:
    """One monolithic archive: inflated once, every record a member, sidecar index."""
    at = n = 0
    with fs.open_input_stream(source, compression=None) as stream, create_file(target_base, name) as archive, create_file(target_base, name + ".idx") as index:
        for record in read_records(inflate(stream)):
            gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = gz.compress(record) + gz.flush()
            fields = parse_record(record[: record.index(CRLF * 2)] + CRLF * 2)
            index.write(f"{at}\t{len(member)}\t{fields['warc-record-id']}\t{fields['warc-type']}\n".encode())
            archive.write(member)
            at += len(member)
            n += 1
    return n


def _normalise_batches(base: str, target: str):
    def run(batches):
        fs, root = open_folder(base)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            names = batch.column(0).to_pylist()
            made = [f"{name.removesuffix('.warc.gz')}-{attempt}.warc.gz" for name in names]
            counts = [normalise(fs, f"{root}/{name}", target, to) for name, to in zip(names, made)]
            yield pa.RecordBatch.from_arrays([pa.array(made), pa.array(counts, pa.int64())], ["name", "records"])

    return run


def _read_batches(base: str):
    def run(batches):
        fs, root = open_folder(base)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{name}.idx", compression=None) as f:
                    places = [line.split("\t")[:2] for line in f.read().decode().splitlines()]
                with fs.open_input_file(f"{root}/{name}") as f:
                    for offset, length in places:
                        record = parse_record(zlib.decompress(f.read_at(int(length), int(offset)), wbits=31))
                        head, _, payload = record["block"].partition(CRLF * 2)
                        digest = record["warc-payload-digest"].removeprefix("sha1:")
                        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                        if record["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"{name} at {offset}: the payload does not match its digest")
                        rows.append((int(record["x-page-id"]) if record["x-page-id"] else None, size, digest, record["warc-type"], int(to) if (to := record.get("x-refers-to-page-id")) else None, record["warc-target-uri"], name, int(offset), int(length)))
                        if len(rows) >= 5000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    return run


_FIELDS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "archive", "offset", "length"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
READ_SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, archive string, offset bigint, length bigint"


def _rows(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _FIELDS)


def with_revisits(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """page_id, url, html, digest (hex), refers_to."""
    full = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    full = full.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    keys = written(full.where(F.octet_length("html") >= revisit_from).select("page_id", "digest"), "warc-keys")
    leads = written(keys.groupBy("digest").agg(F.min("page_id").alias("lead"), F.count(F.lit(1)).alias("many")).where("many > 1"), "warc-leads")
    # a payload that many pages share (the empty one) is looked up by broadcast
    revisits = hub_join(keys.distinct(), leads, "digest", keys.count()).where("page_id is null or page_id <> lead").where("lead is not null").select(F.col("page_id").alias("p"), F.col("digest").alias("g"), F.col("lead").alias("refers_to"))
    # a page whose bit is not set is a response and stays where it is; with the others the join decides, so a bit set by another digest changes nothing
    word, bit = F.expr(f"pmod(xxhash64(digest), {WORDS})"), F.expr("cast(pmod(xxhash64(digest, 1), 64) as int)")
    bits = leads.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits"))
    marked = full.withColumns({"word": word, "bit": bit}).join(F.broadcast(bits), "word", "left").withColumn("shared", F.coalesce(F.getbit("bits", "bit"), F.lit(0)) == 1)
    alone = marked.where("not shared").select("page_id", "url", "html", "digest", F.lit(None).cast("bigint").alias("refers_to"))
    met = marked.where("shared").join(revisits, F.expr("page_id <=> p and digest = g"), "left").select("page_id", "url", "html", "digest", "refers_to")
    return alone.unionByName(met)


def write_archives(pages: DataFrame, base: str, revisit_from: int = 0) -> DataFrame:
    """Monolithic archives under ``base``; the manifest (name) as a written table."""
    bounded_batches(pages.sparkSession)
    return written(with_revisits(pages, revisit_from).mapInArrow(_write_batches(base), "name string"), "warc-manifest")


def normalise_archives(manifest: DataFrame, base: str, target: str) -> DataFrame:
    """Every monolithic archive as one member per record with a sidecar index."""
    n = max(1, manifest.count())
    done = manifest.select("name").repartition(min(n, 10_000), "name").mapInArrow(_normalise_batches(base, target), "name string, records bigint")
    return written(done, "warc-normal")


def read_archives(manifest: DataFrame, base: str) -> DataFrame:
    """One row per record, fetched member by member through the sidecar index."""
    n = max(1, manifest.count())
    return manifest.select("name").repartition(min(n, 10_000), "name").mapInArrow(_read_batches(base), READ_SCHEMA)


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, target = new_path(spark, "warc-whole"), new_path(spark, "warc-members")
    manifest = write_archives(table(spark, sf_dir, "pages"), base)
    return read_archives(normalise_archives(manifest, base, target), target).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS lead,
             array_to_string(list_transform(string_split(hex, ''), lambda c:
               ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), '') AS bits
      FROM h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + list_sum(list_transform(range(5), lambda j: (substr(bits, (i * 5 + j + 1)::BIGINT, 1) = '1')::INT * (1 << (4 - j)::INT)))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = lead THEN NULL ELSE lead END AS refers_to
FROM b
"""
