"""WARC archives compressed with Zstandard.

An archive is a skippable frame that holds a dictionary, then one frame for each
record. Archives are bounded in size, written by the tasks that hold the pages,
and read back one file at a time.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import cut, quoted, read, shared_folder
from cairn.llm.registry import query

__all__ = ["ArchiveError", "frames", "parse_record", "read_archives", "write_archives"]

#: Bytes of records, before compression, after which a new archive begins.
ARCHIVE_BYTES = 8 << 20
#: Bytes of records that the dictionary of an archive is made from, and its size.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 32 << 10
#: Payloads below that many bytes are always written whole.
LEAST_PAYLOAD = 100
LEVEL = 6

# Fixed values of the formats: WARC 1.1, its Zstandard profile, and the frame format (RFC 8878).
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")
DATE = "2024-01-01T00:00:00Z"


class ArchiveError(ValueError):
    pass


def record(page_id, url: str | None, payload: bytes | None, size: int, digest: str, refers_to) -> bytes:
    """A response record, or, where ``refers_to`` is given, a revisit without payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + (payload or b"")
    uri = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "urn:cairn:no-url")
    name = "none:" + uuid.uuid5(uuid.NAMESPACE_URL, f"{uri} {digest}").hex if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:cairn:page:{name}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {uri}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:cairn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; raises ArchiveError where the version, a
    required header, a length or the record's end is wrong."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        if not colon:
            raise ArchiveError(f"bad header line {line[:80]!r}")
        headers[k.strip()] = v.strip()
    if missing := [k for k in REQUIRED if k not in headers]:
        raise ArchiveError(f"header {missing[0]} is missing")
    n = headers["Content-Length"]
    if not n.isdigit() or len(rest) != int(n) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError("Content-Length differs from the block's length")
    return headers, rest[:-4]


def payload_of(headers: dict[str, str], block: bytes) -> tuple[int, bytes | None]:
    """Length of the full payload, and the payload itself but for a revisit; checked against its digest."""
    head, sep, body = block.partition(b"\r\n\r\n")
    lengths = [x.split(b":", 1)[1].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not sep or len(lengths) != 1 or not lengths[0].isdigit():
        raise ArchiveError("the HTTP header has no length")
    n = int(lengths[0])
    if headers["WARC-Type"] == "revisit":
        if body:
            raise ArchiveError("a revisit holds a payload")
        return n, None
    if len(body) != n:
        raise ArchiveError("the payload's length differs from the HTTP header's")
    if headers.get("WARC-Payload-Digest") != "sha256:" + hashlib.sha256(body).hexdigest():
        raise ArchiveError("the payload's digest differs")
    return n, body


def frame_end(data: bytes, at: int) -> int:
    """End of the Zstandard frame that begins at ``at``, by its block headers."""
    if len(data) < at + 6 or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise ArchiveError("no frame where one is due")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6])
    last = False
    while not last:
        if at + 3 > len(data):
            raise ArchiveError("a frame is cut off")
        head = int.from_bytes(data[at:at + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        if kind == 3:
            raise ArchiveError("reserved block type")
        at += 3 + (1 if kind == 1 else size)
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise ArchiveError("a frame is cut off")
    return at


def frames(data: bytes):
    """The records of an archive: its dictionary is read from the leading
    skippable frame, if there is one, then each frame is one record."""
    at, known = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        if at > len(data):
            raise ArchiveError("the dictionary is cut off")
        body = data[8:at]
        if body[:4] == struct.pack("<I", FRAME_MAGIC):
            body = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 30)
        known = zstandard.ZstdCompressionDict(body)
    reader = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        try:
            yield reader.decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise ArchiveError(str(e)) from e
        at = end


def archive(records: list[bytes]) -> bytes:
    sample, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        sample.append(r[:SAMPLE_BYTES // 8])
        size += len(sample[-1])
    try:
        known = zstandard.train_dictionary(DICTIONARY_BYTES, sample)
    except zstandard.ZstdError:  # too few records to learn from: an archive may go without
        known = None
    writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True, write_checksum=True)
    if known:
        known.precompute_compress(level=LEVEL)
        body = known.as_bytes()
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body
    else:
        lead = b""
    return lead + b"".join(writer.compress(r) for r in records)


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record for each row below ``folder`` (a URI all executors share)
    and returns the manifest: name, records and bytes of each archive.

    Of rows with equal payloads of at least 100 bytes, the one with the smallest
    page_id is written whole and the others refer to it; rows that repeat that
    page_id are whole as well. Null html is an empty payload, null url gets a
    placeholder. Rows without page_id are whole and nothing refers to them. An
    attempt that fails leaves at most files that no manifest names.
    """
    pid = quoted(page_id).cast("long")
    rows = pages.select(pid.alias("page"), quoted(url).cast("string").alias("url"), F.coalesce(quoted(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    first = cut(rows.filter(F.col("size") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min("page").alias("first"), F.max("page").alias("last"))
                .filter("first < last").select("digest", "first"))
    rows = rows.join(first, "digest", "left")
    refers = F.when(F.col("first") < F.col("page"), F.col("first"))
    rows = rows.select("page", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "size", "digest", refers.alias("refers"))
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])

    def run(batches):
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)

        def put(records: list[bytes]) -> pa.RecordBatch:
            name, data = f"{uuid.uuid4().hex}.warc.zst", archive(records)
            with store.open_output_stream(f"{top}/_{name}", compression=None) as out:
                out.write(data)
            store.move(f"{top}/_{name}", f"{top}/{name}")
            return pa.RecordBatch.from_pydict({"name": [name], "records": [len(records)], "bytes": [len(data)]})

        held, size = [], 0
        for b in batches:
            for x in zip(*[c.to_pylist() for c in b.columns]):
                held.append(record(*x))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield put(held)
                    held, size = [], 0
        if held:
            yield put(held)

    return cut(rows.mapInArrow(run, schema))


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """(archive, page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, payload) for each record of the archives that ``manifest`` names.
    The payload is null for revisits, and where ``payloads`` is not asked for."""
    schema = T.StructType([T.StructField(c, t) for c, t in (("archive", T.StringType()), ("page_id", T.LongType()), ("url", T.StringType()), ("payload_bytes", T.LongType()),
                           ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("payload", T.BinaryType()))])
    names = schema.names

    def number(urn: str | None) -> int | None:
        tail = (urn or "").rstrip(">").rpartition(":")[2]
        return int(tail) if urn and not urn.rstrip(">").endswith(f"none:{tail}") else None

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                for raw in frames(data.as_py()):
                    h, block = parse_record(raw)
                    n, body = payload_of(h, block)
                    rows.append((name, number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), n, h.get("WARC-Payload-Digest", "").removeprefix("sha256:"), h["WARC-Type"],
                                 number(h.get("WARC-Refers-To")), body if payloads else None))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)

    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content").filter(~F.col("archive").startswith("_"))
    return files.mapInArrow(run, schema).join(manifest.select(F.col("name").alias("archive")), "archive", "left_semi")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM r
"""


@query("op3_warc_round_trip", SQL)
def op3(spark, sf_dir):
    folder = shared_folder(spark)
    if folder.startswith("/"):
        folder = f"file://{folder}"
    manifest = write_archives(read(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_archives(spark, folder, manifest).drop("archive", "url", "payload")
