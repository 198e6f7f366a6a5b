r"""WARC archives written and read in parallel (operator 11).

Writing: equal payloads are told by SHA-1 and length; of those of at least ``least`` bytes, the row with the largest id is a
response and the others are revisits of it. Each record is a gzip member of its own. Spark's text sink writes the members as
they are (a string column may hold any bytes) on whatever store the path names, with Spark's commit of finished tasks. It
puts a line separator behind every row; a gzip member ends with the high byte of its length, so that byte is left to the
separator ``\x00``. A record of 16 MiB or more, whose last byte is another one, is followed by an empty member, which ends
in zeros and which readers skip.

Reading: file sizes come from Spark's file listing and are cut into byte ranges, one row each. A task looks for the gzip
magic in its range and takes a place for the start of a record only if what it inflates begins with a WARC version line and
a header block; other places are chance and are passed over. It owns the records that start inside its range, and reads on
beyond its end for the last of them. After a record the search goes on where its member ends. No task holds more than a
piece of a file and one record.

Null html is an empty payload; empty and short payloads are responses. A null id counts as the smallest and leaves its place
in the record's name empty. Rows with equal ids and payloads still give one response: rows are numbered in a written copy.
A null url gives a record without target. Very long payloads are records like others. Empty tables give no archives and no
records. Only the three named columns are read, so further ones cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import cut_lineage, ship_package, table
from quayside.llm.registry import register
from quayside.session import scratch_path

MAGIC = b"\x1f\x8b\x08"
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SALTS = 16


# ---- writing ----


def member(data: bytes, level: int = 6) -> bytes:
    """``data`` as gzip, without the last byte, which is zero."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    packed = packer.compress(data) + packer.flush()
    if packed[-1]:
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        packed += packer.flush()
    return packed[:-1]


def record(kind: str, name: str, url: str | None, digest: str, size: int, payload: bytes, refers: str | None) -> bytes:
    """One WARC record; a revisit holds the header of its response but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (b"" if kind == "revisit" else payload)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for r in rows.itertuples(index=False):
            payload = (r.html or "").encode("utf-8", "surrogatepass")
            out.append(member(record(r.kind, r.name, r.url, r.digest, r.size, payload, r.refers)))
        yield pd.DataFrame({"bytes": out})


def name_of(id_column, rest):
    return F.concat(F.lit("urn:page:"), F.coalesce(id_column.cast("string"), F.lit("")), F.lit(":"), rest)


def deduplicated(pages: DataFrame, least: int = 1000) -> DataFrame:
    """name, url, html, digest, size, kind, refers: what each record holds.

    The response of a payload is the row with the largest (id, url). Rows equal in both are told apart by nothing, so they
    are counted and folded, and come out as one response and the revisits that are left.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    alike = rows.where(F.col("size") >= least).groupBy("digest", "size", "page_id", "url").agg(F.count(F.lit(1)).alias("k"))
    groups = alike.groupBy(F.col("digest").alias("d"), F.col("size").alias("s")).agg(F.sum("k").alias("n"), F.max(F.struct("page_id", "url", "k")).alias("best"))
    groups = cut_lineage(groups.where("n > 1").drop("n"), "payloads")
    # a payload that very many rows share is dealt to several tasks
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")) & (F.col("own_salt") == F.col("salt"))
    joined = rows.withColumn("own_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, same, "left")
    first = F.coalesce(F.col("best").isNotNull() & F.col("page_id").eqNullSafe(F.col("best.page_id")) & F.col("url").eqNullSafe(F.col("best.url")), F.lit(False))
    joined = joined.withColumn("kind", F.when(first | F.col("best").isNull(), "response").otherwise("revisit"))
    kept = ["page_id", "url", "html", "digest", "size", "kind", "best"]
    whole = joined.select(*kept)
    if not groups.where("best.k > 1").isEmpty():
        twin = first & (F.col("best.k") > 1)
        folded = joined.where(twin).groupBy("page_id", "url", "digest", "size").agg(F.first("html").alias("html"), F.first("best").alias("best"))
        folded = folded.withColumn("kind", F.explode(F.concat(F.array(F.lit("response")), F.array_repeat(F.lit("revisit"), (F.col("best.k") - 1).cast("int")))))
        whole = joined.where(~twin).select(*kept).unionByName(folded.select(*kept))
    shared = name_of(F.col("best.page_id"), F.col("digest"))
    revisit = F.col("kind") == "revisit"
    name = F.when(revisit | F.col("best").isNull(), name_of(F.col("page_id"), F.uuid())).otherwise(shared)
    return whole.select(name.alias("name"), "url", F.when(~revisit, F.col("html")).alias("html"), "digest", "size", "kind", F.when(revisit, shared).alias("refers"))


def write_archives(pages: DataFrame, path: str, least: int = 1000) -> None:
    """One archive per task below ``path``; ``spark.sql.files.maxRecordsPerFile`` makes them smaller."""
    ship_package(pages.sparkSession)
    packed = deduplicated(pages, least).mapInPandas(records, "bytes binary")
    packed.select(F.col("bytes").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)


# ---- reading ----


def open_file(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


class Source:
    """A window over a file that moves forward and grows as far as a record needs."""

    def __init__(self, file, start: int, piece: int = 1 << 20):
        self.file, self.base, self.piece, self.data = file, start, piece, bytearray()

    def more(self) -> bool:
        self.file.seek(self.base + len(self.data))
        got = self.file.read(self.piece)
        self.data += got
        return bool(got)

    def have(self, place: int, n: int) -> bool:
        """Read until ``n`` bytes from ``place`` are at hand, if the file has them."""
        while len(self.data) < place - self.base + n:
            if not self.more():
                return False
        return True

    def forget(self, place: int) -> None:
        del self.data[: place - self.base]
        self.base = place

    def inflate(self, place: int, most: int | None = None) -> tuple[bytes, int] | None:
        """The member at ``place`` (or its first ``most`` bytes) and where it ends; None if it is none."""
        unpacker, out, at = zlib.decompressobj(31), bytearray(), place - self.base
        while not unpacker.eof and (most is None or len(out) < most):
            if at >= len(self.data) and not self.more():
                return None
            fed = self.data[at : at + 65536]
            at += len(fed)
            try:
                out += unpacker.decompress(bytes(fed))
            except zlib.error:
                return None
        return bytes(out), self.base + at - len(unpacker.unused_data)


HEAD = 1 << 16


def headers(data: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields by lower-case name and where the block starts, if ``data`` begins like a WARC record."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(b"WARC/"):
        return None
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[key.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return (fields, end + 4) if {"warc-type", "warc-record-id", "content-length"} <= fields.keys() else None


def read_range(file, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, header fields and block of every record that starts in [start, end)."""
    source, place = Source(file, start), start
    while place < end:
        if not source.have(place, len(MAGIC)):
            return
        found = source.data.find(MAGIC, place - source.base)
        if found < 0:
            place = source.base + len(source.data) - len(MAGIC) + 1
            source.forget(place)
            continue
        place = source.base + found
        if place >= end:
            return
        source.forget(place)
        first = source.inflate(place, HEAD)
        if first is None or headers(first[0]) is None:
            place += 1
            continue
        whole = source.inflate(place)
        if whole is None:
            place += 1
            continue
        data, after = whole
        fields, block = headers(data)
        yield place, fields, data[block : block + int(fields["content-length"])]
        place = after


def urn(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def parsed(path: str, place: int, fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind, digest, size, payload = fields["warc-type"], fields.get("warc-payload-digest", ""), None, block
    http, gap, body = block.partition(b"\r\n\r\n")
    if block.startswith(b"HTTP/") and gap:
        payload = body
        for line in http.split(b"\r\n")[1:]:
            key, _, value = line.partition(b":")
            if key.strip().lower() == b"content-length":
                size = int(value)
    told = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") and len(digest) == 37 else None
    if kind == "revisit":
        found, intact = told, None
    else:
        found, size = hashlib.sha1(payload).hexdigest(), len(payload)
        intact = told is None or told == found
    return path, place, urn(fields["warc-record-id"]), kind, fields.get("warc-target-uri"), fields.get("warc-date"), urn(fields.get("warc-refers-to")), size, found, intact, payload if with_payload and kind != "revisit" else None


RECORD = "file string, place long, record_id string, record_type string, target_uri string, date string, refers_to_id string, payload_bytes long, payload_digest string, intact boolean, payload binary"
NAMES = [c.split()[0] for c in RECORD.split(", ")]


def range_reader(with_payload: bool, batch_bytes: int = 1 << 22):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ranges in batches:
            for r in ranges.itertuples(index=False):
                with open_file(r.path) as file:
                    rows, held = [], 0
                    for place, fields, block in read_range(file, r.start, r.stop):
                        rows.append(parsed(r.path, place, fields, block, with_payload))
                        held += len(block) if with_payload else 500
                        if held > batch_bytes:
                            yield pd.DataFrame(rows, columns=NAMES).astype({"payload_bytes": "Int64", "intact": "boolean"})
                            rows, held = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=NAMES).astype({"payload_bytes": "Int64", "intact": "boolean"})

    return read


def read_archives(spark: SparkSession, path: str, range_bytes: int = 64 << 20, with_payload: bool = True) -> DataFrame:
    """One row per record of all archives below ``path``; ``intact`` tells whether a payload has the digest its header names."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    ranges = files.select("path", "length", F.explode(starts).alias("start")).select("path", "start", F.least("length", F.col("start") + range_bytes).alias("stop"))
    # as many tasks as ranges: by size alone Spark would put these few rows into one
    return ranges.repartition(max(1, ranges.count())).mapInPandas(range_reader(with_payload), RECORD)


def id_of(urn_column):
    return F.expr("nullif(split_part({0}, ':', 3), '')".format(urn_column)).cast("long")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS k,
  max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN k > 1 AND strlen(html) >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k > 1 AND strlen(html) >= 1000 THEN best END AS refers_to FROM p
"""


@register("op11_warc_round_trip", ORACLE)
def op11_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, folder, "pages"), path)
    back = read_archives(spark, path, with_payload=False)
    return back.select(id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", id_of("refers_to_id").alias("refers_to"))
