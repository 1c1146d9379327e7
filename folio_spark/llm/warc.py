"""WARC: a PySpark Python data source that writes and reads web archives.

Reading plans file partitions (small files share one), takes predicates on the record type and other header fields
off Spark, parses a record's header first and then either skips the block or decodes it. Gzip members carry the
'sl' extra field with their length, so a block that nobody asked for is passed by a seek, without inflating it. A
schema without `payload` asks for no block at all.

Each task writes its own files; commit() lists them in a manifest, and readers of the folder take only listed
files, so what a lost or repeated task left behind is never read. A folder without manifest is read whole.

Defined results: an empty folder reads as no rows, and an empty table writes a folder without records; null header values
are left out; a null payload is an empty one; a payload of any length is one record, read in one piece; repeated rows
are records of their own, and of equal payloads with equal largest page_id one is the response and the others revisit it;
columns other than the header fields' and payload are not written.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

#: Column -> header field. `page_id` and `payload_length` are extension fields.
FIELDS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "page_id": "Page-Id", "payload_length": "Payload-Length"}
SCHEMA = T.StructType([*(T.StructField(c, T.StringType()) for c in FIELDS), T.StructField("payload", T.BinaryType())])
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes after which a writer begins another file, and files that share a read partition.
ROLL, SPLIT = 128 << 20, 64 << 20
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member whose extra field 'sl' holds its own length and that of what it inflates to."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    extra = b"sl" + struct.pack("<HII", 8, 12 + 12 + len(body) + 8, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    """A WARC/1.1 record; the block of a response is an HTTP response, that of other types the payload itself."""
    payload, kind = row.get("payload") or b"", row.get("warc_type") or "resource"
    clean = lambda v: str(v).replace("\r", " ").replace("\n", " ")
    lines = [f"{FIELDS[c]}: {clean(row[c])}" for c in FIELDS if row.get(c) is not None and c != "warc_type"]
    if kind == "response":
        lines.append("Content-Type: application/http; msgtype=response")
        payload = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    elif kind == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
        payload = b""
    head = "\r\n".join(["WARC/1.1", f"WARC-Type: {kind}", *lines, f"Content-Length: {len(payload)}"])
    return head.encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_header(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def records(f, size: int, wanted, blocks: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(header, block) of each record whose header is wanted; block is None unless asked for."""
    at = 0
    while at < size:
        f.seek(at)
        chunk = f.read(8192)
        if chunk[:2] == b"\x1f\x8b":
            length = None
            if chunk[3] & 4:
                n = struct.unpack_from("<H", chunk, 10)[0]
                extra = chunk[12 : 12 + n]
                if extra[:2] == b"sl":
                    length = struct.unpack_from("<I", extra, 4)[0]
            inflater = zlib.decompressobj(31)
            data = inflater.decompress(chunk, 65536)
            while b"\r\n\r\n" not in data and not inflater.eof and (rest := inflater.unconsumed_tail or f.read(8192)):
                data += inflater.decompress(rest, 65536)
            head, _, block = data.partition(b"\r\n\r\n")
            header = parse_header(head)
            take = wanted(header)
            if length is None or (take and blocks):
                parts = [block]
                if length is not None:
                    f.seek(at)
                    whole = zlib.decompress(f.read(length), 31)
                    parts = [whole[len(head) + 4 :]]
                else:
                    while not inflater.eof and (rest := inflater.unconsumed_tail or f.read(1 << 20)):
                        got = inflater.decompress(rest, 1 << 20)
                        if take and blocks:
                            parts.append(got)
                    length = f.tell() - at - len(inflater.unused_data)
                block = b"".join(parts)
            at += length
            if take:
                yield header, block[: int(header.get("content-length", 0))] if blocks else None
        else:
            while b"\r\n\r\n" not in chunk and (more := f.read(8192)):
                chunk += more
            begin = len(chunk) - len(chunk.lstrip(b"\r\n"))
            end = chunk.find(b"\r\n\r\n", begin)
            if end < 0:
                return
            header = parse_header(chunk[begin:end])
            n = int(header.get("content-length", 0))
            if wanted(header):
                f.seek(at + end + 4)
                yield header, f.read(n) if blocks else None
            at += end + 4 + n + 4


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.equal = schema, options["path"], {}
        self.split = int(options.get("splitBytes", SPLIT))

    def pushFilters(self, filters: list[Filter]):
        for x in filters:
            column = x.attribute[0] if len(x.attribute) == 1 else None
            if column in FIELDS and isinstance(x, (EqualTo, In)):
                values = {x.value} if isinstance(x, EqualTo) else set(x.value)
                self.equal[column] = self.equal.get(column, values) & values
            elif not (column in FIELDS and isinstance(x, IsNotNull) and column in self.equal):
                yield x

    def partitions(self) -> Sequence[Files]:
        from pyarrow import fs

        store, root = filesystem(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        manifests = [x.path for x in found if x.base_name.startswith("_manifest-")]
        listed = None
        if manifests:
            listed = set()
            for m in manifests:
                with store.open_input_file(m) as f:
                    listed.update(json.loads(f.read()))
        files = sorted((x for x in found if x.is_file and x.base_name.endswith((".warc", ".warc.gz")) and (listed is None or x.base_name in listed)), key=lambda x: x.path)
        out, names, total = [], [], 0
        for x in files:
            if names and total + x.size > self.split:
                out.append(Files(tuple(names)))
                names, total = [], 0
            names.append(x.path)
            total += x.size
        return [*out, Files(tuple(names))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(self.path)
        columns = self.schema.names
        names = {c: FIELDS[c].lower() for c in FIELDS}
        wanted = lambda h: all(h.get(names[c]) in v for c, v in self.equal.items())
        kinds = pa.schema([(c, pa.binary() if c == "payload" else pa.string()) for c in columns])
        rows: list[list] = [[] for _ in columns]
        held = 0
        for name in partition.names:
            with store.open_input_file(name) as f:
                for header, block in records(f, f.size(), wanted, "payload" in columns):
                    if block is not None and header.get("content-type", "").startswith("application/http"):
                        block = block.partition(b"\r\n\r\n")[2]
                    for i, c in enumerate(columns):
                        rows[i].append(block if c == "payload" else header.get(names[c]))
                    held += len(block or b"")
                    if len(rows[0]) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(rows, kinds)], schema=kinds)
                        rows, held = [[] for _ in columns], 0
        if rows and rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(rows, kinds)], schema=kinds)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = filesystem(self.path)
        store.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        try:
            for b in iterator:
                for i in range(b.num_rows):
                    if out is None or size > ROLL:
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                    data = member(record({c: b.column(k)[i].as_py() for k, c in enumerate(b.schema.names)}))
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(tuple(names))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.path)
        for m in messages:
            for n in m.names if m else ():
                store.delete_file(f"{root}/{n}")


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(path), df.write.format("warc").mode("append").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", html_col: str = "html", least: int = 1000, url_col: str = "url") -> None:
    """Write a record per page, dated now, of its URL (where the table has none, of its record's id). Of equal payloads of at least `least` bytes the one with the largest id is a response
    (each of them, if that id repeats) and the others revisit it. A null id never is the largest if there is another."""
    url = F.nullif(F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7F]", ""), F.lit("")) if url_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).alias("_id"), url.alias("_url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("_id", "_url", "payload", F.sha1("payload").alias("_sha"), F.length("payload").alias("_len"))
    keys = rows.select("_id", "_sha", "_len").where(F.col("_len") >= least)
    largest = keys.groupBy("_sha").agg(F.max("_id").alias("_max"), F.count("*").alias("_n")).where("_n > 1 and _max is not null").select("_sha", "_max")
    again = keys.join(largest, "_sha").where(~F.col("_id").eqNullSafe(F.col("_max"))).select(F.col("_id").alias("_i"), F.col("_sha").alias("_s"), "_max").distinct()
    # Payloads move by their own ids, which are spread evenly however many of them are equal.
    marked = rows.join(again, rows["_id"].eqNullSafe(again["_i"]) & (rows["_sha"] == again["_s"]), "left")
    revisit = F.col("_max").isNotNull()
    page = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    name = F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("null:"), F.col("_sha")))
    marked.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        page(name).alias("record_id"),
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.coalesce(F.col("_url"), F.concat(F.lit("urn:page:"), name)).alias("target_uri"),
        F.when(revisit, page(F.col("_max"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), F.col("_sha")).alias("payload_digest"),
        F.col("_id").cast("string").alias("page_id"),
        F.col("_len").cast("string").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def prepare(spark) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    from .common import new_path

    prepare(spark)
    path = new_path(spark, "warc")
    archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    whole = spark.read.format("warc").load(path).where("warc_type = 'response'")
    heads = spark.read.format("warc").schema(T.StructType([f for f in SCHEMA if f.name != "payload"])).load(path).where("warc_type = 'revisit'")
    page_id = F.col("page_id").cast("long").alias("page_id")
    full = whole.select(page_id, F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    known = heads.select(page_id, F.col("payload_length").cast("long").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), F.col("warc_type").alias("record_type"), F.regexp_extract("refers_to", r"^<urn:page:(-?\d+)>$", 1).cast("long").alias("refers_to"))
    return full.unionByName(known)


OP10_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
     m AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN last IS NULL OR page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last IS NULL OR page_id IS NOT DISTINCT FROM last THEN NULL ELSE last END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d AND p.n >= 1000
"""
