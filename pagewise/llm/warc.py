"""WARC archives with a two-level capture index.

Write. One gzip member per record; of equal payloads the capture with the
largest page id is a response, the others are revisits of it. Every task writes
archive files of its own under the shared folder and returns one index row per
record; the index table names only files of tasks that succeeded.

Index. Rows are range-partitioned and sorted by reversed-host URL key
(``com,example,www)/path``) and page id. Every partition writes one file of
gzip blocks of ``BLOCK_LINES`` lines; the sparse directory has the first key,
place and length of each block.

Lookup. A key is routed to its partition by the partitions' first keys, found
in the partition's directory by binary search, and read with one range read of
a block and one of the record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewise.session import cut_lineage, shared_path

BLOCK_LINES = 1000
PART_LINES = 100_000  # index lines of a partition, at most about
FILE_BYTES = 1 << 30
READ_AHEAD = 1 << 20
GZIP_LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = -(1 << 63)  # place of a null page id in the index

_URL = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^#]*)", re.S)
_PRINTABLE = "".join(chr(c) for c in range(33, 127))


def url_key(url: str | None) -> str:
    """Reversed-host key of a URL; blanks and control characters are escaped."""
    m = _URL.match(url or "")
    if not m:
        return quote(url or "", safe=_PRINTABLE, errors="replace")
    host, _, port = m.group(1).rpartition("@")[2].lower().partition(":")
    labels = ",".join(reversed(host.split(".")))
    return quote(f"{labels}{':' + port if port else ''}){m.group(2) or '/'}", safe=_PRINTABLE, errors="replace")


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>"


def _page_of(urn: str | None) -> int | None:
    value = urn[len("<urn:page:"):-1] if urn else "None"
    return None if value == "None" else int(value)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           revisit: bool, level: int = GZIP_LEVEL) -> bytes:
    """One compressed WARC/1.1 record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe=_PRINTABLE, errors='replace')}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    raw = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and the payload (empty for a revisit) of a compressed record."""
    raw = zlib.decompress(member, 31)
    cut = raw.index(b"\r\n\r\n")
    lines = raw[:cut].decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = raw[cut + 4:cut + 4 + int(fields["Content-Length"])]
    return fields, block[block.index(b"\r\n\r\n") + 4:]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


_INDEX = "surt string, place long, page_id long, file string, offset long, length long"


def _write(folder: str, level: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        out, name, at = None, "", 0
        for b in batches:
            rows = []
            payloads = b.column("html").cast(pa.binary())
            for k, (page_id, url, sha, top) in enumerate(zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "sha", "top")))):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name = f"records-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, at = store.open_output_stream(f"{root}/{name}", compression=None), 0
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                member = record(page_id, url, payloads[k].as_py(), digest, top, top is not None and page_id != top, level)
                out.write(member)
                rows.append((url_key(url), NO_ID if page_id is None else page_id, page_id, name, at, len(member)))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(),
                                                                 pa.int64(), pa.int64()))],
                    names=["surt", "place", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()
    return run


def _write_index(folder: str, block_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        part = TaskContext.get().partitionId()
        name = f"index-{part:06d}-{uuid.uuid4().hex}.cdxj.gz"
        blocks, lines, out, at = [], [], None, 0

        def flush() -> None:
            nonlocal out, at
            if out is None:
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            block = z.compress("".join(x for _, _, x in lines).encode()) + z.flush()
            out.write(block)
            blocks.append((part, lines[0][0], lines[0][1], name, at, len(block)))
            at += len(block)
            lines.clear()

        for b in batches:
            for surt, place, page_id, file, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                tail = json.dumps({"page_id": page_id, "file": file, "offset": offset, "length": length})
                lines.append((surt, place, f"{surt} {place} {tail}\n"))
                if len(lines) >= block_lines:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks), kinds)],
                                             names=["part", "surt", "place", "file", "offset", "length"])
    return run


@dataclass
class Archive:
    folder: str
    keys: DataFrame  # surt, place, page_id of every record
    directory: DataFrame  # part, surt, place, file, offset, length of every index block


def archive(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
            payload_col: str = "html", block_lines: int = BLOCK_LINES, part_lines: int = PART_LINES,
            file_bytes: int = FILE_BYTES, level: int = GZIP_LEVEL) -> Archive:
    """Write ``pages`` as archives with their index.

    Defined results: a null payload is empty; a null URL is the empty URL; of
    equal payloads the largest id is the response (all rows that repeat it are),
    and if none has an id, all are responses; other columns are not read; an
    empty table gives an archive without records.
    """
    folder = shared_path(spark, "warc")
    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"))
    marked = rows.withColumn("sha", F.sha1("html"))
    tops = rows.select("page_id", F.sha1("html").alias("sha")).groupBy("sha").agg(F.max("page_id").alias("top"))
    marked = marked.join(tops.hint("shuffle_hash"), "sha").select("page_id", "url", "html", "sha", "top")
    index = cut_lineage(marked.mapInArrow(_write(folder, level, file_bytes), _INDEX), "warc_index")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // part_lines))
    spread = index.repartitionByRange(parts, "surt", "place").sortWithinPartitions("surt", "place")
    blocks = spread.mapInArrow(_write_index(folder, block_lines),
                               "part long, surt string, place long, file string, offset long, length long")
    return Archive(folder, index.select("surt", "place", "page_id"), cut_lineage(blocks, "warc_directory"))


def _find(folder: str):
    """The index lines of the keys of one partition."""
    def run(keys: pa.Table, blocks: pa.Table) -> pa.Table:
        kinds = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        if not keys.num_rows or not blocks.num_rows:
            return kinds.empty_table()
        store, root = _open(folder)
        ordered = sorted(zip(*(blocks[c].to_pylist() for c in ("surt", "place", "offset", "file", "length"))))
        firsts = [(surt, place) for surt, place, *_ in ordered]
        places = [(file, offset, length) for _, _, offset, file, length in ordered]
        held: dict[int, dict[tuple[str, int], list[dict]]] = {}
        files: dict[str, pa.NativeFile] = {}
        out = []
        for key in sorted(set(zip(keys["surt"].to_pylist(), keys["place"].to_pylist()))):
            first, last = max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key) - 1
            for k in range(first, last + 1):
                if k not in held:
                    for old in [x for x in held if x < first]:
                        del held[old]
                    file, offset, length = places[k]
                    if file not in files:
                        files[file] = store.open_input_file(f"{root}/{file}")
                    lines = zlib.decompress(files[file].read_at(length, offset), 31).decode().splitlines()
                    found: dict[tuple[str, int], list[dict]] = {}
                    for line in lines:
                        surt, place, tail = line.split(" ", 2)
                        found.setdefault((surt, int(place)), []).append(json.loads(tail))
                    held[k] = found
                out += [(e["file"], e["offset"], e["length"]) for e in held[k].get(key, ())]
        for f in files.values():
            f.close()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds.types)], schema=kinds) if out else kinds.empty_table()
    return run


def _read(folder: str, read_ahead: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        name, source, size, base, chunk = None, None, 0, 0, b""
        for b in batches:
            rows = []
            for file, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{root}/{file}")
                    size, base, chunk = source.size(), 0, b""
                if not (base <= offset and offset + length <= base + len(chunk)):
                    base, chunk = offset, source.read_at(min(max(length, read_ahead), size - offset), offset)
                fields, payload = parse(chunk[offset - base:offset - base + length])
                response = fields["WARC-Type"] == "response"
                rows.append((_page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"],
                             digest32(payload) if response else fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                             len(payload) if response else None, _page_of(fields.get("WARC-Refers-To"))))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)],
                names=["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to"])
        if source is not None:
            source.close()
    return run


def lookup(held: Archive, keys: DataFrame, read_ahead: int = READ_AHEAD) -> DataFrame:
    """The records of ``keys`` (``surt, place``; repeated keys count once), read
    from the archives: ``page_id, url, record_type, payload_digest,
    payload_bytes`` (null for revisits, which hold no payload) and ``refers_to``."""
    firsts = [(r["first"]["surt"], r["first"]["place"], r["part"]) for r in
              held.directory.groupBy("part").agg(F.min(F.struct("surt", "place")).alias("first")).collect()]
    firsts.sort()  # one entry for each index partition
    edge, parts = [(s, p) for s, p, _ in firsts], [x for _, _, x in firsts]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            surt, place = b.column("surt").to_pylist(), b.column("place").to_pylist()
            part = [parts[max(0, bisect_right(edge, k) - 1)] if parts else 0 for k in zip(surt, place)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), b.column("surt"), b.column("place")],
                                             names=["part", "surt", "place"])

    routed = keys.select("surt", "place").distinct().mapInArrow(route, "part long, surt string, place long")
    found = routed.groupBy("part").cogroup(held.directory.groupBy("part")).applyInArrow(
        _find(held.folder), "file string, offset long, length long")
    # as many readers as partitions: rows are small, but each stands for a range read
    readers = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = found.repartition(readers, "file").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_read(held.folder, read_ahead), "page_id long, url string, record_type string, "
                              "payload_digest string, payload_bytes long, refers_to long")


def round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Write ``pages``, look every capture up in the index and read it back: one
    row per page with ``page_id, payload_bytes, payload_digest, record_type,
    refers_to``. A revisit's payload size is that of the response it refers to."""
    held = archive(spark, pages, **options)
    got = cut_lineage(lookup(held, held.keys), "captures")
    sizes = (got.where("record_type = 'response'").groupBy("payload_digest")
             .agg(F.max("payload_bytes").alias("response_bytes")))
    own = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisits = got.where("record_type = 'revisit'").drop("payload_bytes").join(sizes, "payload_digest")
    return (got.where("record_type = 'response'").select(*own)
            .unionByName(revisits.withColumnRenamed("response_bytes", "payload_bytes").select(*own)))
