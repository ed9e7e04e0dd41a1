"""Web archives in ZIP packages: writer, and a reader that fetches single records by byte ranges.

A package holds ``archive/data.warc.gz`` (each record a gzip member of its own),
``indexes/index.cdxj`` (a line per record, sorted by its key: URL key, time and a JSON object) and ``datapackage.json``, all stored
without compression, so that a record's bytes lie in one range of the package. The reader takes all
stored files below ``archive/`` and all indexes, ``.cdxj`` and ``.cdx``, below ``indexes/``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Ranges, by_file, create, shared_folder, stored, task_file

# Fixed values of the ZIP and WARC formats.
END, END64, LOCATOR, CENTRAL, LOCAL = (
    b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04",
)
ARCHIVE, INDEX, PACKED = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # the pages have no time of capture

PACKAGE = 64 << 20  # bytes of records after which a task begins a new package


@dataclass(frozen=True)
class Member:
    """A file in a package: where its data lie, and how they are packed (0: stored)."""

    name: str
    start: int
    size: int
    method: int


def members(read: Ranges) -> dict[str, Member]:
    """The members of a package, from its central directory; ZIP64 fields are followed."""
    tail_size = min(read.size, (1 << 16) + 22 + 20)
    tail = read(read.size - tail_size, tail_size)
    at = tail.rfind(END)
    # The signature may stand in the comment as well; the true one is followed by a comment up to the file's end.
    while at >= 0 and (at + 22 > tail_size or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != tail_size):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if 0xFFFFFFFF in (size, start) or count == 0xFFFF:
        locator = tail[at - 20 : at]
        if locator[:4] == LOCATOR:
            (place,) = struct.unpack("<Q", locator[8:16])
            head = read(place, 56)
            if head[:4] != END64:
                raise ValueError("no ZIP64 end of central directory")
            count, size, start = struct.unpack("<QQQ", head[32:56])
    directory, found, at = read(start, size), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("damaged central directory")
        method, = struct.unpack_from("<H", directory, at + 10)
        packed, plain, n, extra, comment = struct.unpack_from("<IIHHH", directory, at + 20)
        offset, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n].decode()
        wide = _wide(directory[at + 46 + n : at + 46 + n + extra], [plain, packed, offset])
        plain, packed, offset = wide
        local = read(offset, 30)
        if local[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        local_name, local_extra = struct.unpack("<HH", local[26:30])
        found[name] = Member(name, offset + 30 + local_name + local_extra, packed, method)
        at += 46 + n + extra + comment
    return found


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Sizes and offset, each that is all ones taken from the ZIP64 extra field, in that order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            body, k = extra[at + 4 : at + 4 + size], 0
            for i, v in enumerate(values):
                if v == 0xFFFFFFFF:
                    (values[i],) = struct.unpack_from("<Q", body, k)
                    k += 8
        at += 4 + size
    return values


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _headers(first: str, fields: list[tuple[str, str]]) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    """The page of a record's name; names that others gave have none."""
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def url_key(url: str) -> str:
    """The key by which indexes are sorted: the host's labels from the last one on, then the path, in lower case."""
    rest = url.lower().partition("://")[2] or url.lower()
    host, slash, path = rest.partition("/")
    labels = host.partition(":")[0].removeprefix("www.").split(".")
    return quote(",".join(reversed(labels)) + ")" + slash + path, safe="!$&'()*+,-./:;=?@_~%")


def index_entries(name: str, text: str) -> Iterator[dict]:
    """Entries of an index: url, filename ("" if it has none), offset and length of each record.

    A .cdx file begins with a legend that names its columns: a (URL), g (file), V (offset) and S (length); the lines of
    other indexes end in a JSON object.
    """
    lines = [x for x in text.split("\n") if x.strip()]
    if name.endswith(".cdx"):
        legend = lines[0].split()[1:] if lines else []
        for line in lines[1:]:
            found = dict(zip(legend, line.split()))
            yield {"url": found.get("a"), "filename": found.get("g", ""), "offset": int(found["V"]), "length": int(found["S"])}
        return
    for line in lines:
        if line.startswith("!"):  # a header of the index itself
            continue
        found = json.loads(line[line.index("{") :])
        yield {"url": found.get("url"), "filename": found.get("filename", ""), "offset": int(found["offset"]), "length": int(found["length"])}


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member; a revisit has the answer's headers and no payload."""
    answer = _headers("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    body = answer if revisit else answer + payload
    clean = "".join(c for c in url or "" if c.isprintable() and c != " ")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", DATE),
        ("WARC-Target-URI", clean), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
    ]
    if revisit:
        fields += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return gzip.compress(_headers("WARC/1.1", fields) + body + b"\r\n\r\n", 1, mtime=0)


def parse(raw: bytes) -> dict:
    """A record from its gzip member: WARC fields, answer fields and payload; only HTTP messages have answer fields."""
    data = gzip.decompress(raw)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.partition(":")[::2] for x in lines)
    fields = {k: v.strip() for k, v in fields.items()}
    payload, answer = rest[: int(fields["Content-Length"])], {}
    if fields.get("Content-Type", "").startswith("application/http"):
        said, _, payload = payload.partition(b"\r\n\r\n")
        answer = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in said.decode("latin-1").split("\r\n")[1:])}
    return {"fields": fields, "answer": answer, "payload": payload}


class _Package:
    """A package being written as a stream; holds the index lines of its records."""

    def __init__(self, uri: str):
        self.uri, self.size, self._lines, self._sum = uri, 0, [], hashlib.sha256()
        self._out = create(uri)
        self._zip = zipfile.ZipFile(_Forward(self._out), "w", zipfile.ZIP_STORED, allowZip64=True)
        self._archive = self._zip.open(ARCHIVE, "w", force_zip64=True)

    def add(self, page_id: int | None, url: str | None, raw: bytes) -> None:
        self._archive.write(raw)
        self._sum.update(raw)
        entry = {
            "url": url, "filename": ARCHIVE.rpartition("/")[2], "offset": str(self.size), "length": str(len(raw)), "page": page_id
        }
        stamp = "".join(c for c in DATE if c.isdigit())
        self._lines.append(f"{url_key(url or '')} {stamp} {json.dumps(entry)}")
        self.size += len(raw)

    def close(self) -> None:
        self._archive.close()
        index = "\n".join(sorted(self._lines)).encode()
        self._zip.writestr(INDEX, index)
        sums = [(ARCHIVE, self.size, self._sum.hexdigest()), (INDEX, len(index), hashlib.sha256(index).hexdigest())]
        resources = [
            {"name": path.rpartition("/")[2], "path": path, "bytes": size, "hash": f"sha256:{value}"} for path, size, value in sums
        ]
        self._zip.writestr(PACKED, json.dumps({"profile": "data-package", "resources": resources, "wacz_version": "1.1.1"}))
        self._zip.close()
        self._out.close()


class _Forward(io.RawIOBase):
    """A stream that can only be written on, as object stores have it."""

    def __init__(self, out):
        self._out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self._out.write(bytes(data))
        return len(data)


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, payload binary) with ``record_type`` and ``refers_to``.

    Of records with equal payloads of ``min_bytes`` or more, that with the largest page_id is the response and
    the others revisit it; smaller ones are all responses. Rows that repeat the largest page_id are responses too;
    a null page_id counts as less than any. Payloads are told apart by SHA-256 and size. The largest id is found by
    an aggregation that combines on the map side, and joined back to a side with one row per payload, so a payload
    that a third of all pages share is split by adaptive execution.
    """
    keyed = pages.withColumn("_sum", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    large = keyed.filter(F.col("payload_bytes") >= min_bytes)
    first = large.groupBy("_sum", "payload_bytes").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n"))
    first = first.filter("_n > 1")
    both = keyed.join(first, ["_sum", "payload_bytes"], "left")
    revisit = F.col("_n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return both.select(
        "page_id", "url", "payload",
        F.when(revisit, F.lit("revisit")).otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def write_packages(records: DataFrame, folder: str) -> DataFrame:
    """Write records (see :func:`mark_revisits`) to packages, one or more per partition; the table of packages.

    Memory: one record and the index lines of a package of at most ``PACKAGE`` bytes. The table is written, and
    names only packages of finished tasks, so a repeated task leaves no record twice.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, made = None, []
        for batch in batches:
            columns = [batch[c] for c in ("page_id", "url", "payload", "record_type", "refers_to")]
            for row in range(len(batch)):
                page_id, url, payload, kind, refers_to = (c[row].as_py() for c in columns)
                if package is None or package.size >= PACKAGE:
                    if package is not None:
                        package.close()
                    package = _Package(task_file(folder, ".wacz", len(made)))
                    made.append(package.uri)
                package.add(page_id, url, record(page_id, url, payload, refers_to, kind == "revisit"))
        if package is not None:
            package.close()
            yield pa.RecordBatch.from_pydict({"package": made})

    return stored(records.mapInArrow(write, "package string"), "packages")


def read_packages(packages: DataFrame) -> DataFrame:
    """All records of packages: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).

    Each package is opened by its directory; its indexes are read, then each record by its own range, a record that several
    indexes name once. Responses, resources and revisits are given. Size and digest
    are those of the full payload: a response's are worked out and held against its headers where it has them, a revisit's come from
    its headers. Records of other writers have no page_id; their refers_to is null as well.
    """
    schema = (
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, payload binary"
    )

    def rows(uri: str) -> Iterator[dict]:
        with Ranges(uri) as read:
            found = members(read)
            archives = {n.removeprefix("archive/"): m for n, m in found.items() if n.startswith("archive/") and not n.endswith("/")}
            indexes = {n: m for n, m in found.items() if n.startswith("indexes/") and n.endswith((".cdxj", ".cdx", ".json"))}
            if any(m.method for m in [*archives.values(), *indexes.values()]):
                raise ValueError("packed members cannot be read by range")
            done: set[tuple[str, int]] = set()
            for name, index in indexes.items():
                for entry in index_entries(name, read(index.start, index.size).decode()):
                    file = entry["filename"].removeprefix("archive/") or next(iter(archives))
                    if (file, entry["offset"]) in done:
                        continue
                    done.add((file, entry["offset"]))
                    got = parse(read(archives[file].start + entry["offset"], entry["length"]))
                    if got["fields"]["WARC-Type"] in ("response", "resource", "revisit"):
                        yield row(entry["url"], **got)

    def row(url: str | None, fields: dict, answer: dict, payload: bytes) -> dict:
        revisit = fields["WARC-Type"] == "revisit"
        size, value = answer.get("content-length"), fields.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
        if not revisit:
            own = digest(payload)
            ours = fields.get("WARC-Record-ID", "").startswith("<urn:page:")
            if (ours and int(size) != len(payload)) or (value is not None and fields["WARC-Payload-Digest"].startswith("sha1:") and value != own):
                raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
            size, value = len(payload), own
        return {
            "page_id": _page(fields.get("WARC-Record-ID", "")), "url": url, "payload_bytes": None if size is None else int(size),
            "payload_digest": value, "record_type": fields["WARC-Type"],
            "refers_to": _page(fields.get("WARC-Refers-To", "")) if revisit else None, "payload": None if revisit else payload,
        }

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
        ])
        for batch in batches:
            for uri in batch["package"].to_pylist():
                held, size = [], 0
                for row in rows(uri):
                    held.append(row)
                    size += row["payload_bytes"] or 0
                    if size >= 4 << 20 or len(held) == 1000:
                        yield pa.RecordBatch.from_pylist(held, form)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, form)

    return by_file(packages, "package").mapInArrow(read, schema)


def package_folder(spark: SparkSession) -> str:
    return shared_folder(spark, "wacz")
