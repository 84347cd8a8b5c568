"""WARC archives with a two-level capture index.

Records are written as gzip members by the tasks that hold the pages, one archive file a task; a record's capture line
is its reversed-host URL key, page id and place. Capture lines are range-sorted by key and page id and cut into
compressed blocks of BLOCK_LINES lines. The sparse directory holds one line a block (first and last key and page id,
place), in one file for each sorting task; the list of those files, one line a task, is the only part that is held
whole. A lookup of a key, or of a key and page id, bisects that list, binary-searches one directory file (range reads of
a few hundred bytes), range-reads the block, bisects its lines, and range-reads the record.

A task's files carry a random name; only files named in the rows of tasks that finished are ever read, so repeated or
lost attempts do no harm.

Results: a null payload is empty; a null URL has the key ")"; a null page id is an empty field and of equal payloads
comes last; blanks, control characters and line separators are percent-encoded in keys and target URIs (a header of
its own keeps such a URL as it was); ports other than the scheme's own and the case of paths are part of a key; equal
URLs and equal page ids are told apart by their place in the index; of equal payloads of at least `least` bytes that
with the smallest page id is `response`, the others `revisit` it; an empty table gives empty archives; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.llm.common import fresh_path, stored

BLOCK_LINES = 3000
#: Blanks, control characters, line and paragraph separators.
UNSAFE = re.compile("[\\s\\x00-\\x20\\x7f-\\x9f]")
CAPTURE = "key string, page_id long, file string, offset long, length long"
DIRECTORY = "first string, last string, file string, size long, blocks long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, port if it is not the scheme's, then `)`, path and query: sorts a site's
    captures together."""
    url = (url or "").strip()
    parts = urlsplit(url if "//" in url else "//" + url) if _splits(url) else None
    if parts is None:
        return escaped(")" + url)
    host, _, port = parts.netloc.rpartition("@")[2].lower().partition(":")
    host = host.removeprefix("www.")
    port = "" if port == {"http": "80", "https": "443"}.get(parts.scheme.lower()) else port
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return escaped(",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + rest)


def escaped(key: str) -> str:
    return UNSAFE.sub(lambda m: quote(m[0], safe=""), key)


def _splits(url: str) -> bool:
    try:
        urlsplit(url if "//" in url else "//" + url)
    except ValueError:
        return False
    return True


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def number(text: str | None) -> int | None:
    return int(text) if text else None


def record_id(page_id: int | None, digest_: str, *place: object) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, (page_id, digest_, *place)))).urn}>"


def member(head: list[str], body: bytes) -> bytes:
    """One record as a gzip member."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def information(name: str) -> bytes:
    """The record at the head of an archive file."""
    return member(["WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(None, name)}", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")


DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, place: str = "") -> bytes:
    """A response with its HTTP head, or (first: the page that this one's payload repeats) a revisit with the head alone.

    A response's id follows from page id and payload, so that revisits can name it; a revisit's also from its place.
    """
    said, target = digest(payload), escaped(url or "")
    own = record_id(page_id, said) if first is None else record_id(page_id, said, place)
    return member([
        f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", *([f"X-URL: {json.dumps(url)}"] if target != (url or "") else []),
        f"WARC-Payload-Digest: sha1:{said}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: {record_id(first, said)}", f"X-Refers-To-Page: {first}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if first is not None else []),
        "Content-Type: application/http;msgtype=response",
    ], HTTP.format(len(payload)).encode() + (b"" if first is not None else payload))


def parse(raw: bytes) -> dict:
    head, _, body = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = body[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    return {
        "page_id": number(fields["X-Page-ID"]), "url": json.loads(fields["X-URL"]) if "X-URL" in fields else fields["WARC-Target-URI"], "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": said,
        "record_type": fields["WARC-Type"], "refers_to": number(fields.get("X-Refers-To-Page")), "intact": fields["WARC-Type"] == "revisit" or digest(payload) == said, "payload": payload,
    }


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def first_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """(digest, size, first, n): payloads that several pages share; counted before the shuffle, however often one repeats."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    small = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    return small.where(F.col("size") >= least).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")


def write(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives of pages (page_id, url, html); gives their capture lines (stored)."""
    folder = fresh_path(pages.sparkSession, "warc")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    payload = F.encode("html", "utf-8")
    keyed = own.withColumn("digest", F.sha1(payload)).withColumn("size", F.octet_length(payload))
    # payloads are dealt by digest but never sorted: the side of repeated digests is hashed, and holds no payload
    shared = first_pages(own, least).select("digest", "size", "first").hint("shuffle_hash")
    marked = keyed.join(shared, ["digest", "size"], "left").select("page_id", "url", "html", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        store.create_dir(path)
        name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for b in batches:
                rows = []
                for i in range(0, b.num_rows, 64):
                    for page, url, html, first in zip(*(c.to_pylist() for c in b.slice(i, 64).columns), strict=True):
                        if out is None:
                            out = store.open_output_stream(f"{path}/{name}", compression=None)
                            out.write(start := information(name))
                            at = len(start)
                        data = record(page, url, (html or "").encode(), first, f"{name} {at}")
                        out.write(data)
                        rows.append((url_key(url), page, name, at, len(data)))
                        at += len(data)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["key", "page_id", "file", "offset", "length"])
        finally:
            if out:
                out.close()

    captures = stored(marked.mapInArrow(run, CAPTURE), "captures")
    return captures.withColumn("folder", F.lit(folder))


def index(captures: DataFrame) -> tuple[list[tuple], str]:
    """The capture index: its list of directory files, in key order, as (first, last, file, size, blocks), and its folder.

    The list has a row for each sorting task, however many captures there are in one.
    """
    spark = captures.sparkSession
    folder = fresh_path(spark, "capture-index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        store.create_dir(path)
        name, at, out, held, lines = uuid.uuid4().hex, 0, None, [], None
        first = last = None
        size = blocks = 0

        def block() -> None:
            nonlocal at, out, lines, first, last, size, blocks
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = pack.compress("".join(f"{k} {shown(p)} {f} {o} {n}\n" for k, p, f, o, n in held).encode()) + pack.flush()
            if out is None:
                out = store.open_output_stream(f"{path}/{name}.idx.gz", compression=None)
                lines = store.open_output_stream(f"{path}/{name}.dir", compression=None)
            out.write(data)
            last = f"{held[-1][0]} {shown(held[-1][1])}"
            first = first or f"{held[0][0]} {shown(held[0][1])}"
            lines.write(line := f"{held[0][0]} {shown(held[0][1])} {last} {at} {len(data)}\n".encode())
            at, size, blocks = at + len(data), size + len(line), blocks + 1
            held.clear()

        try:
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    held.append(row)
                    if len(held) >= BLOCK_LINES:
                        block()
            if held:
                block()
        finally:
            for stream in (out, lines):
                if stream:
                    stream.close()
        if blocks:
            yield pa.RecordBatch.from_pylist([{"first": first, "last": last, "file": name, "size": size, "blocks": blocks}], schema=pa.schema([("first", pa.string()), ("last", pa.string()), ("file", pa.string()), ("size", pa.int64()), ("blocks", pa.int64())]))

    rows = captures.select("key", "page_id", "file", "offset", "length").orderBy(F.encode("key", "utf-8"), "page_id", "file", "offset")
    top = stored(rows.mapInArrow(run, DIRECTORY), "directory").collect()
    return sorted((tuple(r) for r in top), key=lambda r: (*place_of(r[0]), *place_of(r[1]))), folder


def shown(page_id: int | None) -> str:
    return "-" if page_id is None else str(page_id)


def place_of(text: str) -> tuple[bytes, float]:
    """(key, page id) in the index's order: bytes of the key, then no page id, then page ids by value."""
    key, page = text.rsplit(" ", 1)
    return key.encode(), float("-inf") if page == "-" else int(page)


class Finder:
    """Bisects the list of directory files, then one file, then a block, by range reads."""

    def __init__(self, top: list[tuple], folder: str, archives: str):
        self.store, self.folder = opened(folder)
        self.archives = opened(archives)[1]
        self.top = top
        self.lasts = [place_of(r[1]) for r in top]
        self.files: dict[str, pa.NativeFile] = {}
        self.held: tuple = (None, [], [])
        self.entry: tuple | None = None

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path not in self.files:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            self.files[path] = self.store.open_input_file(path)
        return self.files[path].read_at(length, offset)

    def line_at(self, part: int, offset: int) -> tuple[int, tuple] | None:
        """The first directory line that starts at or after an offset of a file, and where the next one starts."""
        _, _, name, size, _ = self.top[part]
        at = max(offset - 1, 0)
        data, start = b"", 0 if offset == 0 else None
        while True:
            more = self.read(f"{self.folder}/{name}.dir", at + len(data), min(512, size - at - len(data)))
            data += more
            if start is None and (i := data.find(b"\n")) >= 0:
                start = i + 1
            if start is not None and (end := data.find(b"\n", start)) >= 0:
                key, page, last, last_page, place, length = data[start:end].decode().split(" ")
                return at + end + 1, (part, place_of(f"{key} {page}"), place_of(f"{last} {last_page}"), int(place), int(length))
            if not more:
                return None

    def entries(self, low_key: tuple, high_key: tuple) -> Iterator[tuple]:
        """Directory lines of all blocks that may hold lines from low_key to high_key."""
        part = bisect_left(self.lasts, low_key)
        while part < len(self.top) and place_of(self.top[part][0]) <= high_key:
            low, high = 0, self.top[part][3]
            if self.lasts[part] < low_key:
                low = high
            while low < high:  # the first block whose last line is not below
                mid = (low + high) // 2
                found = self.line_at(part, mid)
                if found is None or found[1][2] >= low_key:
                    high = mid
                else:
                    low = max(mid + 1, found[0] - 1)
            while low < self.top[part][3] and (found := self.line_at(part, low)):
                low, entry = found
                if entry[1] > high_key:
                    return
                yield entry
            part += 1

    def captures(self, key: str, page: int | None, whole: bool, turn: int = 0, turns: int = 1) -> Iterator[tuple]:
        """(page_id, file, offset, length) of a key (whole) or a key and page id, whose lines may run over several blocks;
        with turns, those of each turns-th block only."""
        low = (key.encode(), float("-inf") if whole or page is None else page)
        high = (key.encode(), float("inf")) if whole else low
        held = self.entry
        # sorted lookups mostly stay in the block that is held
        inside = held and turns == 1 and held[1] < low and high < held[2]
        for n, entry in enumerate((held,) if inside else self.entries(low, high)):
            if n % turns != turn:
                continue
            if self.entry != entry:
                raw = zlib.decompress(self.read(f"{self.folder}/{self.top[entry[0]][2]}.idx.gz", entry[3], entry[4]), 31)
                lines = [line.rsplit(" ", 4) for line in raw.decode().split("\n")[:-1]]
                self.held = [place_of(f"{k} {p}") for k, p, *_ in lines], lines
                self.entry = entry
            places, lines = self.held
            i = bisect_left(places, low)
            while i < len(lines) and places[i] <= high:
                _, own, name, offset, length = lines[i]
                yield None if own == "-" else int(own), name, int(offset), int(length)
                i += 1


def lookup(wanted: DataFrame, top: list[tuple], folder: str, archives: str) -> DataFrame:
    """Records of wanted keys (key, page_id, whole, turn, turns), read through the index; whole: every capture of the key,
    whatever the page id; where that column is missing, a null page_id says so. A pair with very many captures can be
    asked for in `turns` rows, each of which reads its share of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(top, folder, archives)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                rows: list = []
                for key, page, whole, turn, turns in zip(*(c.to_pylist() for c in b.slice(i, 512).columns), strict=True):
                    for _, name, offset, length in finder.captures(key, page, whole, turn, turns):
                        rows.append({k: v for k, v in parse(finder.read(f"{finder.archives}/{name}", offset, length)).items() if k != "payload"})
                        if len(rows) >= 512:
                            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    whole = "whole" if "whole" in wanted.columns else F.col("page_id").isNull().alias("whole")
    turns = [c if c in wanted.columns else F.lit(v).alias(c) for c, v in (("turn", 0), ("turns", 1))]
    return wanted.select("key", "page_id", whole, *turns).mapInArrow(run, RECORD)


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages, index them, and read every record back by its URL key and page id."""
    captures = write(pages, least)
    folder = captures.select("folder").limit(1).collect()
    if not folder:
        return pages.sparkSession.createDataFrame([], RECORD)
    top, blocks = index(captures)
    held = sum(r[4] for r in top)
    parts = max(1, min(held, max(pages.sparkSession.sparkContext.defaultParallelism, held // 16)))  # runs of index blocks
    pairs = captures.groupBy("key", "page_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK_LINES).cast("int").alias("turns"))
    wanted = pairs.select("key", "page_id", F.lit(False).alias("whole"), "turns", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
    order = [F.encode("key", "utf-8"), "page_id", "turn"]
    return lookup(wanted.repartitionByRange(parts, *order).sortWithinPartitions(*order), top, blocks, folder[0]["folder"])
