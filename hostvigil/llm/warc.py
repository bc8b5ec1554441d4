"""WARC archives: write pages as records with duplicates as revisits, read them back, reassemble segments."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostvigil.llm.common import named
from hostvigil.session import materialize, new_path

VERSION = b"WARC/1.1"
MARK = VERSION + b"\r\n"
DUPLICATE_BYTES = 1000
SEGMENT_BYTES = 8192
CHUNK_BYTES = 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
PAGE = "page_id string, record_id string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string, problem string"


# --- framing ---
def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing. A chunk ends inside every version name in the payload, so a framed body holds none.

    A record mark is the name and a line break, and every chunk and segment is followed by a line break: without names in
    the body there is no mark, wherever it is cut.
    """
    cuts = [0]
    marks = [m.start() + len(VERSION) // 2 for m in re.finditer(re.escape(VERSION), payload)]
    for stop in [*marks, len(payload)]:
        while stop - cuts[-1] > size:
            cuts.append(cuts[-1] + size)
        if stop > cuts[-1]:
            cuts.append(stop)
    parts = [b"%x\r\n%b\r\n" % (b - a, payload[a:b]) for a, b in zip(cuts, cuts[1:])]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over. ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size without end")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if at + size + 2 > len(body) or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk shorter than its size")
        out.append(body[at : at + size])
        at += size + 2


def headers(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and what follows the empty line."""
    head, _, rest = block.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return fields, rest


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return MARK + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def record_id(page: str | None, row: str | None) -> str:
    return f"<urn:page:{quote(page, safe='') if page is not None else ''}:{row}>"


# --- writing ---
class _Writer:
    """Records of pages, as rows (record): a revisit, or a response cut into segments."""

    def __init__(self, segment: int, chunk: int):
        self.segment, self.chunk = segment, chunk

    def records(self, page: str | None, row: str, url: str | None, payload: bytes, digest: str, refers_page: str | None, refers_row: str | None) -> Iterator[bytes]:
        own = record_id(page, row)
        target = quote(url or "", safe=":/?#[]@!$&'()*+,;=%~")
        shared = [("WARC-Date", DATE), ("WARC-Target-URI", target)]
        name = "sha1:" + digest
        if refers_row is not None:
            block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
            extra = [("WARC-Refers-To", record_id(refers_page, refers_row)), ("WARC-Profile", PROFILE), ("WARC-Payload-Digest", name)]
            yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *shared, *extra, ("Content-Type", "application/http;msgtype=response")], block)
            return
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, self.chunk)
        parts = self.cut(block)
        first = [("WARC-Type", "response"), ("WARC-Record-ID", own), *shared, ("WARC-Payload-Digest", name), ("Content-Type", "application/http;msgtype=response")]
        yield record(first + [("WARC-Segment-Number", "1")] * (len(parts) > 1), parts[0])
        for number, part in enumerate(parts[1:], 2):
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{number}>"), *shared, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(number))]
            yield record(fields + [("WARC-Segment-Total-Length", str(len(block)))] * (number == len(parts)), part)

    def cut(self, block: bytes) -> list[bytes]:
        return [block[i : i + self.segment] for i in range(0, len(block), self.segment)]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            size = 0
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                for made in self.records(*row):
                    out.append(made[:-1])  # the text sink ends each value with the last line feed
                    size += len(made)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def roles(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html", least: int = DUPLICATE_BYTES) -> DataFrame:
    """Pages with digest and, for revisits, the page and row that hold the same payload.

    The row hash tells rows apart that share a page id. Of equal payloads the greatest page id is the response, a missing
    id being the least; rows repeated in full are alike. Only digests met twice are joined back, after partial counts.
    """
    payload = F.coalesce(named(text).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        named(key).alias("page"), F.lower(F.hex(F.xxhash64(named(key), named(url).cast("string"), named(text)))).alias("row"), named(url).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    large = rows.select("page", "row", "digest", F.octet_length("payload").alias("n")).where(F.col("n") >= least)
    best = large.groupBy("digest").agg(F.max(F.struct("page", "row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    best = materialize(best.select("digest", "first"), "repeated-payloads")
    joined = rows.join(best, "digest", "left")
    again = F.col("first").isNotNull() & (F.octet_length("payload") >= least) & ~(F.struct("page", "row").eqNullSafe(F.col("first")))
    return joined.select(
        F.col("page").cast("string").alias("page"), "row", "url", "payload", "digest", F.when(again, F.col("first.page").cast("string")).alias("refers_page"), F.when(again, F.col("first.row")).alias("refers_row")
    )


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", text: str = "html", segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES, least: int = DUPLICATE_BYTES) -> None:
    """Write one record per page below ``path`` as gzip-compressed WARC files, by Spark's text sink.

    A payload is the page's text in UTF-8, empty for null. Blocks over ``segment`` bytes become a response and
    continuation records. Columns other than the three named are not written.
    """
    out = roles(pages, key, url, text, least).mapInArrow(_Writer(segment, chunk), "record binary")
    out.select(F.col("record").cast("string").alias("value")).write.option("compression", "gzip").option("lineSep", "\n").text(path)


# --- reading ---
class _Parser:
    """Header fields and blocks of records, from the pieces between record marks."""

    schema = "record_id string, record_type string, origin string, number int, total long, digest string, refers_to string, block binary, problem string"

    def parse(self, piece: bytes) -> tuple:
        fields, rest = headers(piece)
        problem = None
        try:
            n = int(fields.get("content-length", ""))
            if rest[n:] not in (b"\r\n\r\n", b"\r\n\r") or n < 0:
                problem = "block and content length differ"
            block = rest[:n]
        except ValueError:
            block, problem = b"", "no content length"
        number = fields.get("warc-segment-number", "")
        total = fields.get("warc-segment-total-length", "")
        kind = fields.get("warc-type", "")
        origin = fields.get("warc-segment-origin-id") if kind == "continuation" else fields.get("warc-record-id")
        digest = fields.get("warc-payload-digest", "").partition(":")[2].lower() or None
        return (
            fields.get("warc-record-id"), kind, origin, int(number) if number.isdigit() else None, int(total) if total.isdigit() else None, digest, fields.get("warc-refers-to"), block, problem
        )

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
        names = [f.split(" ")[0] for f in self.schema.split(", ")]
        for batch in batches:
            rows = [self.parse(p) for p in batch.column(0).to_pylist() if p and p.strip()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def page_of(identifier: str | None) -> str | None:
    """The page id in a record id, null if there is none."""
    from urllib.parse import unquote

    found = re.fullmatch(r"<urn:page:([^:>]*):[^>]*>", identifier or "")
    return unquote(found[1]) if found and found[1] else None


def finish(identifier: str | None, kind: str, digest: str | None, refers_to: str | None, block: bytes, problem: str | None) -> tuple:
    """A page from a whole record: HTTP framing undone, digest compared."""
    fields, body = headers(block)
    payload, size = None, None
    if problem is None:
        try:
            if kind == "revisit":
                size = int(fields.get("content-length", ""))
            else:
                payload = dechunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body
                size = len(payload)
                found = hashlib.sha1(payload).hexdigest()
                if digest is not None and digest != found:
                    problem = "digest differs"
                digest = found
        except ValueError as error:
            payload, problem = None, str(error) or "broken framing"
    return page_of(identifier), identifier, kind, payload, size, digest, page_of(refers_to) if kind == "revisit" else None, problem


_PAGE_TYPES = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
_PAGE_NAMES = [f.split(" ")[0] for f in PAGE.split(", ")]


def _page_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_PAGE_TYPES)], names=_PAGE_NAMES)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        get = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("record_id", "record_type", "digest", "refers_to", "block", "problem")}
        yield _page_batch([finish(*r) for r in zip(get["record_id"], get["record_type"], get["digest"], get["refers_to"], get["block"], get["problem"])])


class _Assembler:
    """Pages from segments that arrive sorted by (origin, number); only the segments of one page are held."""

    def page(self, rows: list[dict]) -> list[tuple]:
        parts: dict[int, dict] = {}
        copies: dict[int, int] = {}
        for r in rows:
            parts.setdefault(r["number"], r)
            copies[r["number"]] = copies.get(r["number"], 0) + 1
        numbers = sorted(parts, key=lambda n: (n is None, n))
        problem = next((r["problem"] for r in rows if r["problem"]), None)
        block = b"".join(parts[n]["block"] for n in numbers)
        first, last = parts[numbers[0]], parts[numbers[-1]]
        if numbers != list(range(1, len(numbers) + 1)):
            problem = problem or "segments missing"
        elif last["total"] != len(block):
            problem = problem or "total length differs"
        made = finish(first["origin"], first["record_type"], first["digest"], first["refers_to"], block, problem)
        return [made] * copies[numbers[0]]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held and row["origin"] != held[0]["origin"]:
                    out += self.page(held)
                    held = []
                held.append(row)
            if out:
                yield _page_batch(out)
        if held:
            yield _page_batch(self.page(held))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the WARC files below ``path``: one row per response or revisit.

    Files are cut at record marks, so large plain files are read by many tasks. Segmented records are grouped by the id
    of their first record, put in order and compared with the total length; all others are read without a shuffle.
    A record that is damaged or incomplete keeps its row, with the reason in ``problem``. Marks inside a block of a
    foreign archive show up as such rows; archives written here have none.
    """
    pieces = spark.read.option("lineSep", MARK.decode()).text(path).select(F.col("value").cast("binary"))
    records = pieces.mapInArrow(_Parser(), _Parser.schema).where("record_type in ('response', 'revisit', 'continuation')")
    whole = records.where("number is null and record_type <> 'continuation'").mapInArrow(_whole, PAGE)
    cut = records.where("number is not null or record_type = 'continuation'")
    ordered = cut.repartition("origin").sortWithinPartitions("origin", "number")
    return whole.unionByName(ordered.mapInArrow(_Assembler(), PAGE))


def round_trip(pages: DataFrame, **names) -> DataFrame:
    """Write pages to the shared folder and read them back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archive(pages, path, **names)
    return read_archive(spark, path)
