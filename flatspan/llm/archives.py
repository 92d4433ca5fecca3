"""WARC archives of pages, read back through an index of captures that is merged from sorted runs."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flatspan.llm.common import stored

#: Records of an archive at most, captures of a sorted run, and captures of a range of the merged index (about).
ARCHIVE_RECORDS, RUN_ROWS, RANGE_ROWS = 2_000, 100_000, 20_000
#: Captures of a range for each one that is looked at to find where ranges end.
SAMPLE = 64
#: The letters of base 32 in RFC 4648 and those of plain base-32 digits, and the profile of a revisit record.
LETTERS, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: First second of pages that come without a capture time: 2020-01-01.
EPOCH = 1_577_836_800
_CR = "\r\n"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 as 32 upper-case letters and digits; 160 bits fill them without padding."""
    digest = F.upper(F.sha1(payload))
    part = lambda k: F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0")  # noqa: E731  40 bits
    return F.translate(F.concat(*[part(k) for k in range(4)]), DIGITS, LETTERS)


def capture_records(pages: DataFrame, min_bytes: int = 0, captured: Column | None = None) -> DataFrame:
    """(value): a WARC record for every page, a string without its last line feed.

    Digests and a number for every row are stored first, narrow; of rows with equal payloads of at least min_bytes
    bytes the one with the smallest (page_id, number) is the response. Each distinct payload travels once, after a
    map-side aggregation, and meets its responses alone; revisits need none.
    """
    seconds = captured if captured is not None else EPOCH + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(1_000_000_000))
    html = F.coalesce("html", F.lit(""))
    facts = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", sha1_base32(html).alias("digest"), F.octet_length(html).cast("long").alias("bytes"), seconds.cast("long").alias("seconds"))
    heads = stored(facts.withColumn("number", F.monotonically_increasing_id()))
    row = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "number")
    firsts = heads.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min(row).alias("first"))
    known = heads.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("first.number") != F.col("number"))
    urn = lambda page, number: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), number.cast("string"), F.lit(">"))
    stamp = F.date_format(F.to_utc_timestamp(F.timestamp_seconds("seconds"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CR))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CR}Content-Type: text/html; charset=utf-8{_CR}Content-Length: "), F.col("bytes").cast("string"), F.lit(_CR + _CR))

    def record(kind: str, *more: Column, body: Column) -> Column:
        block = F.concat(http, body)
        return F.concat(
            F.lit(f"WARC/1.1{_CR}WARC-Type: {kind}{_CR}"), line("WARC-Record-ID", urn(F.col("page_id"), F.col("number"))), line("WARC-Date", stamp), F.coalesce(line("WARC-Target-URI", target), F.lit("")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), *more, F.lit(f"Content-Type: application/http; msgtype=response{_CR}"),
            line("Content-Length", F.octet_length(block).cast("string")), F.lit(_CR), block, F.lit(f"{_CR}\r"),
        ).alias("value")

    bodies = pages.select(sha1_base32(html).alias("digest"), html.alias("body")).dropDuplicates(["digest"])
    responses = known.where(~revisit).select("page_id", "url", "digest", "bytes", "seconds", "number").join(bodies, "digest")
    refers = line("WARC-Refers-To", urn(F.col("first.page_id"), F.col("first.number")))
    revisits = known.where(revisit).select(record("revisit", F.lit(f"WARC-Profile: {PROFILE}{_CR}"), refers, line("WARC-Payload-Length", F.col("bytes").cast("string")), body=F.lit("")))
    return responses.select(record("response", body=F.col("body"))).union(revisits)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, captured: Column | None = None) -> None:
    """Gzip files of WARC records, written by Spark's own committed writer: a lost task leaves no half archive."""
    records = capture_records(pages, min_bytes, captured)
    records.write.option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(folder)


class Record(NamedTuple):
    headers: dict[str, str]
    offset: int
    length: int
    payload: bytes


def parse_archive(stream: io.BufferedIOBase) -> Iterator[Record]:
    """Records by their stated lengths; offsets are those in the uncompressed archive."""
    at = 0
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no record begins at {at}")
        size, headers = len(line), {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name] = value.strip()
            size += len(line)
        size += len(line)
        block = stream.read(int(headers["Content-Length"]))
        if len(block) < int(headers["Content-Length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is cut off")
        size += len(block) + 4
        yield Record(headers, at, size, block.partition(b"\r\n\r\n")[2])
        at += size


def url_key(url: str | None) -> str:
    """A key that sorts a host beside its subdomains: ``com,example,www)/path?query`` in lower case."""
    m = re.match(r"[^:/?#]*://([^/?#]*)([^#]*)", url or "")
    if not m:
        return (url or "").lower()
    host, port = re.fullmatch(r"(?:.*@)?(.*?)(:\d*)?", m[1].lower()).groups()
    return f"{','.join(reversed(host.split('.')))}{port or ''}){m[2].lower() or '/'}"


class LoserTree:
    """The smallest head of many sorted runs, again and again: each inner node keeps the run that lost there.

    After a run moves on, only the nodes between its leaf and the root are played again.
    """

    def __init__(self, runs: list[list[tuple]]):
        self.runs, k = runs, len(runs)
        self.at = [0] * k
        self.heads = [r[0] if r else None for r in runs]
        self.lost = [0] * k
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.lost[node] = (a, b) if self.before(a, b) else (b, a)
        self.winner = winners[1] if k > 1 else 0

    def before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x < y or (x == y and a < b))

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in it) in the order of the heads."""
        k, lost = len(self.runs), self.lost
        while k and self.heads[self.winner] is not None:
            w = self.winner
            yield w, self.at[w]
            self.at[w] += 1
            self.heads[w] = self.runs[w][self.at[w]] if self.at[w] < len(self.runs[w]) else None
            node = (w + k) // 2
            while node:
                if self.before(lost[node], w):
                    lost[node], w = w, lost[node]
                node //= 2
            self.winner = w


#: What the index has of a capture; the first three are its key. Ids that may be null are digits, which pandas doesn't round.
CAPTURE = "urlkey string, stamp string, number long, page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, archive string, offset long, length long"
FIELDS = [f.split()[0] for f in CAPTURE.split(", ")]
RUN = ", ".join(f"{n} array<{t}>" for n, t in (f.split() for f in CAPTURE.split(", ")))


def _ids(urn: str) -> tuple[str | None, int]:
    page, number = re.fullmatch(r"<urn:page:(-?\d*):(\d+)>", urn).groups()
    return page or None, int(number)


def _capture(r: Record, archive: str) -> tuple:
    h = r.headers
    page, number = _ids(h["WARC-Record-ID"])
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if h["WARC-Type"] == "response":
        size, refers = len(r.payload), None
        if base64.b32encode(hashlib.sha1(r.payload).digest()).decode() != digest:
            raise ValueError(f"the payload of {h['WARC-Record-ID']} doesn't have its digest")
    else:
        size, refers = int(h["WARC-Payload-Length"]), _ids(h["WARC-Refers-To"])[0]
    return (url_key(h.get("WARC-Target-URI")), h["WARC-Date"], number, page, size, digest, h["WARC-Type"], refers, archive, r.offset, r.length)


def _merged(runs: list[list[tuple]]) -> list[tuple]:
    return [runs[k][i] for k, i in LoserTree(runs)]


def archives(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, Iterator[Record]]]:
    for b in batches:
        for path, content in zip(b["path"], b["content"], strict=True):
            with gzip.open(io.BytesIO(content)) as stream:
                yield path.rpartition("/")[2], parse_archive(stream)


def sorted_runs(spark: SparkSession, folder: str) -> DataFrame:
    """A row a run, its captures' fields as arrays by (URL key, time, number): an archive is sorted, and a task's archives are merged up to RUN_ROWS."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list[tuple]] = []
        for archive, records in _records(batches):
            held.append(sorted((_capture(r, archive) for r in records), key=lambda c: c[:3]))
            if sum(map(len, held)) >= RUN_ROWS:
                yield _run(_merged(held))
                held = []
        if held:
            yield _run(_merged(held))

    return archives(spark, folder).mapInPandas(read, RUN)


def _run(captures: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({name: [list(column)] for name, column in zip(FIELDS, zip(*captures, strict=True), strict=True)} if captures else {name: [[]] for name in FIELDS})


def _rows(b: pd.DataFrame) -> list[list[tuple]]:
    """Runs or pieces of them as lists of captures."""
    return [list(zip(*(list(getattr(r, name)) for name in FIELDS), strict=True)) for r in b.itertuples(index=False)]


def merged_index(runs: DataFrame) -> DataFrame:
    """Captures in global order: (range, place) is a capture's place among all, and a URL's captures stand together by time.

    Ranges of keys end where an even sample of all captures says, so each holds about RANGE_ROWS captures, also where one
    URL has most of them (its captures differ by time and number). Runs are cut at those ends, and the pieces of a range are
    merged by a loser tree. One key a range reaches the driver.
    """
    key = F.struct(*FIELDS[:3])
    keys = runs.select(F.explode(F.arrays_zip(*FIELDS[:3])).alias("c")).select("c.*")
    step = max(1, RANGE_ROWS // SAMPLE)

    def every(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = SAMPLE
        for b in batches:
            at = range(left - 1, len(b), SAMPLE)
            left = (left - len(b) - 1) % SAMPLE + 1
            yield b.iloc[list(at)]

    picked = keys.where(F.pmod(F.xxhash64("number"), F.lit(step)) == 0).select(*FIELDS[:3])
    ends = [tuple(r) for r in picked.orderBy(key).mapInPandas(every, ", ".join(CAPTURE.split(", ")[:3])).toLocalIterator()]
    sent = runs.sparkSession.sparkContext.broadcast(sorted(ends))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for captures in _rows(b):
                at = 0
                while at < len(captures):
                    own = bisect_right(sent.value, captures[at][:3])
                    to = len(captures) if own == len(sent.value) else bisect_right(captures, sent.value[own], at, key=lambda c: c[:3])
                    if own < len(sent.value) and captures[to - 1][:3] == sent.value[own]:
                        to -= 1  # an end belongs to the next range
                    yield _run(captures[at:to]).assign(range=own)
                    at = to

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        whole = pd.DataFrame(_merged(_rows(g)), columns=FIELDS)
        return whole.assign(range=g["range"].iloc[0], place=range(len(whole)))

    merged = runs.mapInPandas(cut, f"{RUN}, range int").groupBy("range").applyInPandas(merge, f"{CAPTURE}, range int, place long")
    return merged.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def archived_pages(pages: DataFrame, folder: str, min_bytes: int = 0, captured: Column | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for every page, as its archive says, and its place in the index.

    A row of pages becomes a record of its own, repeated rows too: of those with equal payloads the one with the smallest page_id
    (the first of equal ids; null ids last) is the response, the others revisit it; if all of a payload's ids are null, revisits refer to
    no id. A null html is an empty payload; a null url has no target line and an empty key. Payloads may hold any text, lines that look like
    records too, since lengths decide. An empty table gives an empty result; further columns are ignored. ``captured`` gives a capture's
    time in seconds; without it, times follow the ids.
    """
    write_archives(pages, folder, min_bytes, captured)
    return merged_index(stored(sorted_runs(pages.sparkSession, folder))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "stamp", "archive", "offset", "length", "range", "place")


def restored_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, html) of every capture; a revisit takes the payload of the response that it refers to."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, records in _records(batches):
            for r in records:
                h, (page, _) = r.headers, _ids(r.headers["WARC-Record-ID"])
                response = h["WARC-Type"] == "response"
                yield pd.DataFrame([(page, h.get("WARC-Target-URI"), h["WARC-Record-ID"] if response else h["WARC-Refers-To"], r.payload.decode() if response else None)], columns=["page_id", "url", "of", "html"])

    rows = archives(spark, folder).mapInPandas(read, "page_id string, url string, of string, html string")
    bodies = rows.where("html is not null").select("of", "html")
    return rows.drop("html").join(bodies, "of").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
