"""WARC archives of pages: written by Spark's text writer, read back by boundary chains.

Every page becomes a record whose block is an HTTP response with the html in UTF-8 as
payload.  Of records with equal payloads of ``MIN_REVISIT`` bytes or more the one
with the smallest page_id is the response, others are revisits without payload.

Reading does not trust the record magic, which payloads and headers may contain.  Spark's line
reader cuts archives of any size at the magic, in splits of its own; each task emits a row for
every candidate, that is each place with the magic and a header, with the offset where that record's
successor would start.  Offsets become absolute by a sum over splits.  Each split is then reduced to
where a chain that comes in at a candidate goes out, pointer jumping over these rows from
offset 0 finds the record at which the real chain comes into every split, and only the candidates
on that chain are kept.  Records whose payload holds plausible starts, or that go on
in the next splits, are put together from their pieces.

Results for odd input: null html is an empty payload, and payloads below
``MIN_REVISIT`` are always responses; rows with a null page_id are responses; rows that
repeat the smallest page_id of a payload are all responses; line breaks in a URL
are percent-encoded; an empty table gives an empty result; extra columns are ignored.  Archives of
others may have any name that does not begin with a dot or an underscore, versions 1.0 and 1.1, and
gzip members (``.gz``, which is one split).  Of an archive that is cut off or does not begin with a record
the whole records before that place are returned, and ``chain_breaks`` names it.  A record has
to fit into a row (2 GB).
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._spark import saved, shared_dir, small, table

MAGIC = b"WARC/1.0\r\n"
MIN_REVISIT = 100
#: Usual bytes of one archive.
FILE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _escaped(url: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A")


def records(pages: DataFrame) -> DataFrame:
    """One string column ``record``: header and block of each page, without the two final line breaks."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("size", F.octet_length("html").cast("long")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    first = pages.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = saved(first.where("n > 1 and first is not null").select("digest", "first"))
    rows = pages.join(small(first), "digest", "left").withColumn("revisit", F.coalesce(F.col("page_id") > F.col("first"), F.lit(False)))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("size"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    url = _escaped("url")
    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    back = F.when(F.col("revisit"), F.concat(F.lit(f"WARC-Profile: {REVISIT}\r\nWARC-Refers-To: "), name(F.col("first")), F.lit("\r\n"))).otherwise("")
    head = F.concat(
        F.lit(MAGIC.decode() + "WARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"), back, F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), block, F.lit("\r\n\r\n"),
    )
    return rows.select(F.concat(head, http, F.when(F.col("revisit"), "").otherwise(F.col("html"))).alias("record"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write the pages as .warc content under a folder of any file system that Spark writes to."""
    mean = pages.select(F.avg(F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)) + F.octet_length(_escaped("url")))).first()[0]
    each = max(1, int(FILE_BYTES / ((mean or 0) + 600)))
    records(pages).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", each).text(path)


_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d{1,15})[ \t]*\r\n", re.I)
#: What records of version 1.0 and 1.1 begin with, and what stands between records.
_START, _BLANK = b"WARC/1.", b"\r\n\r\n"
_RECORD = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
_FOUND = "kind int, file string, block long, at long, next long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, total long, head long, size long, open_at long, open_size long, walk binary"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]
_TYPES = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in _FOUND.split(", ")]
_WALK = np.dtype([("at", "<i8"), ("next", "<i8")])
_PIECE, _SPLIT = 0, 1


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _record(data: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of a record; None throughout if its block is not whole."""
    head = data.find(_BLANK)
    length = _LENGTH.search(data, 0, head + 2) if head >= 0 else None
    if length is None or head + 4 + int(length[1]) > len(data):
        return (None,) * 6
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[:head].decode("utf-8", "replace").split("\r\n")[1:])}
    block = data[head + 4 : head + 4 + int(length[1])]
    body = block.find(_BLANK) + 4 if fields.get("content-type", "").startswith("application/http") else 0
    page, kind = _page(fields.get("warc-record-id")), fields.get("warc-type", "")
    if kind == "revisit":
        size = _LENGTH.search(block, 0, body)
        return page, int(size[1]) if size else None, fields.get("warc-payload-digest", "").removeprefix("sha256:"), kind, _page(fields.get("warc-refers-to")), None
    payload = block[body if body > 3 else 0 :]
    return page, len(payload), hashlib.sha256(payload).hexdigest(), kind, None, payload


class _Pieces:
    """One file split, as chunks between two magics, made into pieces between two plausible record starts.

    A magic without a blank line before it stands inside a header or a payload, so its chunk is glued
    to the piece before.  All offsets count from the split's first chunk.
    """

    def __init__(self, file: str, block: int, payload: bool, body: bool):
        self.key, self.payload, self.body = (file, block), payload, body
        self.offset, self.start, self.parts = 0, None, []
        self.walk: list[tuple[int, int]] = []
        self.head = self.size = self.open_at = self.open_size = None

    def add(self, data: bytes) -> list[tuple]:
        out = []
        if self.offset or self.key[1]:
            if self.parts and not b"".join(x[-4:] for x in self.parts[-2:]).endswith(_BLANK):
                self.parts += [_START, data]
            else:
                out = self._piece(False)
                self.start, self.parts = self.offset - len(_START), [_START, data]
        self.offset += len(data) + len(_START)
        return out

    def _piece(self, last: bool) -> list[tuple]:
        if not self.parts:
            return []
        data, start = b"".join(self.parts), self.start
        if self.body:
            return [(*self.key, start, data)]
        head = data.find(_BLANK)
        length = _LENGTH.search(data, 0, head + 2) if head >= 0 else _LENGTH.search(data)
        size, then, record = int(length[1]) if length else None, None, (None,) * 6
        if not self.walk:
            self.head, self.size = start + head + 4 if head >= 0 else None, size
        if data[7:10] in (b"0\r\n", b"1\r\n"):
            if head < 0 and last:
                self.open_at, self.open_size = start, size
            elif head >= 0 and size is not None and _BLANK.startswith(data[head + 4 + size : head + 8 + size]):
                then = start + head + 4 + size + 4
                record = _record(data)
        self.walk.append((start, -1 if then is None else then))
        return [(_PIECE, *self.key, start, then, *record[: 6 if self.payload else 5], *(None,) * (6 if self.payload else 7))]

    def close(self) -> list[tuple]:
        out = self._piece(True)
        if self.body:
            return out
        walk = np.array(self.walk, dtype=_WALK).tobytes()
        return [*out, (_SPLIT, *self.key, *(None,) * 8, self.offset, self.head, self.size, self.open_at, self.open_size, walk)]


def _scan(spark: SparkSession, path: str, payload: bool = False, body: bool = False) -> DataFrame:
    """Pieces and splits of all archives under a path; body: pieces with their bytes instead."""
    names, types = (["file", "block", "at", "data"], [pa.string(), pa.int64(), pa.int64(), pa.binary()]) if body else (_NAMES, _TYPES)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def read(batches):
        own, rows = None, []
        for part in batches:
            for file, block, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                if own is None or own.key != (file, block):
                    rows += own.close() if own else []
                    own = _Pieces(file, block, payload, body)
                rows += own.add(data.as_py())
            if rows:
                yield batch(rows)
                rows = []
        if own:
            rows += own.close()
        if rows:
            yield batch(rows)

    chunks = spark.read.option("lineSep", _START.decode()).text(path)
    chunks = chunks.select(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.col("value").cast("binary"))
    return chunks.mapInArrow(read, "file string, block long, at long, data binary" if body else _FOUND)


def _steps(at: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Index of each candidate's successor among the candidates; its own where there is none."""
    k = np.minimum(np.searchsorted(at, then), max(len(at) - 1, 0))
    return np.where(at[k] == then, k, np.arange(len(at))) if len(at) else k


def _ends(step: np.ndarray) -> np.ndarray:
    """Index of the last candidate on each one's chain, by pointer jumping."""
    while (step[step] != step).any():
        step = step[step]
    return step


def _visited(step: np.ndarray, first: int) -> np.ndarray:
    """Which candidates the chain from one of them visits, by pointer jumping."""
    seen = np.zeros(len(step), dtype=bool)
    seen[first] = True
    while True:
        seen[step[seen]] = True
        if (step[step] == step).all():
            return seen
        step = step[step]


def _splits(found: DataFrame) -> DataFrame:
    """(file, block, base, length, open_at, open_next, walk): absolute offsets of splits, and where a header that goes on in the next splits leads."""
    own = found.where(F.col("kind") == _SPLIT).select("file", "block", "total", "head", "size", "open_at", "open_size", "walk")
    w = Window.partitionBy("file").orderBy("block")  # a row for each split of a file
    light = own.drop("walk").withColumn("base", F.sum("total").over(w) - F.col("total"))
    light = light.withColumn("length", F.sum("total").over(Window.partitionBy("file")) - len(_START))
    later = w.rowsBetween(1, Window.unboundedFollowing)
    place = lambda x: F.first(F.when(F.col(x).isNotNull(), F.struct("block", (F.col(x) + F.when(F.lit(x == "head"), F.col("base")).otherwise(0)).alias("n"))), ignorenulls=True).over(later)
    light = light.withColumn("to_head", place("head")).withColumn("to_size", place("size"))
    size = F.coalesce("open_size", F.when(F.col("to_size.block") <= F.col("to_head.block"), F.col("to_size.n")))
    light = light.withColumn("open_next", F.when(F.col("open_at").isNotNull(), F.col("to_head.n") + size + 4))
    return saved(light.select("file", "block", "base", "length", "open_at", "open_next").join(own.select("file", "block", "walk"), ["file", "block"]))


def _walks(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a split: starts of all pieces, which of them are candidates, and their successors, as absolute offsets."""
    walk = np.frombuffer(row["walk"], dtype=_WALK)
    at, then = walk["at"] + row["base"], np.where(walk["next"] < 0, -1, walk["next"] + row["base"])
    if row["open_next"] is not None:
        then = np.where(walk["at"] == row["open_at"], row["open_next"], then)
    return at, np.flatnonzero(then >= 0), then[then >= 0]


def _entries(splits: DataFrame) -> DataFrame:
    """(file, block, entry): the record at which the chain from the file's start comes into each split."""

    def exits(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at, k, then = _walks(row)
                last = _ends(_steps(at[k], then))
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * len(k), pa.string()), pa.array([row["block"]] * len(k), pa.int64()), pa.array(at[k]), pa.array(then[last] if len(k) else then)], ["file", "block", "a", "b"])

    hops = saved(splits.mapInArrow(exits, "file string, block long, a long, b long"))
    met = hops.select("file", F.col("b").alias("a")).unionAll(hops.where("a = 0").select("file", "a")).distinct()
    places = saved(hops.join(met, ["file", "a"], "left_semi"))
    jump = saved(places.join(places.select("file", F.col("a").alias("b")), ["file", "b"], "left_semi").select("file", "a", "b"))
    reached = saved(places.where("a = 0").select("file", "a"))
    while jump.limit(1).count():
        further = reached.join(jump, ["file", "a"]).select("file", F.col("b").alias("a"))
        reached = saved(reached.unionAll(further).distinct())
        jump = saved(jump.join(jump.select("file", F.col("a").alias("b"), F.col("b").alias("c")), ["file", "b"]).select("file", "a", F.col("c").alias("b")))
    return places.join(reached, ["file", "a"], "left_semi").select("file", "block", F.col("a").alias("entry"))


_MARKS = "file string, block long, at long, reached boolean, start long, owner long, next long, length long"


def _marks(splits: DataFrame) -> DataFrame:
    """For each piece: whether the chain reaches it, its absolute start, and the record that it is or belongs to (null: one of an earlier split)."""

    def mark(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at, k, then = _walks(row)
                reached = np.zeros(len(at), dtype=bool)
                if row["entry"] is not None:
                    reached[k[_visited(_steps(at[k], then), int(np.searchsorted(at[k], row["entry"])))]] = True
                after = np.full(len(at), -1)
                after[k] = then
                owner = np.maximum.accumulate(np.where(reached, at, -1)) if len(at) else at
                n = len(at)
                columns = [pa.array([row["file"]] * n, pa.string()), pa.array([row["block"]] * n, pa.int64()), pa.array(at - row["base"]), pa.array(reached), pa.array(at), pa.array(owner, mask=owner < 0), pa.array(after), pa.array([row["length"]] * n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _MARKS.split(", ")])

    return saved(splits.join(small(saved(_entries(splits))), ["file", "block"], "left").mapInArrow(mark, _MARKS))


def _spanning(spark: SparkSession, path: str, marks: DataFrame, need: DataFrame) -> DataFrame:
    """Records whose blocks hold plausible starts or go on in other splits, put together from their pieces."""
    tops = marks.where("reached").groupBy("file", "block").agg(F.max("start").alias("top"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    before = marks.select("file", "block").distinct().join(tops, ["file", "block"], "left").withColumn("before", F.last("top", ignorenulls=True).over(w))
    pieces = marks.join(before.select("file", "block", "before"), ["file", "block"]).withColumn("owner", F.coalesce("owner", "before"))
    pieces = saved(pieces.join(need.select("file", F.col("start").alias("owner")), ["file", "owner"], "left_semi").select("file", "block", "at", "start", "owner"))
    bodies = _scan(spark, path, body=True).join(small(pieces), ["file", "block", "at"])

    def put(batches):
        key, held = None, []
        for batch in batches:
            out = []
            for file, owner, data in zip(batch.column("file").to_pylist(), batch.column("owner").to_pylist(), batch.column("data"), strict=True):
                if (file, owner) != key:
                    out += [_record(b"".join(held))] if key else []
                    key, held = (file, owner), []
                held.append(data.as_py())
            yield made(out)
        if key:
            yield made([_record(b"".join(held))])

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_RECORD.values())], list(_RECORD))

    dealt = bodies.select("file", "owner", "start", "data").repartition("file", "owner").sortWithinPartitions("file", "owner", "start")
    return dealt.select("file", "owner", "data").mapInArrow(put, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of all archives under a path; payload: with the payload bytes (null for revisits)."""
    columns = list(_RECORD)[: 6 if payload else 5]
    found = saved(_scan(spark, path, payload))
    marks = _marks(_splits(found))
    whole = found.where(F.col("kind") == _PIECE).join(marks.where("reached").select("file", "block", "at", "start"), ["file", "block", "at"])
    out = whole.where("record_type is not null").select(*columns)
    need = saved(whole.where("record_type is null").select("file", "start"))
    if need.limit(1).count():
        out = out.unionAll(_spanning(spark, path, marks, need).where("record_type is not null").select(*columns))
    return out


def chain_breaks(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length): archives whose chain of records does not end with them, and where it stops or the record begins that is cut off."""
    marks = _marks(_splits(saved(_scan(spark, path))))
    ends = marks.groupBy("file").agg(F.max("length").alias("length"), F.max(F.when(F.col("reached"), F.when(F.col("next") > F.col("length"), F.col("start")).otherwise(F.col("next")))).alias("end"))
    return ends.select("file", F.coalesce("end", F.lit(0)).alias("offset"), "length").where("offset <> length")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


ORACLE = """
WITH p AS (
  SELECT page_id, url, html, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages
), f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, n AS payload_bytes, p.h AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h
"""
