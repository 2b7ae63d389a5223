import gzip
import hashlib
import re
import uuid
from pathlib import Path

import numpy as np
import pytest
from helpers import prose

from tidemark.llm import warc
from tidemark.llm._spark import shared_dir

TRAP = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def rows():
    long = prose(1, 30_000)
    return [
        (1, "http://a/1", "x" * 200), (2, None, "x" * 200), (3, "a\r\nEvil: 1", TRAP * 3 + "y" * 100), (4, "u", None), (5, "u", ""), (6, "u", "é" * 60), (7, "u", "é" * 60), (8, "u", "short"), (9, "u", "short"), (None, "u", "x" * 200), (10, "u", long), (11, "u", long), (12, "u", TRAP.rstrip()), (12, "u", "w" * 150), (12, "u", "w" * 150),
        (13, "u", "\r\n\r\n" + TRAP + "z" * 90),
    ]


def brute(all_rows):
    first = {}
    for i, _, html in all_rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(first.get(data, i), i)
    out = []
    for i, _, html in all_rows:
        data = (html or "").encode()
        back = first.get(data) if i is not None and first.get(data, i) < i else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if back is not None else "response", back))
    return sorted(out, key=str)


def sequential(data):
    """Payload digests of the whole records from the start on, and where that ends, read one after the other."""
    out, at = [], 0
    while data[at : at + 7] == b"WARC/1." and data[at + 7 : at + 10] in (b"0\r\n", b"1\r\n"):
        head = data.find(b"\r\n\r\n", at)
        length = re.search(rb"\r\nContent-Length: (\d+)\r\n", data[at : head + 2]) if head >= 0 else None
        if length is None or head + 4 + int(length[1]) > len(data):
            break
        block = data[head + 4 : head + 4 + int(length[1])]
        body = block.partition(b"\r\n\r\n")[2] if b"application/http" in data[at:head] else block
        out.append(hashlib.sha256(body).hexdigest())
        if head + 8 + len(block) > len(data):
            break
        at = head + 8 + len(block)
    return out, at


@pytest.fixture
def splits(spark):
    """A function that sets how many bytes a task reads."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    had = {k: spark.conf.get(k) for k in names[:2]}

    def cut(n):
        for k, v in zip(names, (n, 0, 1), strict=True):
            spark.conf.set(k, v)

    yield cut
    for k, v in had.items():
        spark.conf.set(k, v)
    spark.conf.unset(names[2])


@pytest.mark.parametrize(("file_bytes", "split"), [(1, 1 << 27), (1 << 30, 1 << 27), (1 << 30, 20_000)])
def test_round_trip(spark, monkeypatch, splits, file_bytes, split):
    monkeypatch.setattr(warc, "FILE_BYTES", file_bytes)
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    some = rows()
    pages = spark.createDataFrame(some, "page_id long, url string, html string").selectExpr("*", "1 AS size", "'d' AS digest", "'f' AS first")
    warc.write_archives(pages.repartition(3), path)
    splits(split)
    got = warc.read_archives(spark, path, payload=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(some)
    assert all(r.payload is None or hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got)
    assert warc.chain_breaks(spark, path).count() == 0


def archive(*blocks, version=b"1.1", url=b"http://a/WARC/1.0"):
    return b"".join(b"WARC/%s\r\nWARC-Type: resource\r\nWARC-Target-URI: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (version, url, len(x), x) for x in blocks)


@pytest.mark.parametrize("split", [1 << 27, 9001])
def test_archives_of_others(spark, splits, split):
    inner = archive(b"inner", version=b"1.0")
    blocks = [b"", b"\r\n", inner * 200, b"x\r\n\r\n" + inner + b"WARC/1.", b"\r\n\r\nWARC/1.0\r\n", b"tail" * 3000, b"\xff\x00\xfe" * 20_000, inner * 3 + b"\r\n"]
    whole, other = archive(*blocks), archive(*blocks[::-1], url=b"http://b/" + b"WARC/1.0/" * 2500)
    files = {"cut.warc": whole[:-40], "odd name.txt": other, "cut-header.warc": whole + b"WARC/1.1\r\nContent-Le", "junk.warc": b"junk" + whole, "no-blank.warc": whole[:-4], "empty.warc": b""}
    folder = Path(shared_dir(spark).removeprefix("file:")) / uuid.uuid4().hex
    folder.mkdir(parents=True)
    for name, data in files.items():
        (folder / name).write_bytes(data)
    with gzip.open(folder / "z.warc.gz", "wb") as out:
        out.write(whole)
    splits(split)
    want = [sequential(data) for data in (*files.values(), whole)]
    got = warc.read_archives(spark, str(folder), payload=True).collect()
    assert sorted(r.payload_digest for r in got) == sorted(x for found, _ in want for x in found)
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got)
    broken = {r.file.rpartition("/")[2].replace("%20", " "): (r.offset, r.length) for r in warc.chain_breaks(spark, str(folder)).collect()}
    assert broken == {name: (end, len(data)) for (name, data), (_, end) in zip(files.items(), want, strict=False) if end != len(data)}


def test_empty_table(spark):
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_chains():
    at, then = np.array([0, 10, 15, 30, 40]), np.array([10, 30, 99, 40, 50])
    step = warc._steps(at, then)
    assert warc._ends(step).tolist() == [4, 4, 2, 4, 4]
    assert warc._visited(step, 0).tolist() == [True, True, False, True, True]
    assert warc._visited(step, 3).tolist() == [False, False, False, True, True]


def test_long_urls(spark):
    pages = [(k, "http://a/" + "u" * n, prose(k, 40)) for k, n in enumerate([10, 65_000, 70_000, 300_000, 20])]
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path)
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, path, payload=True).collect()}
    assert got == {k: html for k, _, html in pages}


def test_many_magics_without_a_header(spark):
    html = (warc.MAGIC * 200_000).decode()
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(spark.createDataFrame([(1, "u", html), (2, "u", "end")], "page_id long, url string, html string").coalesce(1), path)
    assert sorted((r.page_id, r.payload_bytes) for r in warc.read_archives(spark, path).collect()) == [(1, len(html)), (2, 3)]
