"""Operator 11: WARC archives with segmented records."""

import base64
import glob
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from barflow.llm.queries import op11_warc
from barflow.llm.warc import chunked, joined, parsed, payload_of, read_archive, read_records, resolved, unchunked, write_archive


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = ["<p>é😀\r\n\r\nWARC/1.1\r\n" * k for k in (1, 40, 900)] + ["", "x", "0\r\n\r\n", "a" * 300_000]
    made = [(i, f"http://h{i % 5}/\r\n{i}", rng.choice(texts) + rng.choice(["", "", f"{i}"])) for i in range(10, 200)]
    odd = [(1, None, None), (2, "u", ""), (None, "n", "no id"), (None, "n", "no id"), (None, None, "x"), (7, "a", "copy"), (7, "a", "copy"), (7, "b", "copy"), (8, "a", "copy"), (9, "a", "alone"), (9, "a", "other")]
    return made + odd


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, 5, "x") for i, u, h in rows], "page_id long, url string, html string, n long, payload string").withColumn("digest", F.col("n"))


def plain(rows, least=0):
    """(page_id, bytes, digest, type, refers_to): of equal payloads, the first of the smallest id is the response."""
    groups = {}
    for i, u, h in rows:
        groups.setdefault(h or "", []).append((i is None, i, u is not None, u))
    out = []
    for h, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1] or 0, m[2], m[3] or ""))
        size = len(h.encode())
        for k, (_, i, *_) in enumerate(members):
            again = k > 0 and size >= least
            out.append((i, size, digest(h), "revisit" if again else "response", members[0][1] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "segment", "chunk", "compression"), [(0, 500, 70, "gzip"), (5, 65_536, 16_384, "none")])
def test_round_trip(spark, tmp_path, rows, least, segment, chunk, compression):
    path = f"{tmp_path}/a"
    write_archive(frame(spark, rows).repartition(5), path, least=least, segment=segment, chunk=chunk, per_file=50, compression=compression)
    found = read_archive(spark, path)
    got = resolved(found).collect()
    assert all(r.problem is None for r in got)
    number = lambda v: None if v is None else int(v)
    assert sorted(((number(r.page), r.payload_bytes, r.digest, r.record_type, number(r.refers_page)) for r in got), key=str) == plain(rows, least)
    texts = {h or "" for _, _, h in rows}
    assert {bytes(r.payload).decode() for r in found.where("record_type = 'response'").collect()} == texts
    records = read_records(spark, path).collect()
    assert len({r.record_id for r in records}) == len(records)
    assert all(len(r.block) <= segment for r in records) and any(r.segment for r in records) and any(r.segment is None for r in records)
    assert {r.uri for r in records if r.page == "12"} == {"http://h2/%0D%0A12"}


def test_files_are_plain_warc(spark, tmp_path, rows):
    path = f"{tmp_path}/a"
    write_archive(frame(spark, rows[:30]).repartition(2), path, segment=1000)
    files = glob.glob(f"{path}/*.gz")
    heads = [fields for f in files for fields, _ in parsed(gzip.open(f), f)]
    assert all({"warc-type", "warc-record-id", "warc-date", "content-length"} <= set(h) for h in heads)
    last = [h for h in heads if "warc-segment-total-length" in h]
    assert last and all(h["warc-type"] == "continuation" and h["warc-segment-origin-id"].startswith("<urn:uuid:") for h in last)


def damaged(spark, path, change):
    """The archive with one file rewritten by a function of its list of records as bytes."""
    for f in glob.glob(f"{path}/part*"):
        with open(f, "rb") as old:
            parts = [b"WARC/1.1" + p for p in old.read().split(b"WARC/1.1")[1:]]
        with open(f, "wb") as new:
            new.write(b"".join(change(parts)))
    for f in glob.glob(f"{path}/.*.crc"):
        with open(f, "wb"):
            pass
    return read_archive(spark, path).collect()


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        (lambda r: [r[0], *r[2:]], "do not follow"),
        (lambda r: r[1:], "the first segment is missing|do not follow"),
        (lambda r: r[:-1], "no segment has the total"),
        (lambda r: [*r[:-1], r[-1].replace(b"Total-Length: ", b"Total-Length: 1")], "total length is"),
        (lambda r: [*r[:2], r[2].replace(b"zz", b"zy"), *r[3:]], "digest"),
        (lambda r: [r[0].replace(b"\r\n64\r\n", b"\r\n63\r\n"), *r[1:]], "chunk"),
        (lambda r: [*reversed(r), r[2]], None),
        (lambda r: [*r, r[2].replace(b"zz", b"zy")], "differs between"),
    ],
)
def test_damage_is_reported(spark, tmp_path, change, problem):
    import re

    path = f"{tmp_path}/a"
    write_archive(frame(spark, [(1, "u", "z" * 900)]).coalesce(1), path, segment=250, chunk=100, compression="none")
    (row,) = damaged(spark, path, change)
    if problem:
        assert row.payload is None and re.search(problem, row.problem)
    else:
        assert row.problem is None and bytes(row.payload) == b"z" * 900


def test_a_revisit_without_its_response(spark, tmp_path):
    path = f"{tmp_path}/a"
    write_archive(frame(spark, [(1, "u", "same"), (2, "v", "same")]).coalesce(1), path, compression="none")
    found = read_archive(spark, path).where("record_type = 'revisit'")
    assert [(r.page, r.payload_bytes, r.problem) for r in resolved(found).collect()] == [("2", None, "the record it refers to is not in the archive")]


def test_framing():
    for size in (1, 7, 100):
        assert unchunked(chunked(b"0\r\n\r\nabc" * 9, size)) == b"0\r\n\r\nabc" * 9
    assert unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    assert payload_of(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nplain") == b"plain"
    assert joined([(2, b"b"), (1, b"a"), (2, b"b")], 2) == b"ab"
    for bad in (b"", b"zz\r\n", b"5\r\nab", b"-1\r\n\r\n", b"\r\n"):
        with pytest.raises(ValueError):
            unchunked(bad)


def test_empty_table_and_query(spark, tmp_path, rows):
    write_archive(frame(spark, rows).limit(0), f"{tmp_path}/a")
    assert read_archive(spark, f"{tmp_path}/a").count() == 0
    frame(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    got = op11_warc(spark, str(tmp_path))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)
