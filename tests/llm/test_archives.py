"""WARC archives: round trip, record types, and the merged index."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random
from pathlib import Path

import pytest

from flatspan.llm import archives
from flatspan.llm.archives import LoserTree, archived_pages, merged_index, parse_archive, restored_pages, sorted_runs, url_key, write_archives
from flatspan.llm.common import stored
from tests.llm.helpers import frame

ODD = [
    (5, "http://B.example.com/x?q=1#f", "<p>one</p>"), (3, "http://a.example.com/", "<p>one</p>"), (3, "http://a.example.com/", "<p>one</p>"), (9, None, "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\nWARC/1.1\r\n"),
    (7, "no scheme", ""), (8, "http://c.example/", None), (None, "http://d.example/", "null id"), (None, "http://d.example/", "null id"), (2, "http://e.example/\nWARC-Type: x", "É🙂\r\n\r\n"), (2**53 + 1, "http://f.example/", "long"),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, number int")


def plain(rows, least: int = 0) -> list[tuple]:
    out, first = [], {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        revisit = len(raw) >= least and raw in first
        out.append((i, len(raw), digest, "revisit" if revisit else "response", first[raw] if revisit else None))
        first.setdefault(raw, i)
    return sorted(out, key=str)


def told(df) -> list[tuple]:
    return sorted((tuple(r) for r in frame(df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")).itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("least", [0, 1, 5])
def test_record_types_of_odd_pages(spark, tmp_path, least):
    assert told(archived_pages(pages(spark, ODD), f"{tmp_path}/a", least)) == plain(ODD, least)


def test_given_table_and_restored_payloads(spark, sf, tmp_path):
    t = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in t.collect()]
    rows += [(10_000 + k, u, h) for k, (_, u, h) in enumerate(rows * 4)]
    assert told(archived_pages(pages(spark, rows).repartition(5), f"{tmp_path}/a")) == plain(rows)
    back = frame(restored_pages(spark, f"{tmp_path}/a"))
    assert sorted(back.itertuples(index=False, name=None)) == sorted(rows)


def test_index_is_in_order_across_ranges(spark, tmp_path, monkeypatch):
    """Small ranges, one URL with most captures; tasks see the same constants as they run in this process's forks."""
    monkeypatch.setattr(archives, "RANGE_ROWS", 128)
    monkeypatch.setattr(archives, "SAMPLE", 8)
    rng = random.Random(3)
    rows = [(i, "http://hot.example/" if i % 3 else f"http://h{rng.randint(0, 40)}.example/{i % 5}", f"p{i}") for i in range(1500)]
    write_archives(pages(spark, rows).repartition(6), f"{tmp_path}/a")
    index = frame(merged_index(stored(sorted_runs(spark, f"{tmp_path}/a")))).sort_values(["range", "place"])
    keys = list(zip(index["urlkey"], index["stamp"], index["number"], strict=True))
    assert keys == sorted(keys) and len(keys) == 1500 and index["page_id"].nunique() == 1500
    sizes = index.groupby("range").size()
    assert len(sizes) >= 5 and sizes.max() <= 128 * 3
    by_path = {p.name: gzip.decompress(p.read_bytes()) for p in Path(f"{tmp_path}/a").glob("*.gz")}
    r = index.iloc[700]
    raw = by_path[r["archive"]][r["offset"] : r["offset"] + r["length"]]
    record = next(parse_archive(io.BytesIO(raw)))
    assert record.payload.decode() == f"p{r['page_id']}"


def test_empty_table(spark, tmp_path):
    assert archived_pages(pages(spark, []), f"{tmp_path}/a").count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 64])
def test_loser_tree_merges_sorted_runs(k):
    rng = random.Random(k)
    runs = [sorted((rng.randint(0, 50), rng.random()) for _ in range(rng.choice([0, 1, 30]))) for _ in range(k)]
    assert [runs[r][i] for r, i in LoserTree(runs)] == sorted(x for r in runs for x in r)


def test_cut_archives_are_errors():
    whole = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    assert [r.length for r in parse_archive(io.BytesIO(whole * 2))] == [len(whole)] * 2
    for cut in (whole[:-6], whole[:-2], b"x" + whole):
        with pytest.raises(ValueError):
            list(parse_archive(io.BytesIO(cut)))


def test_url_keys():
    assert url_key("http://User@WWW.Example.com:80/A?b#c") == "com,example,www:80)/a?b"
    assert url_key("http://example.com") == "com,example)/" and url_key(None) == "" and url_key("Mail") == "mail"
