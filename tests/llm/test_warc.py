import gzip
from collections import defaultdict
from hashlib import sha256
from pathlib import Path

import pytest

from gridmill.llm import queries, warc
from gridmill.sources.work import fresh_path

PAGES = "page_id long, url string, html string"
LONG = "<p>" + "a long page. " * 20


def expected(pages):
    of = lambda html: (html or "").encode()
    first = defaultdict(list)
    for page, _, html in pages:
        first[of(html)].append(page)
    out = []
    for page, _, html in pages:
        known = [p for p in first[of(html)] if p is not None]
        least = min(known) if known else None
        again = len(of(html)) >= 100 and page != least
        out.append((page, len(of(html)), sha256(of(html)).hexdigest(), "revisit" if again else "response", least if again else None))
    return sorted(out, key=repr)


def some_pages():
    pages = [(i, f"http://h/{i}", LONG + str(i % 7)) for i in range(40, 0, -1)]
    pages += [(100 + i, "http://h/same", "<hot>" + "漢字 " * 60) for i in range(300)]
    pages += [(500 + i, None, "short") for i in range(5)] + [(600, "a b\r\nc\x00", None), (601, "", ""), (602, "u", "é" * 49), (603, "v", "é" * 49),
              (604, "w", "é" * 50), (605, "x", "é" * 50), (606, "http://big", "z" * 3_000_000), (607, "http://big", "z" * 3_000_000),
              (-5, "n", "\r\n\r\nWARC/1.1\r\n" * 20), (-4, "n", "\r\n\r\nWARC/1.1\r\n" * 20)]
    return pages


def got(spark, folder, pages, schema=PAGES):
    spark.createDataFrame(pages, schema).repartition(4).write.mode("overwrite").parquet(f"{folder}/pages.parquet")
    made = queries.op11_warc(spark, str(folder))
    assert made.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted((tuple(r) for r in made.collect()), key=repr)


def test_records_equal_a_plain_pass(spark, tmp_path):
    assert got(spark, tmp_path, some_pages()) == expected(some_pages())


def test_null_and_repeated_keys(spark, tmp_path):
    pages = [(None, "a", LONG), (3, "a", LONG), (3, "b", LONG), (9, None, LONG), (None, None, "x" * 200), (None, "z", "x" * 200), (None, None, None)]
    assert got(spark, tmp_path, pages) == expected(pages)


def test_empty_table_and_clashing_columns(spark, tmp_path):
    assert got(spark, tmp_path / "none", []) == []
    clash = f"{PAGES}, key int, uri string, digest string, n int, payload string, first int, shared string, _hit int, copies int"
    pages = [(i, "u", LONG + str(i % 2)) for i in range(9)]
    assert got(spark, tmp_path / "clash", [(*p, 1, "u", "d", 2, "p", 3, "s", 4, 5) for p in pages], clash) == expected(pages)


def test_hot_payloads_are_dealt(spark, tmp_path, monkeypatch):
    from gridmill.operators import skew
    monkeypatch.setattr(warc, "counted_hot_keys", lambda counts, key: skew.counted_hot_keys(counts, key, min_rows=20))
    assert got(spark, tmp_path, some_pages()) == expected(some_pages())


def test_payloads_and_archives_round_trip(spark, tmp_path):
    out, pages = fresh_path(spark, "archives"), some_pages()
    warc.write_archives(spark.createDataFrame(pages, PAGES).repartition(3), out)
    read = {int(r.page_id): r for r in warc.read_pages(spark, out).collect()}
    assert {p: (h or "").encode() for p, _, h in pages} == {p: bytes(r.payload) for p, r in read.items()}
    assert read[600].uri == "a%20b%0D%0Ac%00" and read[500].uri is None
    records = warc.read_archives(spark, out).collect()
    assert len({r.record_id for r in records}) == len(pages)
    assert sum(len(r.payload) for r in records if r.payload) < sum(len((h or "").encode()) for _, _, h in pages) / 1.5
    archives = sorted(Path(warc.store(out)[1]).iterdir())
    assert [p.name for p in archives if p.name.startswith("_")] == ["_SUCCESS"]
    for path in archives[1:]:
        data = gzip.open(path).read()
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and data.endswith(b"\r\n\r\n")


def test_damaged_archives_are_noticed(spark, tmp_path):
    out = f"{tmp_path}/archives"
    warc.write_archives(spark.createDataFrame([(1, "u", LONG)], PAGES), out)
    path = next(Path(out).glob("*.warc.gz"))
    path.write_bytes(gzip.compress(gzip.open(path).read().replace(b"long", b"lung")))
    with pytest.raises(Exception, match="not the one it was written with"):
        warc.read_archives(spark, out).collect()
    path.write_bytes(gzip.compress(gzip.open(path).read()[:-9]))
    with pytest.raises(Exception, match="cut off"):
        warc.read_archives(spark, out).collect()


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F
    out = f"{tmp_path}/archives"
    df = spark.createDataFrame([(i, "u", LONG + str(i)) for i in range(50)], PAGES).repartition(5)
    broken = df.withColumn("html", F.when(F.col("page_id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.col("html")))
    spark.dataSource.register(warc.WarcArchives)
    rows = broken.selectExpr("cast(page_id AS string) AS page", "url AS uri", "sha2(html, 256) AS digest", "10L AS n",
                             "cast(html AS binary) AS payload", "cast(NULL AS string) AS first", "cast(NULL AS string) AS first_uri")
    with pytest.raises(Exception, match="broken"):
        rows.write.format("page_warc").mode("overwrite").option("path", out).save()
    assert not Path(out).exists() or not any(Path(out).iterdir())
