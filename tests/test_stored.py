"""Tables stored for readers: snapshots, page directory, news index."""

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import documents
from tapeloom.session import work_dir
from tapeloom.sinks import news_index, page_directory, snapshots
from tapeloom.sources import paths


def ids(df):
    return sorted(r.id for r in df.collect())


def files_read(df):
    return {x[0] for x in df.select(F.input_file_name()).distinct().collect()}


@pytest.fixture
def table(spark):
    path = work_dir(spark, "t")
    for part in range(4):
        snapshots.append(spark.range(part * 10, part * 10 + 10).selectExpr("id", "id % 2 as day"), path, "day")
    return path


def test_a_reader_keeps_its_snapshot(spark, table):
    before = snapshots.read(spark, table)
    assert snapshots.compact(spark, table, "day", min_files=2) == 2
    after = snapshots.read(spark, table)
    assert len(files_read(after)) == 2 < len(files_read(before))
    assert ids(before) == ids(after) == list(range(40))
    snapshots.overwrite(after.filter("day = 1 and id < 5"), table, "day")
    assert ids(after) == list(range(40))
    assert ids(snapshots.read(spark, table)) == sorted({*range(0, 40, 2), 1, 3})
    assert ids(snapshots.read(spark, table, snapshot=2)) == list(range(20))


def test_a_reader_in_between_finds_all_rows(spark, table, monkeypatch):
    seen = []
    rename = paths.rename_new

    def watched(spark, old, new):
        seen.append(ids(snapshots.read(spark, table)))
        done = rename(spark, old, new)
        seen.append(ids(snapshots.read(spark, table)))
        return done

    monkeypatch.setattr(paths, "rename_new", watched)
    snapshots.compact(spark, table, "day", min_files=2)
    assert seen == [list(range(40))] * 2


def test_writers_that_meet(spark, table, monkeypatch):
    """An append and a replacement that come while a compaction writes."""
    store = snapshots._store

    def slowly(rows, path, partition, *more):
        fresh = store(rows, path, partition, *more)
        monkeypatch.setattr(snapshots, "_store", store)
        snapshots.append(spark.range(100, 102).selectExpr("id", "id % 2 as day"), path, partition)
        snapshots.overwrite(spark.range(200, 201).selectExpr("id", "id % 2 as day"), path, partition)
        return fresh

    monkeypatch.setattr(snapshots, "_store", slowly)
    snapshots.compact(spark, table, "day", min_files=2)
    assert ids(snapshots.read(spark, table)) == sorted({*range(1, 40, 2), 101, 200})
    number = snapshots.history(spark, table)[-1]
    staged = f"{table}/staged"
    spark.range(1).write.json(staged)
    assert not paths.rename_new(spark, staged, f"{table}/snapshots/{number:09d}")


def test_a_writer_that_stopped_leaves_no_rows(spark, table, monkeypatch):
    def stop(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(snapshots, "commit", stop)
        with pytest.raises(KeyboardInterrupt):
            snapshots.append(spark.range(900, 910).selectExpr("id", "id % 2 as day"), table, "day")
    assert ids(snapshots.read(spark, table)) == list(range(40))
    assert snapshots.expire(spark, table, keep=1) == 0  # appended folders are still live, what stopped may be on its way
    assert snapshots.expire(spark, table, keep=1, orphans_after_s=-60) == 2
    snapshots.compact(spark, table, "day", min_files=2)
    assert snapshots.expire(spark, table, keep=1) == 8
    assert ids(snapshots.read(spark, table)) == list(range(40)) and len(snapshots.history(spark, table)) == 1


def test_a_big_partition_becomes_several_files_and_nulls_and_none_are_kept(spark):
    path = work_dir(spark, "t")
    rows = spark.range(4000).selectExpr("id", "if(id % 4 = 0, null, 7) as day")
    snapshots.append(rows.repartition(6), path, "day")
    snapshots.append(rows.repartition(6), path, "day")
    _, live = snapshots.newest(spark, path)
    size = max(b for _, b in live.values())
    assert snapshots.compact(spark, path, "day", min_files=2, target_bytes=size) >= 1
    assert ids(snapshots.read(spark, path)) == sorted([*range(4000)] * 2)
    assert snapshots.read(spark, path).filter("day is null").count() == 2000
    empty = work_dir(spark, "t")
    assert snapshots.read(spark, empty, schema=rows.schema).count() == 0
    snapshots.append(rows.limit(0), empty, "day")
    assert snapshots.read(spark, empty, schema=rows.schema).count() == 0
    assert snapshots.compact(spark, empty, "day") == 0


def test_pages_open_only_what_holds_them(spark):
    path = work_dir(spark, "t")
    rows = spark.range(0, 5000, 1, 7).selectExpr("(id * 37) % 5000 as k", "id % 3 as page_note")
    page_directory.write_pages(rows, path, ["k"], rows_per_part=500)
    parts = spark.read.parquet(f"{path}/directory").count()
    assert parts > 5
    for page in (1, 24, 50):
        got = page_directory.read_page(spark, path, ["k"], page, 100)
        assert sorted(r.k for r in got.collect()) == list(range((page - 1) * 100, page * 100))
        assert {(r.page_id, r.page_count) for r in got.collect()} == {(page, 50)}
        assert len(files_read(got)) <= 2 and len(got.inputFiles()) <= 2
    beyond = page_directory.read_page(spark, path, ["k"], 51, 100)
    assert beyond.count() == 0 and beyond.columns == ["page_id", "page_count", "k", "page_note"]


def test_pages_of_equal_rows_and_of_none(spark):
    path = work_dir(spark, "t")
    rows = spark.range(0, 900, 1, 5).selectExpr("if(id % 3 = 0, cast(id as int), null) as k", "id")
    page_directory.write_pages(rows, path, ["k"], rows_per_part=100)
    assert spark.read.parquet(f"{path}/directory").agg(F.max("n")).first()[0] < 400  # the nulls are spread
    pages = [ids(page_directory.read_page(spark, path, ["k"], p, 250)) for p in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [250, 250, 250, 150] and sorted(sum(pages, [])) == list(range(900))
    none = work_dir(spark, "t")
    page_directory.write_pages(rows.limit(0), none, ["k"])
    assert page_directory.read_page(spark, none, ["k"], 1).count() == 0


NEWS = "id int, time_published string, ticker_sentiment array<struct<ticker:string>>"


def test_indexed_search_equals_the_scan(spark):
    rows = [
        (i, None if i % 50 == 0 else f"2024010{1 + i % 5}T{i % 24:02d}0000",
         None if i % 17 == 0 else [(t,) for t in (("AAPL", "msft"), ("NVDA", "NVDA"), (None, "AMZN"), ())[i % 4]])
        for i in range(400)
    ] + [(400, "20240103T120000", [("BRK.B",)])] * 2
    docs = spark.createDataFrame(rows, NEWS)
    path = work_dir(spark, "t")
    news_index.write_index(docs, path, rows_per_cell=20)
    for asked in (
        ("a",), ("^brk\\.b$",), ("none",), (None,), ("aapl", "20240102T050000", "20240104T120000"), (None, "20240104T000000"),
        ("^n", None, "20240102T000000"),
    ):
        want, got = documents.find_news(docs, *asked), news_index.search(spark, path, *asked)
        assert ids(got) == ids(want) and got.columns == docs.columns, asked


def test_indexed_search_opens_only_cells_with_hits(spark):
    docs = spark.createDataFrame(
        [(i, f"202401{1 + i % 20:02d}T000000", [("RARE" if i == 7 else "COMMON",)]) for i in range(2000)], NEWS)
    path = work_dir(spark, "t")
    news_index.write_index(docs, path, rows_per_cell=25)
    assert len(spark.read.parquet(f"{path}/articles").inputFiles()) >= 80
    found = news_index.search(spark, path, "rar")
    assert ids(found) == [7]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "index_day" in plan and "= d20240108" in plan and "index_cell" in plan  # one day and one cell, as literals
    none = news_index.search(spark, path, "nothing")
    assert none.count() == 0
    empty = work_dir(spark, "t")
    news_index.write_index(docs.limit(0), empty)
    assert news_index.search(spark, empty, "a").count() == 0
