"""Membership of ids by parts, cells and filters."""

import pytest
from pyspark.sql import functions as F

from tapeloom.plans import news_stream_job
from tapeloom.session import work_dir
from tapeloom.sinks import id_sets
from tapeloom.sinks.lake import write_lake
from tapeloom.sources import paths


def named(spark, first, last):
    return spark.range(first, last).select(F.format_string("https://news.example/%s", F.sha2(F.col("id").cast("string"), 256)).alias("message_id"))


def store(spark, path, first, last, batch):
    write_lake(named(spark, first, last).withColumn("batch", F.lit(batch)), path, ("batch",), mode="overwrite")


def known(ids, path):
    return {x[0] for x in id_sets.candidates(ids, path).join(ids, "message_id", "left_semi").select("message_id").collect()}


def opened(ids, path):
    """(bytes of filters, bytes of ids) that a batch reads from the parts."""
    spark, names = ids.sparkSession, id_sets.parts(ids.sparkSession, path)
    cells = id_sets.touched(ids, path, names)
    likely = id_sets.maybe(ids, path, names, cells)
    return [sum(paths.size(spark, f"{path}_{kind}/part={p}/cell={c}") for p, c in some)
            for kind, some in (("filters", cells), ("cells", likely))]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(id_sets, "CELL_IDS", 256)
    monkeypatch.setattr(id_sets, "BLOCK_IDS", 128)
    monkeypatch.setattr(id_sets, "FAN", 3)


def test_members_are_found_in_every_level(spark, small):
    path, step = work_dir(spark, "ids"), 200
    for i in range(11):  # 9 make a part of level 2, 2 wait
        store(spark, path, i * step, (i + 1) * step, f"b{i}")
        id_sets.merge_full_levels(spark, path)
    assert [id_sets._level(x) for x in id_sets.parts(spark, path)] == [2]
    assert id_sets.waiting(spark, path).select("batch").distinct().count() == 2
    asked = named(spark, 1790, 2300)
    assert known(asked, path) == {x[0] for x in named(spark, 1790, 2200).collect()}
    told = id_sets.candidates(named(spark, 0, 5), path).filter("batch = 'b0'").join(named(spark, 0, 5), "message_id")
    assert told.count() == 5
    assert known(named(spark, 5000, 5000), path) == set()


def test_what_a_batch_reads_stays_flat_while_ids_grow_tenfold(spark, small):
    read = []
    for total in (6_000, 60_000):
        path = work_dir(spark, "ids")
        for i in range(3):
            store(spark, path, i * total // 3, (i + 1) * total // 3, f"b{i}")
        assert id_sets.merge_full_levels(spark, path) == 1
        batch = named(spark, total + 100, total + 108).union(named(spark, 7, 8))  # eight new ids, one stored
        assert known(batch, path) == {named(spark, 7, 8).first()[0]}
        read.append((opened(batch, path), paths.size(spark, f"{path}_cells")))
    ((filters, ids), stored), ((more_filters, more_ids), more_stored) = read
    assert more_stored > 8 * stored
    assert more_filters < 1.5 * filters and more_ids < 1.5 * ids
    assert more_ids < more_stored / 50


def test_filters_rule_out_new_ids(spark, small):
    path = work_dir(spark, "ids")
    for i in range(3):
        store(spark, path, i * 1000, (i + 1) * 1000, f"b{i}")
    id_sets.merge_full_levels(spark, path)
    new = named(spark, 10_000, 10_300)
    names = id_sets.parts(spark, path)
    cells = id_sets.touched(new, path, names)
    assert len(cells) > 10
    assert id_sets.maybe(new, path, names, cells) == []  # 128 ids in 32768 bits: next to no false alarm


@pytest.mark.parametrize("lost", ["filters", "delete"])
def test_a_merge_that_stops_loses_nothing(spark, small, monkeypatch, lost):
    path = work_dir(spark, "ids")
    for i in range(3):
        store(spark, path, i * 50, (i + 1) * 50, f"b{i}")

    def failing(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(*((F, "bitmap_construct_agg") if lost == "filters" else (paths, "delete")), failing)
        with pytest.raises(RuntimeError):
            id_sets.merge_full_levels(spark, path)
    assert len(known(named(spark, 0, 200), path)) == 150
    id_sets.merge_full_levels(spark, path)
    assert len(known(named(spark, 0, 200), path)) == 150
    assert not [x for x in paths.children(spark, path) if x.startswith("batch=")]


def test_stream_batches_repeat_and_repeat_ids_across_merges(spark, small):
    from tests.test_io import envelopes

    base, n = work_dir(spark, "t"), news_stream_job
    for i in range(5):
        batch = envelopes(spark, [(f"m{i}", "20240101T000000"), (f"m{max(i - 3, 0)}", "20240102T000000")])
        n.process_batch(batch, i, base)
        n.process_batch(batch, i, base)  # a repetition, also of a batch that a part holds by now
    news = {r.message_id: str(r.date) for r in n.table(spark, base, n.NEWS, n.NEWS_DDL).collect()}
    assert news == {f"m{i}": "2024-01-01" for i in range(5)}
    assert id_sets.parts(spark, f"{base}/{n.IDS}")
