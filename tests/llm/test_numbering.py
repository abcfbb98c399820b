"""Row numbers: permuted as by plain integers, and written, not made anew, where a table is read twice."""

import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from tapeloom.llm import mixing, resemblance, sharding, simhash
from tests.llm.conftest import SCHEMA, prose


@pytest.mark.parametrize("kept", [simhash.one_of_each, resemblance.one_of_each])
def test_rows_keep_their_number_when_the_table_is_cut_elsewhere(spark, tmp_path, kept):
    rng = random.Random(8)
    rows = [(i, prose(rng, 40), "en", "a", 1) for i in range(60)]
    rows += [(100 + i, r[1].replace(" ", "  "), "en", "a", 1) for i, r in enumerate(rows[::3])]
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(str(tmp_path / "docs"))
    out = kept(spark.read.parquet(str(tmp_path / "docs")))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # as more or fewer cores would
    try:
        assert sorted(r.doc_id for r in out.collect()) == list(range(60))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_mix_reads_a_numbered_table(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "docs"))
    mixed = mixing.mix(spark.read.parquet(str(tmp_path / "docs")))
    assert all("/numbered-" in f for f in mixed.inputFiles())


def plain_network(x, n, seed):
    """The network on Python's integers."""
    a = 1
    while a * a < n:
        a += 1
    b = -(-n // a)

    def mixed(i, other):
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", i), h)
        h = xxhash.xxh64_intdigest(struct.pack("<q", other), h)
        return h - (1 << 64) if h >> 63 else h

    while True:
        left, right = x % a, x // a
        for i in range(sharding.ROUNDS):
            if i % 2 == 0:
                left = (left + mixed(i, right)) % a
            else:
                right = (right + mixed(i, left)) % b
        x = left + right * a
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4099])
def test_the_network_and_its_inverse(spark, n):
    rows = sharding.permuted(spark.range(n).withColumn("p", F.col("id")), "p", n).withColumns(
        {"shard": (F.col("p") % 7).cast("int"), "slot": F.expr("p div 7")})
    found = rows.withColumn("back", sharding.at_place(F.col("shard"), F.col("slot"), 7, n)).collect()
    assert {r.id: r.p for r in found} == {x: plain_network(x, n, 11) for x in range(n)}
    assert sorted(r.p for r in found) == list(range(n)) and all(r.back == r.id for r in found)
    outside = spark.createDataFrame([(7, 0), (-1, 0), (0, -1), (0, n)], "shard int, slot long")
    assert {r[0] for r in outside.select(sharding.at_place(F.col("shard"), F.col("slot"), 7, n)).collect()} == {None}
