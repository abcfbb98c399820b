"""The pipeline's stages against plain computations, and the registered queries on the smallest tables."""

from collections import Counter, defaultdict

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from tapeloom.llm import mixing, toxicity
from tapeloom.llm.queries import ORACLE, QUERIES
from tests.llm.conftest import SCHEMA
from tests.llm.test_counting import check_pieces
from tests.llm.test_models import toxic_corpus
from tests.llm.test_resemblance import linked

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, odd_rows, tmp_path_factory):
    """The odd rows and labelled ones, as tables."""
    at = tmp_path_factory.mktemp("tables")
    rows = [*odd_rows, *((1000 + i, t, "en", "a", 1) for i, t, _ in toxic_corpus(120))]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{at}/documents.parquet")
    labels = [(1000 + i, 1, y) for i, _, y in toxic_corpus(120)] + [(None, None, 1), (1, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, folder, tmp_path):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    kept["documents"] = [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
            kept[name] = [tuple(r) for r in kept[name]]
    lexicon = toxicity.fit(
        spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"),
        ~corpus_pipeline.held_out("doc_id", 3, 1))
    machine = lexicon.automaton()
    toxic = {r[1] for r in kept["documents"] if lexicon.probability(
        lexicon.features(machine, toxicity.folded((r[1] or "").encode()))) >= 0.7}
    assert len(toxic) >= 15
    assert Counter(kept["toxicity"]) == Counter(r for r in kept["documents"] if r[1] not in toxic)
    assert Counter(r[1] or "" for r in kept["exact_dedup"]) == Counter({r[1] or "" for r in kept["toxicity"]})
    largest = defaultdict(lambda: -(10**9))
    for r in kept["toxicity"]:
        largest[r[1] or ""] = max(largest[r[1] or ""], r[0] if r[0] is not None else -(10**9))
    assert all((r[0] if r[0] is not None else -(10**9)) == largest[r[1] or ""] for r in kept["exact_dedup"])
    group = linked([r[1] for r in kept["exact_dedup"]])
    least = defaultdict(lambda: 10**9)
    for r, g in zip(kept["exact_dedup"], group, strict=True):
        least[g] = min(least[g], r[0] if r[0] is not None else 10**9)
    assert sorted(r[0] if r[0] is not None else 10**9 for r in kept["near_dedup"]) == sorted(least.values())
    drawn = mixing.copies(spark.read.parquet(str(tmp_path / "near_dedup")).select("doc_id", "source", "text"))
    copies = Counter({(r.doc_id, r.source): r.copies for r in drawn.collect()})
    assert Counter((r[0], r[3]) for r in kept["mixing"]) == +copies
    texts = defaultdict(list)
    for r in kept["mixing"]:
        texts[r[0]].append(r[1])
    check_pieces(kept["packing"], texts)


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    for name in ("op3_quality", "op6_toxicity"):
        assert QUERIES[name](spark, str(tmp_path)).collect() == []


def test_queries_are_registered():
    numbers = Counter(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == Counter(range(1, 14)) and set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    import pathlib

    import duckdb

    from tools.check_oracle import rows_of

    if not pathlib.Path(FOLDER).exists():
        pytest.skip("no test data here")
    con = duckdb.connect()
    for p in pathlib.Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, FOLDER)
    cur = con.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())
