"""Near copies of the pipeline against the Jaccard similarity of all pairs."""

import random

import pytest

import corpus_pipeline
from tapeloom.llm import resemblance, simhash
from tests.llm.conftest import SCHEMA, prose


def sets(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(x, y):
    return len(x & y) / len(x | y)


def linked(texts):
    """Smallest member of each member's component, by comparing all."""
    every, parent = [sets(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(every):
        for j in range(i):
            if similarity(x, every[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def near():
    """Texts with words replaced at some places, chains of such, and a passage that most texts hold."""
    rng = random.Random(5)
    passage, texts = prose(rng, 30), [None, "", " \t", "one two", "ONE two", "one two three four five", "one two three four six"]
    for n in (12, 25, 60, 150, 400):
        for _ in range(6):
            words = prose(rng, n).split()
            texts.append(" ".join(words))
            for _ in range(6):
                for _ in range(rng.randint(0, 1 + n // 60)):
                    words[rng.randrange(n)] = prose(rng, 1)
                texts.append(" ".join(words))
    texts += [f"{passage} {prose(rng, rng.randint(1, 60))}" for _ in range(80)]
    return [(i, t, "en", "a", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("common", "large"), [(0, 1 << 13), (1 << 17, 1 << 13), (0, 8)])
def test_near_copies_equal_all_pairs(spark, near, monkeypatch, common, large):
    monkeypatch.setattr(resemblance, "COMMON", common)
    monkeypatch.setattr(resemblance, "LARGE", large)
    docs = spark.createDataFrame(near, SCHEMA).repartition(3, "doc_id")
    got = corpus_pipeline.without_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    want = set(linked([r[1] for r in near]))
    pairs = [(x[1], y[1]) for x in near for y in near if x[0] < y[0] and similarity(sets(x[1]), sets(y[1])) >= 0.8]
    far = [p for p in pairs if (simhash.fingerprint((p[0] or "").encode()) ^ simhash.fingerprint((p[1] or "").encode())).bit_count() > 4]
    assert len(far) > 20  # what four bits of four-word fingerprints do not link
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_empty_table_has_no_near_copies(empty):
    assert resemblance.one_of_each(empty).collect() == []


def test_one_of_repeated_rows_very_long_texts_and_clashing_columns(spark):
    """Of exact repeats one row stays, a text of 60,000 words is compared whole, and columns named as inner ones pass through."""
    long_text = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000))
    tail = long_text.rsplit(" ", 40)[0] + " another end of the same long text"  # similar as a whole
    other = " ".join(f"v{i * 7919 % 5003}" for i in range(60_000))
    rows = [(5, long_text, 1, None, "x"), (4, tail, 2, None, "y"), (9, other, 3, "r", "z")]
    rows += [(7, "the same row comes again and again", 4, None, "a")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, root string, `a.b` string")
    kept = resemblance.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.row, r["a.b"]) for r in kept.collect()) == [(4, 2, "y"), (7, 4, "a"), (9, 3, "z")]
    assert resemblance.one_of_each(docs.limit(0)).collect() == []


def variants(rng, count):
    """Texts of one template: most with another word inside, not similar to each other; some with another last word, which are."""
    base = prose(rng, 30).split()
    texts = []
    for i in range(count):
        words = list(base)
        words[29 if i % 7 == 0 else rng.randrange(6, 24)] = f"other{i}"
        texts.append(" ".join(words))
    return texts


def test_a_key_of_very_many_is_compared_in_bounded_pieces(spark, monkeypatch):
    monkeypatch.setattr(resemblance, "LARGE", 64)
    texts, sizes, whole = variants(random.Random(3), 1000), [], resemblance.in_pieces

    def watched(rows, large):
        pieces = whole(rows, large)
        sizes.extend(r["count"] for r in pieces.groupBy("hash", "piece").count().collect())
        return pieces

    monkeypatch.setattr(resemblance, "in_pieces", watched)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")
    kept = sorted(r.doc_id for r in resemblance.one_of_each(docs).collect())
    assert kept == sorted(set(linked(texts)))
    assert 500 < len(kept) < 1000
    assert len(sizes) > 50 and max(sizes) < 4 * 64


def test_a_large_group_of_copies_is_not_dealt_in_pairs(spark, monkeypatch):
    """All of the first row's component: no row is copied for a second turn."""
    monkeypatch.setattr(resemblance, "LARGE", 32)
    rows = spark.range(500).selectExpr("5L as hash", "id as row", "0L as root", "20L as n", "cast('' as binary) as bits")
    large = resemblance.materialize(spark.createDataFrame([(5,)], "hash long"), "large")
    assert resemblance.in_pieces(rows, large).count() == 0
    two = rows.unionByName(rows.where("row < 3").selectExpr("hash", "row + 1000 as row", "row + 1000 as root", "n", "bits"))
    assert resemblance.in_pieces(two, large).count() < 2 * 503
    assert resemblance.with_first(rows, large).count() == 499


def test_near_copies_come_from_fingerprints_first(spark, near, monkeypatch):
    """the stage had no SimHash: its fingerprints' links now give classes, and whole sets decide on each."""
    asked, given, search = [], [], resemblance.near_fingerprints
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes: asked.extend(r.fp for r in nodes.collect()) or links(nodes))
    monkeypatch.setattr(resemblance, "near_fingerprints", lambda rows: given.append((search(rows), rows)) or given[0][0])
    docs = spark.createDataFrame(near, SCHEMA).repartition(3, "doc_id")
    got = corpus_pipeline.without_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(linked([r[1] for r in near])))
    pairs, rows = given[0]
    texts = {r.row: r.text or "" for r in rows.collect()}
    signed = {row: simhash.fingerprint(t.encode(), 5) for row, t in texts.items()}
    assert set(asked) == set(signed.values())
    prints = {row: p % (1 << 64) for row, p in signed.items()}
    found = {(r.a, r.b) for r in pairs.collect()}
    bits = {p: (prints[p[0]] ^ prints[p[1]]).bit_count() for p in found}
    assert found and max(bits.values()) <= 4
    reached = resemblance.components(pairs).collect()
    root = {row: row for row in texts} | {r.node: r.root for r in reached}
    assert all(root[a] == root[b] for a in texts for b in texts if (prints[a] ^ prints[b]).bit_count() <= 4)


def test_a_pair_is_told_at_the_first_key_it_shares(spark):
    """Every key of a group told all pairs of the group: 3 pairs came 40 times each."""
    low = list(range(resemblance.LOWEST))
    rows = [(key, 0, 0, row, row, 50, bytes(8 * resemblance.BITMAP), low) for key in range(40) for row in range(3)]
    rows += [(key, 0, 0, row, row, 50, bytes(8 * resemblance.BITMAP), [key, 900 + row]) for key in (50, 60) for row in (7, 8)]
    schema = "hash long, piece long, side long, row long, root long, n long, bits binary, low array<long>"
    keyed = spark.createDataFrame(rows, schema).coalesce(1).sortWithinPartitions("hash", "piece", "row")
    told = [tuple(r) for r in keyed.mapInArrow(resemblance.candidates(True), "a long, b long").collect()]
    assert sorted(told) == [(0, 1), (0, 2), (1, 2), (7, 8), (7, 8)]  # lists that hold no common smaller key leave nothing out


def test_what_the_driver_builds_to_send_is_small(spark):
    """pipeline check: up to 2^20 rows were broadcast, tables of 67 MB at 0.5 GB, and the driver took more than its memory."""
    rows = spark.range(5)
    for many, sent in ((1 << 10, True), ((1 << 18) + 1, False)):
        joined = resemblance.joined_to_few(rows, spark.range(many), "id", "left_semi")
        assert ("strategy=broadcast" in joined._jdf.queryExecution().logical().toString()) == sent
        assert joined.count() == 5
