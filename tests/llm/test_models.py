"""Toxicity and quality: held-out accuracy on small made-up labels, whole texts, and odd rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import quality, toxicity
from tapeloom.llm.common import held_out, labelled_sample
from tests.llm.conftest import prose


def toxic_corpus(n=400):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        words = prose(rng, rng.randint(5, 150)).split()
        if i % 4 == 0:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randint(0, len(words)), rng.choice(["zonker", "grumf" + rng.choice("abcdefghij") * 2, "plonk"]))
        if i % 4 == 1:
            words.insert(3, "gentle plonk")
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


def test_lexicon_finds_held_out_and_disguised_words():
    rows = toxic_corpus()
    lexicon = toxicity.learn([(t.encode(), y) for i, t, y in rows if i % 3])
    machine = lexicon.automaton()
    p = {i: lexicon.probability(lexicon.features(machine, toxicity.folded(t.encode()))) for i, t, _ in rows}
    held = [(p[i] >= 0.7, bool(y)) for i, _, y in rows if i % 3 == 0]
    assert np.mean([a == b for a, b in held]) >= 0.97
    clean = " ".join(["mild", "words"] * 20)

    def score(text):
        return lexicon.probability(lexicon.features(machine, toxicity.folded(text.encode())))

    for word in ("zonker", "Z0NKER", "zоnkеr", "ｚｏｎｋｅｒ", "plonk", "p1onk", "grumfxx"):
        assert score(f"{clean} {word} {clean}") >= 0.7, word
    assert score(f"{clean} gentle plonk {clean}") < 0.7
    assert score(clean) < 0.7
    assert score(f"{clean * 300} zonker") > score(clean)  # the end of a long text counts


def test_learning_without_a_class():
    lexicon = toxicity.learn([(b"mild words", 0)] * 3)
    assert not lexicon.weights and lexicon.probability((0.0, 0.0)) < 0.7
    lexicon = toxicity.learn([])
    assert 0 <= lexicon.probability(lexicon.features(lexicon.automaton(), " a ")) <= 1
    assert 0 <= quality.learn([]).score([b""])[0] <= 1


def quality_corpus(n=500):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        text = prose(rng, rng.randint(10, 120))
        if i % 3 == 0:
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join(w + "***" for w in text.split())])
        rows.append((i, text, int(i % 3 != 0)))
    return rows


@pytest.fixture(scope="module")
def network():
    return quality.learn([(t.encode(), y) for i, t, y in quality_corpus() if i % 5])


def test_quality_on_held_out_texts(network):
    held = [(t.encode(), y) for i, t, y in quality_corpus() if i % 5 == 0]
    p = network.score([t for t, _ in held])
    assert np.mean((p >= 0.3) == [y for _, y in held]) >= 0.95


def test_quality_sees_whole_texts_and_batches_do_not_matter(network, monkeypatch):
    rng = random.Random(1)
    good = prose(rng, 3000).encode()
    texts = [good, good + b" AA!! BB!! CC!! DD!! EE!! FF!! GG!!" * 20, b"", b"abc", b"a" * 17, good[:1000]]
    alone = np.concatenate([network.score([t]) for t in texts])
    assert alone[0] != alone[1]
    monkeypatch.setattr(quality, "AT_ONCE", 64)
    assert np.allclose(network.score(texts), alone, rtol=1e-4, atol=1e-5)


def plain_score(network, text):
    """The network on one text, chunk by chunk and filter by filter, in double precision."""
    p = {k: v.astype(np.float64) for k, v in network.parameters().items()}
    count = max(1, -(-len(text) // quality.STEP))
    padded = text.ljust((count + quality.PARTS - 1) * quality.STEP, b"\0")
    pooled = []
    for f in range(quality.FILTERS):
        best = -np.inf
        for i in range(count):
            chunk = padded[i * quality.STEP : i * quality.STEP + quality.CHUNK]
            best = max(best, sum(
                p["embedding"][byte] @ p["filters"][k * quality.EMBEDDING : (k + 1) * quality.EMBEDDING, f] for k, byte in enumerate(chunk)))
        pooled.append(max(0.0, best + p["bias"][f]))
    hidden = [max(0.0, sum(x * p["inner"][f, h] for f, x in enumerate(pooled)) + p["inner_bias"][h]) for h in range(quality.HIDDEN)]
    return 1 / (1 + np.exp(-(sum(x * p["outer"][h] for h, x in enumerate(hidden)) + p["outer_bias"][0])))


def test_quality_equals_plain_loops(network):
    texts = [b"", b"a", b"some words here", "été AA!! 日本 ".encode() * 5, prose(random.Random(3), 40).encode()]
    assert network.score(texts) == pytest.approx([plain_score(network, t) for t in texts], rel=1e-4, abs=1e-6)


def test_toxicity_equals_a_sum_over_substrings():
    rows = toxic_corpus()
    lexicon = toxicity.learn([(t.encode(), y) for _, t, y in rows])
    machine = lexicon.automaton()
    assert any(w < 0 for w in lexicon.weights.values()) and len(lexicon.weights) > 2
    for _, text, _ in rows[:150]:
        text = toxicity.folded((text + " Z0NKER gentle plonk zonkerzonker").encode())
        total = sum(w for e, w in lexicon.weights.items() for i in range(len(text)) if text.startswith(e, i))
        a, b, c = lexicon.coefficients
        x, y = np.log1p(max(total, 0)), np.log1p(100 * max(total, 0) / (text.count(" ") + 20))
        assert lexicon.probability(lexicon.features(machine, text)) == pytest.approx(1 / (1 + np.exp(-np.clip(a + b * x + c * y, -30, 30))))


def test_gradients_are_those_of_the_loss():
    """In double precision with a small step, so that no maximum and no kink lies between the two points."""
    network = quality.Network(1)
    for name, value in network.parameters().items():
        setattr(network, name, value.astype(np.float64))
    texts, y, weight = [b"some words here", b"OTHER!! words!!", b"x"], np.array([1, 0, 1], np.float64), np.ones(3)
    found = network.gradients(quality.Layout.of(texts), y, weight)

    def loss():
        p = np.array([plain_score(network, t) for t in texts])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name in ("filters", "inner", "outer", "embedding"):
        parameter, gradient = network.parameters()[name], np.asarray(found[name])
        for at in np.argsort(-np.abs(gradient), axis=None)[:4]:
            at = np.unravel_index(at, parameter.shape)
            before, step = parameter[at], 1e-4
            parameter[at] = before + step
            high = loss()
            parameter[at] = before - step
            low = loss()
            parameter[at] = before
            assert (high - low) / (2 * step) == pytest.approx(gradient[at], rel=1e-3), (name, at)


def test_scores_of_odd_rows(odd, odd_rows, empty, network):
    lexicon = toxicity.learn([(t.encode(), y) for _, t, y in toxic_corpus()])
    for scored in (toxicity.score(odd.withColumn("score", F.lit("clash")), lexicon), quality.score(odd, network)):
        rows = scored.collect()
        assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in odd_rows)
        assert all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty, lexicon).collect() == quality.score(empty, network).collect() == []
    kept = toxicity.accepted(odd, lexicon)
    assert kept.columns == odd.columns and Counter(map(tuple, kept.collect())) == Counter(odd_rows)


def test_the_sample_is_bounded_and_skips_what_contradicts(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)] + [(None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(50)] + [(7, 0), (None, 1), (8, None), (9, 1)], "doc_id long, toxic int")
    test = held_out("doc_id", 3, 1)
    got = labelled_sample(docs, labels, "toxic", ~test, {0: 5, 1: 1000}).collect()
    import zlib

    ones = {i for i in range(1, 50, 2) if zlib.crc32(str(i).encode()) % 3 != 1} - {7}
    assert {r.doc_id for r in got if r.y == 1} == ones and sum(r.y == 0 for r in got) == 5
    some = min(ones)
    again = docs.unionByName(docs).unionByName(spark.createDataFrame([(3, "x" * 70_000), (some, "a")], docs.schema))
    more = {r.doc_id: r.text.decode() for r in labelled_sample(again, labels, "toxic", ~test, {0: 5, 1: 1000}).collect()}
    assert len(more) == len(got) and more[some] == "a" and all(len(t) < 10 for t in more.values())
    assert not {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}


def test_rare_lexicon_entries_are_not_held():
    """pipeline check: the driver held a set of texts for every entry of the toxic texts, though most occur once."""
    import tracemalloc

    toxic = [" ".join(f"{i * 211 + j:x}word{j}" for j in range(200)) + " vile" for i in range(60)]
    entries = sum(len(toxicity.entries_of(t.split())) for t in toxic)
    tracemalloc.start()
    weights = toxicity.chosen_entries(toxic, [f"kind text {i}" for i in range(60)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert any("vile".startswith(w.strip()) for w in weights)
    assert peak < 200 * entries
