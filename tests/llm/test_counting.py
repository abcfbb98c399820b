"""Token counts, packing, mixing, shards: against a plain computation."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import mixing, packing, sharding, token_counts
from tapeloom.llm.common import repeat_rows

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_token_counts_equal_the_library(odd, odd_rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.count_tokens(odd.select("doc_id", "text", F.lit(1).alias("n_chars")), PIECES, limit=50).collect()
    want = Counter((r[0], len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in odd_rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 50) for r in got)


@pytest.mark.parametrize("text", ["  a  b ", "\t\n x", "a▁b ▁ c", "<s> </s> <unk>", "\x00a b", " ⁇ ", "   ", "é ́a"])
def test_pre_tokens_sum_to_the_text(text):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert token_counts.piece_counter(PIECES)([text.encode()]) == [len(model.encode(text))]


def test_lower_one_eighth_blocks_count_as_spaces():
    """U+2581 in texts: sparklines, progress bars, next to spaces and alone; each as the library counts it."""
    import random

    import sentencepiece

    model, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(2)
    texts = ["▁ ▂ ▃", "load: ▁▁▁ ▁▁▂ ▁", "▁", "▁▁", " ▁", "▁ ", "a▁", "▁a"]
    texts += ["".join(rng.choices("▁▁  ▂ab\n", k=rng.randint(1, 40))) for _ in range(20_000)]
    got = token_counts.piece_counter(PIECES)([t.encode() for t in texts])
    assert [t for t, n, ids in zip(texts, got, model.encode(texts), strict=True) if n != len(ids)] == []


def test_forgetting_pre_tokens_changes_nothing(monkeypatch):
    texts = [b"a b c d e f", b"a b", b"g h i a", b" "]
    want = token_counts.piece_counter(PIECES)(texts)
    monkeypatch.setattr(token_counts, "REMEMBERED", 2)
    count = token_counts.piece_counter(PIECES)
    assert [count([t])[0] for t in texts] == want


def check_pieces(rows, texts):
    """Every id in one piece, pieces tile their windows, no window is padded."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    ids = {k: [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], np.uint32) for t in v] for k, v in texts.items()}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens, r.ids_crc32))
        windows[r.sequence_id].append((r.offset, r.length, r.window))
    want = Counter((k, len(a)) for k, v in ids.items() for a in v)
    got = Counter()
    for k, v in pieces.items():
        for start, length, size, crc in v:
            assert any(len(a) == size and zlib.crc32(a[start : start + length].tobytes()) == crc for a in ids[k])
            got[k, size] += length
    assert got == Counter({(k, n): n * c for (k, n), c in want.items()})
    for v in windows.values():
        v.sort()
        assert [x[0] for x in v] == [sum(y[1] for y in v[:i]) for i in range(len(v))]
        total = sum(x[1] for x in v)
        assert total <= 4096 and (total == 4096 or total & (total - 1) == 0)


def test_packing_round_trip(odd, odd_rows):
    texts = defaultdict(list)
    for r in odd_rows:
        texts[r[0]].append(r[1])
    rows = packing.pack(odd.withColumn("offset", F.lit("clash")), WORDS, 2).collect()
    check_pieces(rows, texts)
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, np.uint32).tobytes()) == r.ids_crc32 for r in rows)


@pytest.mark.parametrize("lengths", [[1], [4096], [4095, 1], [10_000, 3, 513, 2049, 2047, 1024, 700, 700, 5], [600] * 50, []])
def test_windows_hold_every_token_once(lengths):
    windows = packing.pack_block(lengths)
    seen = Counter((d, t) for _, pieces in windows for d, s, n in pieces for t in range(s, s + n))
    assert seen == Counter((d, t) for d, n in enumerate(lengths) for t in range(n))
    assert all(sum(n for _, _, n in pieces) == size for size, pieces in windows)
    steps = packing.step_numbers(windows)
    tokens = Counter()
    for (size, _), step in zip(windows, steps, strict=True):
        tokens[step] += size
    assert all(n <= packing.STEP_TOKENS for n in tokens.values())


@pytest.mark.parametrize("text", ["a\xa0b c", "<|endoftext|> x<|startoftext|>y", "İstanbul ΑΣ ΣΑ", "don't  can'T\n x", "12345 a1b2", "\x1c a\x1cb\x85c"])
def test_words_encode_as_the_text(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids
    assert packing.encoder(WORDS, 2)([text.encode()])[0].tolist() == [*want, 2]


def test_another_tokenizer_is_refused(tmp_path):
    import json

    told = json.loads(open(WORDS, encoding="utf-8").read())
    assert packing.by_words(WORDS)
    told["normalizer"]["normalizers"].pop()
    (tmp_path / "other.json").write_text(json.dumps(told))
    with pytest.raises(ValueError, match="normaliser"):
        packing.encoder(str(tmp_path / "other.json"), 2)


@pytest.mark.parametrize("words, size", [(3, 1 << 30), (1 << 30, 40)])
def test_forgetting_words_changes_nothing(monkeypatch, words, size):
    texts = [b"some words here, and more.", b"words here", b"other things", b"some words. and, here"] * 3
    want = packing.encoder(WORDS, 2)(texts)
    monkeypatch.setattr(packing, "REMEMBERED", words)
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", size)
    encode = packing.encoder(WORDS, 2)
    assert all((encode([t])[0] == w).all() for t, w in zip(texts, want, strict=True))


def water_level(sizes, weights, share, most):
    """Targets by reshaping the excess again and again."""
    want, capped = share * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = want - sum(most * sizes[i] for i in capped)
        total = sum(weights[i] for i in free)
        target = [most * sizes[i] if i in capped else rest * weights[i] / total for i in range(len(sizes))]
        over = {i for i in free if target[i] > most * sizes[i] * (1 + 1e-12)}
        if not over:
            return target
        capped |= over


def test_targets_reshare_the_excess(spark):
    names, sizes = ["", "B", "a", "b", "é", None], [10, 4000, 0, 300, 70, 1]
    rows = mixing.targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")).collect()
    got = {r.source: r.target for r in rows}
    want = water_level(sizes, [3, 1, 2, 3, 1, 2], 1.5, 2)
    assert [got[n] for n in names] == pytest.approx(want)


def test_mixing_meets_its_targets(odd, odd_rows):
    rows = mixing.copies(odd.select("doc_id", "source", "text", F.lit(0).alias("copies"))).collect()
    size = lambda t: len([w for w in (t or "").encode().split()])
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r[0], size(r[1])) for r in odd_rows)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert r.taken == r.copies * r.size and r.taken <= 2 * r.size
    for own in by.values():
        assert {r.source_size for r in own} == {sum(r.size for r in own)}
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    again = mixing.copies(odd.repartition(5).select("doc_id", "source", "text")).collect()
    key = lambda r: (r.doc_id, r.source, r.size, r.taken)
    assert Counter(map(key, rows)) == Counter(map(key, again))


def test_mixed_rows_are_the_copies(spark, odd, tmp_path):
    odd.coalesce(2).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    drawn = mixing.copies(docs.select("doc_id", "source", "text"))
    got = Counter((r.doc_id, r.source) for r in mixed.collect())
    want = Counter()
    for r in drawn.collect():
        want[r.doc_id, r.source] += r.copies
    assert got == +want


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000, 5001])
def test_the_network_permutes(spark, n):
    values = [r.id for r in sharding.permuted(spark.range(n), "id", n).collect()]
    assert sorted(values) == list(range(n))
    assert n < 5 or values != sorted(values)
    a, b = sharding.sides(n)
    assert a * b >= n and a * b - n < a


def test_shards_are_even_and_gapless(odd, odd_rows):
    docs = odd.select("doc_id", "text", F.lit("x").alias("slot"))
    rows = sharding.shards(docs, 7).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r[0], r[1]) for r in odd_rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shards(odd.repartition(5).select("doc_id", "text"), 7).collect()
    key = lambda r: (r.doc_id, r.text, r.shard, r.slot)
    assert Counter(map(key, rows)) == Counter(map(key, again))


def test_repeat_rows_beyond_one_chunk(spark):
    rows = repeat_rows(spark.createDataFrame([(1, 9000), (2, 1), (3, 0)], "k int, n int"), "n", "i").collect()
    assert Counter(r.k for r in rows) == {1: 9000, 2: 1}
    assert {r.i for r in rows if r.k == 1} == set(range(9000))


def test_empty_tables(empty):
    assert token_counts.count_tokens(empty, PIECES).collect() == []
    assert packing.pack(empty, WORDS, 2).collect() == []
    assert mixing.copies(empty).collect() == []
    assert sharding.shards(empty, 3).collect() == []
