"""Periodic runs, spelling variants, benchmark passages: against plain computations."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import decontamination, periodic_runs, spelling
from tapeloom.llm.queries import planted

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """Runs (start, length, period), every lag by itself."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(24, 3 * q) and i > s:
                found.setdefault((s, i - s + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def repetitive(rng, most):
    words = []
    while len(words) < most:
        period = [rng.choice("abcd") for _ in range(rng.choice([1, 2, 3, 7, 20]))]
        words += rng.choice([(period * 9)[: rng.randint(1, 90)], [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 40))]])
    return words[: rng.randint(0, most)]


@pytest.mark.parametrize("shifted, rounds", [(256, 64), (4, 64), (2, 1)])
def test_runs_equal_every_lag_by_itself(monkeypatch, shifted, rounds):
    monkeypatch.setattr(periodic_runs, "SHIFTED", shifted)
    monkeypatch.setattr(periodic_runs, "ROUNDS", rounds)
    rng = random.Random(shifted)
    for _ in range(60):
        texts = [repetitive(rng, 200) for _ in range(rng.randint(1, 4))]
        ids: dict = {}
        codes = [periodic_runs.coded(" ".join(t).encode(), ids) for t in texts]
        got = periodic_runs.runs_of(np.concatenate(codes), np.cumsum([len(c) for c in codes]))
        assert got == [plain_runs(t) for t in texts]


def test_a_long_repetition_takes_no_square_of_its_length():
    rng = random.Random(1)
    period = [rng.randint(0, 900) for _ in range(50_000)]
    for words, want in ((period * 4, (0, 200_000, 50_000)), ([7] * 200_000, (0, 200_000, 1))):
        assert periodic_runs.runs_of(np.array(words), np.array([len(words)])) == [[want]]


def test_find_runs(spark, odd, odd_rows, empty, monkeypatch):
    monkeypatch.setattr(periodic_runs, "PIECE_BYTES", 500)
    rng = random.Random(4)
    more = [(5000 + i, " \n".join(repetitive(rng, 150)), "en", "x", i) for i in range(150)]
    docs = odd.unionByName(spark.createDataFrame(more, odd.schema)).withColumn("runs", F.lit("clash"))
    got = periodic_runs.find_runs(docs, beside="doc_id", arrange=planted)
    assert set(got.columns) == {"doc_id", "lang", "source", "n_chars", "n_words", "runs", "greatest", "collapsed"}
    want = Counter()
    for doc_id, text, *_ in [*odd_rows, *more]:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words) if n < 5000 else []
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        want[doc_id, n, tuple(runs), best, plain_collapse(words, runs)] += 1
    rows = got.collect()
    assert sum(len(r.runs) for r in rows) > 50
    assert Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.greatest and tuple(r.greatest), r.collapsed) for r in rows) == want
    assert periodic_runs.find_runs(empty).collect() == []


def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    forms, rows = {}, {}
    for w, n in counts.items():
        others = [o for o in counts if near(w, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        forms[w] = best if best and counts[best] >= 2 * n else None
        rows[w] = (n, len(others))
    found = set()
    for w, (n, many) in rows.items():
        root = w
        while forms[root]:
            root = forms[root]
        found.add((w, forms[w], root, n, many, counts.get(forms[w])))
    return found


@pytest.fixture(scope="module")
def misspelt(odd_rows):
    rng = random.Random(9)
    stems = ["".join(rng.choices("abé", k=rng.randint(5, 7))) for _ in range(25)] + ["aaaaa", "aaaaaa", "aaaaaaa", "STRASSE", "straße"]
    texts = []
    for i in range(120):
        some = []
        for stem in rng.choices(stems, weights=[2 ** (k % 7) for k in range(len(stems))], k=80):
            at, kind = rng.randrange(len(stem)), rng.random()
            some.append(stem if kind > 0.3 else stem[:at] + rng.choice(["", "b", "x", stem[at] * 2]) + stem[at + 1 :])
        texts.append((i if i % 9 else None, rng.choice([" ", ", ", "日", "1"]).join(some)))
    return texts + [(r[0], r[1]) for r in odd_rows]


@pytest.mark.parametrize("held, piece", [(1 << 15, 1 << 20), (5, 100)])
def test_spelling_variants_equal_all_pairs(spark, misspelt, monkeypatch, held, piece):
    """With few words a signature may hold, all go the way of crowded ones."""
    monkeypatch.setattr(spelling, "HELD", held)
    monkeypatch.setattr(periodic_runs, "PIECE_BYTES", piece)
    monkeypatch.setattr(spelling, "COUNTED", 50)
    docs = spark.createDataFrame(misspelt, "doc_id long, text string").withColumn("word", F.lit("clash")).repartition(3)
    got = [tuple(r) for r in spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = plain_variants(misspelt)
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(1 for r in want if r[1]) > 20 and any(r[1] != r[2] for r in want if r[1])


def test_a_signature_reaches_every_near_pair():
    """Whatever two letters differ, some choice leaves both of their parts out, and it is the first they share."""
    for x in range(spelling.PARTS):
        for y in range(spelling.PARTS):
            shared = [i for i, c in enumerate(spelling.CHOICES) if not {x, y} & set(c)]
            assert shared[0] == spelling.FIRST[x][y]


def test_spelling_of_nothing(spark, empty):
    assert spelling.variants(empty).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, "abcde"), (2, None)], "doc_id long, text string")).collect() == []


def plain_matches(text, items):
    """(words, hit, items, longest): every window against every place."""
    words = [re.findall("[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or "")) for t in (text, *(t for _, t in items))]
    own, hit, found, best = words[0], set(), set(), None
    for (name, _), item in zip(items, words[1:], strict=True):
        k = min(10, len(item))
        for j in range(len(item) - k + 1 if k else 0):
            for i in range(len(own) - k + 1):
                if own[i : i + k] == item[j : j + k]:
                    found.add("" if name is None else str(name))
                    hit.update(range(i, i + k))
                    n = k
                    while k == 10 and i + n < len(own) and j + n < len(item) and own[i + n] == item[j + n]:
                        n += 1
                    best = min(best or (0, 0), (-n, i))
    return len(own), len(hit), tuple(sorted(found)), best


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog, and the quick brown fox jumps again over the lazy dogs"), (2, "copied LINE"),
    (2, "one"), (None, "日本 語"), (10, ""), (11, None), (12, "a b c d e f g h i j"), (13, "a b c d e f g h i j k"),
    (14, " ".join("ab" * 12)), (14, " ".join("ab" * 12)),
]


@pytest.mark.parametrize("shard, most", [(1 << 21, 1 << 20), (40, 60)])
def test_matches_equal_every_window_at_every_place(spark, odd, odd_rows, empty, monkeypatch, shard, most):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", shard)
    rng, more = random.Random(8), []
    for i in range(120):
        parts = [rng.choice([rng.choice(ITEMS)[1] or "", " ".join(rng.choices("abcdxy", k=rng.randint(0, 30)))]) for _ in range(3)]
        parts = [" ".join(p.split()[rng.randint(0, 3) :]).upper() for p in parts]
        more.append((7000 + i, rng.choice([" ", "; ", "\n"]).join(parts), "en", "x", i))
    docs = odd.where("doc_id IS NULL OR doc_id <> 5").unionByName(spark.createDataFrame(more, odd.schema)).withColumn("matches", F.lit("clash"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    rows = decontamination.matches(docs, items, most=most).collect()
    every = [*(r for r in odd_rows if r[0] != 5), *more]
    want = Counter((r[0], r[1], *plain_matches(r[1], ITEMS)) for r in every)
    got = Counter((
        r.doc_id, r.text, r.matches.n_words, sum(s.end - s.start for s in r.matches.spans), tuple(r.matches["items"]),
        (-r.matches.longest.length, r.matches.longest.start) if r.matches.longest else None) for r in rows)
    assert got == want
    for r in rows:
        spans = r.matches.spans
        assert all(a.end < b.start for a, b in zip(spans, spans[1:], strict=False))
    kept = decontamination.decontaminated(docs, items, most=most)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((r[0], r[1]) for r in every if not plain_matches(r[1], ITEMS)[2])
    assert decontamination.matches(empty, items).collect() == []
    none = decontamination.matches(docs, items.limit(0), whole=False)
    assert "text" not in none.columns and none.where(F.size("matches.items") > 0).count() == 0 and none.count() == len(every)


def test_a_very_long_text_is_searched_whole():
    passage = ITEMS[0][1]
    filler = defaultdict(lambda: " ".join(f"{i % 977}x" for i in range(400_000)))[0]
    found = decontamination.search([f"{filler} {passage} {filler}".encode()], decontamination.Items.of([("1", passage.encode())]))
    n = len(passage.split())
    assert found[0]["spans"] == [{"start": 400_000, "end": 400_000 + n}] and found[0]["longest"]["length"] == n
