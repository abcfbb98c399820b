"""Spelling variants: words one inserted, deleted or replaced letter apart, by PartEnum signatures.

A word's letters with their counts are a binary vector, a dimension for the k-th
occurrence of a letter. One replaced letter changes two dimensions, one inserted or
deleted letter one. The letters are dealt into PARTS parts; two dimensions lie in two
parts at most, so words that near agree on all letters of some PARTS - 2 parts. Every
choice of so many parts is a signature: the word's letters of these parts. Words are
joined on equal signatures and verified, and each pair counts at the first signature
it shares, told by the parts of the letters that differ.

Within a signature no pairs are made: words are verified by what is left of them
without one letter, which near words have in common. A signature of very many words
is dealt again by that rest, of which there are never more than a word has letters.

Words are kept as Latin-1 bytes, one a letter; their order is that of the code points.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import slices, utf8
from tapeloom.llm.periodic_runs import pieces
from tapeloom.session import materialize

#: Words of the vocabulary have at least so many letters and occurrences.
SHORTEST, LEAST = 5, 3
#: A run with a checksum of document and run that this divides loses a letter.
DAMAGED = 97
#: Parts of the letters; signatures are the choices of all but two of them.
PARTS = 5
#: Words of a signature that a task holds; more are dealt again.
HELD = 1 << 15
#: Distinct words a task counts before it hands them on, and keys it holds before it answers.
COUNTED = 1 << 18
#: Latin-1 bytes: A-Z become a-z, letters stay, the rest parts words.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))

CHOICES = list(combinations(range(PARTS), PARTS - 2))
#: The first choice that leaves out the parts x and y.
FIRST = [[next(i for i, c in enumerate(CHOICES) if x not in c and y not in c) for y in range(PARTS)] for x in range(PARTS)]


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The runs of letters of a text, lower-cased (A-Z), in lists of bounded size."""
    for piece in pieces(text):
        # A character beyond Latin-1 becomes a question mark, which parts words as it did.
        yield piece.decode().encode("latin-1", "replace").translate(LETTERS).split()


def damaged(word: bytes, seed: int) -> bytes:
    """The word, without one letter if its checksum says so."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
    if h % DAMAGED:
        return word
    i = h % len(word)
    return word[:i] + word[i + 1 :]


def vocabulary(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n) of all texts: the words of at least SHORTEST letters and LEAST occurrences, as Latin-1 bytes.

    Runs of letters are those of Latin script up to U+00FF; a few lose a letter, told by the
    checksum of `<key>:<run>`. Counts are added up within a task before they move.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                for k, t in zip(*(part.column(i).to_pylist() for i in range(2)), strict=True):
                    seed, own = zlib.crc32(f"{k}:".encode() if k is not None else b":"), Counter()
                    for some in words_of(t):
                        own.update(some)
                    for word, n in own.items():
                        if len(word) >= SHORTEST and len(word := damaged(word, seed)) >= SHORTEST:
                            counts[word] += n
                if len(counts) >= COUNTED:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    rows = docs.select(F.col(f"`{key}`").cast("string").alias("key"), utf8(F.col(f"`{text}`")).alias("text"))
    counted = rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST)


def letter_parts(words: DataFrame) -> list[int]:
    """The part of each of the 256 letters: the most frequent ones are dealt to and fro."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            counts.update(b"".join(batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["c", "n"])

    found = words.select("word").mapInArrow(run, "c int, n long").groupBy("c").agg(F.sum("n").alias("n"))
    order = sorted(found.collect(), key=lambda r: (-r["n"], r["c"]))  # at most 256 rows
    parts = [c % PARTS for c in range(256)]
    for turn, row in enumerate(order):
        lap, at = divmod(turn, PARTS)
        parts[row["c"]] = at if lap % 2 == 0 else PARTS - 1 - at
    return parts


def signatures(words: DataFrame, parts: list[int]) -> DataFrame:
    """(choice, letters, word, n): each word once for each choice of parts, with its letters of these parts."""
    tables = [bytes(c for c in range(256) if parts[c] not in choice) for choice in CHOICES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ordered = [bytes(sorted(w)) for w in batch.column(0).to_pylist()]
            for i, without in enumerate(tables):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(ordered), pa.int32()), pa.array([w.translate(None, without) for w in ordered], pa.binary()),
                     *batch.columns], names=["choice", "letters", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "choice int, letters binary, word binary, n long")


class Nearest:
    """Per word how many near ones were found, and the one of largest n, the smallest of equal ones."""

    def __init__(self) -> None:
        self.found: dict[bytes, tuple[int, int, int, bytes]] = {}

    def add(self, word: bytes, n: int, other: bytes, m: int) -> None:
        _, many, best, form = self.found.get(word, (0, 0, -1, b""))
        if m > best or (m == best and other < form):
            best, form = m, other
        self.found[word] = (n, many + 1, best, form)

    def out(self) -> pa.RecordBatch:
        n, many, best, form = zip(*self.found.values(), strict=True) if self.found else ((), (), (), ())
        batch = pa.RecordBatch.from_arrays(
            [pa.array(list(self.found), pa.binary()), pa.array(n, pa.int64()), pa.array(many, pa.int64()),
             pa.array(best, pa.int64()), pa.array(form, pa.binary())], names=["word", "n", "n_near", "best", "near"])
        self.found = {}
        return batch


def met(rest: bytes, replaced: dict[int, list[tuple[int, bytes, int]]], whole: int | None, choice: int,
        parts: list[int], found: Nearest) -> None:
    """Counts the near words among those that leave `rest`: by place (letter, word, n); `whole` is the count of the word `rest`."""
    for place, members in replaced.items():
        for i, (c, word, n) in enumerate(members):
            for d, other, m in members[:i]:
                if FIRST[parts[c]][parts[d]] == choice:
                    found.add(word, n, other, m)
                    found.add(other, m, word, n)
            if whole is not None and (place == 0 or word[place - 1] != c) and FIRST[parts[c]][parts[c]] == choice:
                found.add(word, n, rest, whole)
                found.add(rest, whole, word, n)


def verified(members: list[tuple[bytes, int]], choice: int, parts: list[int], found: Nearest) -> None:
    """Counts the near words among the members of a signature."""
    counts = dict(members)
    rests: dict[bytes, list] = {}
    for word, n in members:
        for place, c in enumerate(word):
            rests.setdefault(word[:place] + word[place + 1 :], []).append((place, c, word, n))
    for rest, left in rests.items():
        if len(left) > 1 or rest in counts:
            replaced = defaultdict(list)
            for place, c, word, n in left:
                replaced[place].append((c, word, n))
            met(rest, replaced, counts.get(rest), choice, parts, found)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of sorted batches by their first `keys` columns."""
    key, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield key, held


FOUND = "word binary, n long, n_near long, best long, near binary"


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best, near) of a written table (word, n): for each word with near ones how many, and the most frequent.

    Each task adds up what it finds of a word before it moves, so the rows that move are
    words times signatures at most, however many pairs there are.
    """
    parts = letter_parts(words)
    signed = materialize(signatures(words, parts), "signatures")
    crowded = materialize(signed.groupBy("choice", "letters").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > HELD)
                          .select("choice", "letters"), "crowded")
    few = signed.join(crowded, ["choice", "letters"], "left_anti")
    many = signed.join(crowded, ["choice", "letters"], "left_semi")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Nearest()
        for (choice, _), members in groups(batches, 2):
            if len(members) > 1:
                verified(members, choice, parts, found)
            if len(found.found) >= COUNTED:
                yield found.out()
        yield found.out()

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (choice, rest, place, c, word, n)
                for choice, word, n in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True)
                for rest, place, c in [(word, -1, 0), *((word[:i] + word[i + 1 :], i, c) for i, c in enumerate(word))]
            ]
            kinds = (pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["choice", "rest", "place", "c", "word", "n"])

    def by_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Nearest()
        for (choice, rest), rows in groups(batches, 2):
            if len(rows) > 1:
                replaced, whole = defaultdict(list), None
                for place, c, word, n in rows:
                    if place < 0:
                        whole = n
                    else:
                        replaced[place].append((c, word, n))
                met(rest, replaced, whole, choice, parts, found)
            if len(found.found) >= COUNTED:
                yield found.out()
        yield found.out()

    few = few.select("choice", "letters", "word", "n").repartition("choice", "letters").sortWithinPartitions("choice", "letters")
    again = many.mapInArrow(left, "choice int, rest binary, place int, c int, word binary, n long")
    again = again.repartition("choice", "rest").sortWithinPartitions("choice", "rest")
    told = few.mapInArrow(within, FOUND).unionByName(again.mapInArrow(by_rest, FOUND))
    first = F.struct((-F.col("best")).alias("m"), F.col("near").alias("near"))
    return told.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), F.min(first).alias("first")).select(
        "word", "n", "n_near", (-F.col("first.m")).alias("best"), F.col("first.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a written table (word, form): the last word that forms lead to.

    A form occurs at least twice as often as its word, so a chain has at most as many links
    as counts have bits. Each turn doubles the step.
    """
    jump = forms.select("word", F.col("form").alias("root"))
    while True:
        beyond = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(jump.join(beyond, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        jump = step.select("word", "root")
        if step.where("moved").isEmpty():
            return jump


def text_of(column: str) -> Column:
    return F.decode(F.col(column), "ISO-8859-1")


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per word of the vocabulary: word, form, root, n, n_near, form_n.

    Words are near if exactly one letter is inserted, deleted or replaced. A word's form is its
    near word of largest n, of equal ones the smallest, if that n is at least twice its own;
    root is the last word that forms lead to, the word itself if it has none.

    Null and empty texts have no words; a null key counts as the text ''; repeated rows count
    each; an empty table gives an empty table; other columns are not read. Very long texts
    are split into words a piece at a time.
    """
    words = materialize(vocabulary(docs, text, key), "vocabulary")
    near = near_words(words)
    known = F.col("best") >= 2 * F.col("n")
    near = materialize(near.select("word", "n_near", F.when(known, F.col("near")).alias("form"), F.when(known, F.col("best")).alias("form_n")), "near")
    last = roots(near.where(F.col("form").isNotNull()).select("word", "form"))
    rows = words.join(near, "word", "left").join(last, "word", "left")
    return rows.select(
        text_of("word").alias("word"), text_of("form").alias("form"),
        F.coalesce(text_of("root"), text_of("word")).alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
