"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, accents of compatibility forms, letters of
other scripts that look like Latin ones, digits and signs that stand for letters. The lexicon holds words and beginnings of words with weights; an
exception phrase is a word with a neighbour in whose company it is harmless, and
takes the weight back. The sum is normalised by the length of the text and turned
into a probability.

The lexicon is learnt from labelled texts: the entries that between them reach the
toxic ones and stay off the clean ones, weighted by their log-odds.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from tapeloom.llm.common import labelled_sample, map_texts

# Letters of other scripts by the Latin ones they look like, and what stands for a letter in a word.
# l and 1 both look like i, so all three are one letter here.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɡ": "g", "ⅼ": "i", "ı": "i", "l": "i",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
FOLD = str.maketrans(HOMOGLYPHS | SUBSTITUTES)
NOT_A_LETTER = re.compile(r"[\W_]+")
#: Labelled texts the lexicon is learnt from, at most: those with the smallest hash of the id, per class.
SAMPLE = {0: 4000, 1: 2500}
#: Lengths of word beginnings that may become entries.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: Entries that should reach a toxic text, if there are so many.
DEMAND = 3
LARGEST_WEIGHT = 8.0


def folded(text: bytes) -> str:
    """The folded words of a text, with one space around each."""
    plain = unicodedata.normalize("NFKC", text.decode()).lower().translate(FOLD)
    return f" {NOT_A_LETTER.sub(' ', plain).strip()} "


def entries_of(words: list[str]) -> set[str]:
    """What could be a lexicon entry: ' word ' and the beginnings ' wor'."""
    found = set()
    for word in set(words):
        found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in BEGINNINGS if len(word) > n)
    return found


@dataclass
class Lexicon:
    """Weights of entries and of exception phrases, and what turns a text's sum into a probability."""

    weights: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, ...] = (0.0, 0.0, 0.0)

    def automaton(self):
        """Matches every entry of a folded text, overlapping ones included."""
        import ahocorasick

        machine = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            machine.add_word(entry, weight)
        if self.weights:
            machine.make_automaton()
        return machine

    def features(self, machine, text: str) -> tuple[float, float]:
        """Sum of the weights matched, and that sum by the length of the text."""
        total = sum(weight for _, weight in machine.iter(text)) if self.weights else 0.0
        total = max(total, 0.0)
        return math.log1p(total), math.log1p(100 * total / (text.count(" ") + 20))

    def probability(self, features: tuple[float, float]) -> float:
        a, b, c = self.coefficients
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * features[0] + c * features[1]))))


def distinct_texts(texts: list[str]) -> list[str]:
    """One text of each group of copies and near copies: those that share the smallest checksum of three words."""
    seen, kept = set(), []
    for text in texts:
        words = text.split()
        mark = min((zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)
        if mark not in seen:
            seen.add(mark)
            kept.append(text)
    return kept


def usual_neighbours(wanted: set[str], texts: list[str]) -> dict[str, list[str]]:
    """For each wanted word the phrases with the word before and the word after it that a majority of its uses could be.

    A vote per word and side: a neighbour that makes up more than half of the uses wins it.
    """
    votes: tuple[dict, dict] = ({}, {})
    for text in texts:
        words = ["", *text.split(), ""]
        for i in range(1, len(words) - 1):
            if (word := words[i]) in wanted:
                for vote, other in zip(votes, (words[i - 1], words[i + 1]), strict=True):
                    held, n = vote.get(word, ("", 0))
                    vote[word] = (held, n + 1) if held == other else (held, n - 1) if n else (other, 1)
    phrases = defaultdict(list)
    for vote, form in zip(votes, (lambda w, o: f" {o} {w} ", lambda w, o: f" {w} {o} "), strict=True):
        for word, (other, n) in vote.items():
            if other and n:
                phrases[word].append(form(word, other))
    return phrases


def excused(words: set[str], toxic: list[str], clean: list[str]) -> dict[str, tuple[str, int]]:
    """For words that clean texts use too: the phrase that is most of that use, and how many clean texts use them otherwise.

    The phrase must be three times as frequent in clean texts as in toxic ones.
    """
    phrases = usual_neighbours(words, clean)
    within, otherwise = (Counter(), Counter()), Counter()
    for y, texts in enumerate((clean, toxic)):
        for text in texts:
            found, outside = set(), set()
            around = ["", *text.split(), ""]
            for i in range(1, len(around) - 1):
                for phrase in phrases.get(around[i], ()):
                    if phrase in (f" {around[i - 1]} {around[i]} ", f" {around[i]} {around[i + 1]} "):
                        found.add((around[i], phrase))
                    else:
                        outside.add((around[i], phrase))
            within[y].update(found)
            if y == 0:
                otherwise.update(outside)
    best: dict[str, tuple[int, str]] = {}
    for (word, phrase), n in within[0].items():
        if n >= 3 and n > 3 * within[1][word, phrase]:
            best[word] = min(best.get(word, (len(clean) + 1, "")), (otherwise[word, phrase], phrase))
    return {word: (phrase, n) for word, (n, phrase) in best.items()}


def chosen_entries(toxic: list[str], clean: list[str]) -> dict[str, float]:
    """Entries by weight: greedily those that reach most toxic texts that are in need of one, less the clean ones.

    Of entries that reach the same texts the longest is taken, and none that begins as one
    already taken does. A word whose clean use is one phrase may be an entry, with that
    phrase as an exception of opposite weight.
    """
    least = max(2, min(3, len(toxic) // 8), len(toxic) // 150)
    seen = Counter()  # by hash, so never too few: most entries are rare, and none of those is held
    for text in toxic:
        seen.update({hash(entry) for entry in entries_of(text.split())})
    reached = defaultdict(set)
    for i, text in enumerate(toxic):
        for entry in entries_of(text.split()):
            if seen[hash(entry)] >= least:
                reached[entry].add(i)
    del seen
    reached = {entry: texts for entry, texts in reached.items() if len(texts) >= least}
    harmless = Counter()
    for text in clean:
        harmless.update(entry for entry in entries_of(text.split()) if entry in reached)

    def log_odds(entry: str) -> float:
        return (math.log((len(reached[entry]) + 0.5) / (len(toxic) + 1))
                - math.log((harmless[entry] + 0.5) / (len(clean) + 1)))

    def telling(entry: str) -> bool:
        sure = log_odds(entry) - 2 / math.sqrt(len(reached[entry]) + 0.5)  # few texts may be chance
        return sure >= 2.5 and harmless[entry] * 10 <= len(reached[entry])

    doubtful = {e.strip() for e in reached if e.endswith(" ") and log_odds(e) > 0 and not telling(e)}
    exceptions = {}
    for word, (phrase, otherwise) in excused(doubtful, toxic, clean).items():
        before, harmless[f" {word} "] = harmless[f" {word} "], otherwise
        if telling(f" {word} "):
            exceptions[f" {word} "] = phrase
        else:
            harmless[f" {word} "] = before
    need = [DEMAND] * len(toxic)
    heap = [(-len(texts), -len(e), e) for e, texts in reached.items() if telling(e)]
    heapq.heapify(heap)
    weights: dict[str, float] = {}
    while heap:
        _, size, entry = heapq.heappop(heap)
        if any(entry.startswith(w.rstrip()) or w.startswith(entry.rstrip()) for w in weights):
            continue
        gain = sum(need[i] > 0 for i in reached[entry]) - 3 * harmless[entry]
        if gain < least:
            continue
        if heap and (-gain, size, entry) > heap[0]:
            heapq.heappush(heap, (-gain, size, entry))
            continue
        weights[entry] = min(LARGEST_WEIGHT, log_odds(entry))
        for i in reached[entry]:
            need[i] -= 1
    return weights | {phrase: -weights[entry] for entry, phrase in exceptions.items() if entry in weights}


def learn(sample: list[tuple[bytes, int]]) -> Lexicon:
    """A lexicon from (text, toxic) pairs. Without any toxic text every score is the prior of the sample."""
    texts = {y: distinct_texts([folded(t) for t, label in sample if label == y]) for y in (0, 1)}
    clean, toxic = texts[0], texts[1]
    lexicon = Lexicon()
    if toxic:
        lexicon.weights = chosen_entries(toxic, clean)
    machine = lexicon.automaton()
    x = np.array([[1.0, *lexicon.features(machine, t)] for t in clean + toxic]).reshape(-1, 3)
    y = np.array([0.0] * len(clean) + [1.0] * len(toxic))
    w = np.zeros(3)
    for _ in range(50 if len(y) else 0):  # Newton's method with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + 1e-2 * w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), gradient)
    lexicon.coefficients = tuple(map(float, w))
    return lexicon


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> Lexicon:
    """A lexicon from the labelled documents for which `usable` holds, a bounded sample of them (SAMPLE)."""
    rows = labelled_sample(docs, labels, "toxic", usable, SAMPLE).select("text", "y").toArrow()
    pairs = sorted(zip(rows["text"].to_pylist(), rows["y"].to_pylist(), strict=True))
    return learn(pairs)


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with the probability of being toxic in the place of the text.

    Whole texts are scored. Null and empty texts match nothing and get the score of a
    text without a match. Repeated rows are scored each, an empty table gives an empty
    table, other columns pass through; one named as the score is replaced.
    """
    def make():
        machine = lexicon.automaton()
        return lambda texts: [
            pa.array([lexicon.probability(lexicon.features(machine, folded(t))) for t in texts], pa.float64())]

    return map_texts(docs.drop(name) if name != text else docs, text, [StructField(name, DoubleType())], make)


def accepted(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of `docs`, in its columns, that score below the threshold.

    Rows are filtered where they are: a text goes to the worker once, and rejected rows never
    come back. Null and empty texts match nothing and stay as they are if a text without a
    match does; a very long text is scored whole and alone; repeated rows are told each, and
    alike; other columns pass through whatever their names or nulls; an empty table gives an
    empty table.
    """
    schema = docs.schema
    at = schema.names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()

        def harmless(value) -> bool:
            raw = value.as_buffer()
            return lexicon.probability(lexicon.features(machine, folded(raw.to_pybytes() if raw else b""))) < threshold

        for batch in batches:
            raw = batch.column(at).cast(pa.binary())
            yield batch.filter(pa.array([harmless(v) for v in raw], pa.bool_()))
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema)
