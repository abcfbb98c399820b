"""Benchmark passages in training texts, by suffix arrays of the training texts.

The words of a block of documents are numbered by the items' vocabulary; a word that
no item holds is 0 and ends every match. The places from which at least a window of
known words goes on are sorted by the words that follow: the block's suffix array.
Every distinct window of the items is searched in it by bisection, which gives the
places where it occurs; from there the longest verbatim match is found by bisection
among the items' own sorted suffixes. Documents stay where they are read: each
block of a task is a shard of its own, and nothing is shuffled.

The items travel to the tasks, at most ITEM_BYTES of text at a time; a larger
benchmark goes in several passes within the same stage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from tapeloom.llm.common import map_texts, utf8
from tapeloom.llm.periodic_runs import pieces

#: Words of a window; an item of fewer words is a window itself.
WINDOW = 10
#: Bytes of item texts searched in one pass.
ITEM_BYTES = 16 << 20
#: Words in a suffix array.
SHARD_WORDS = 1 << 21
#: A-Z become a-z; digits, letters and everything beyond ASCII belong to words, the rest parts them.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded size."""
    return (piece.split() for piece in pieces(text.translate(WORD_BYTES)))


def known_ahead(codes: np.ndarray) -> np.ndarray:
    """For each place how many words go on before the next 0."""
    n = len(codes)
    zero = np.where(codes == 0, np.arange(n), n)
    return np.minimum.accumulate(zero[::-1])[::-1] - np.arange(n)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places of words, sorted by the words from there to the next 0, `depth` of them at least; by prefix doubling."""
    n = len(codes)
    at = np.flatnonzero(codes)
    ahead = known_ahead(codes)
    order = at[np.argsort(codes[at], kind="stable")]
    slot = np.zeros(n, np.int64)
    rank = np.zeros(n + 2 * depth, np.int64)

    def grouped(key: np.ndarray, places: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Ranks by the first slot of equal keys; the places of groups of more than one."""
        new = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        rank[places] = slots[first][group] + 1
        return places[np.diff(np.r_[first, len(places)])[group] > 1]

    if not len(order):
        return order
    slot[order] = np.arange(len(order))
    tied, h = grouped(codes[order], order, slot[order]), 1
    while h < depth:
        tied = tied[ahead[tied] >= h]  # beyond the next 0 nothing matters
        if not len(tied):
            break
        key = rank[tied] * (len(order) + 2) + rank[tied + h]
        by_key = np.argsort(key, kind="stable")
        slots, places = np.sort(slot[tied]), tied[by_key]
        order[slots], slot[places] = places, slots
        tied, h = grouped(key[by_key], places, slots), 2 * h
    return order


def compared(row: np.ndarray, at: np.ndarray, needles: np.ndarray, needle: np.ndarray, size: np.ndarray, depth: int):
    """Sign of `row` at each place against a needle of `size` words, and how many words agree; `depth` words agree already."""
    sign, agree, todo = np.zeros(len(at), np.int64), np.full(len(at), depth), np.flatnonzero(size > depth)
    while len(todo):
        x, y = row[at[todo] + depth], needles[needle[todo] + depth]
        sign[todo] = np.sign(x.astype(np.int64) - y)
        same = (x == y) & (x > 0)
        agree[todo[same]] += 1
        depth += 1
        todo = todo[same & (size[todo] > depth)]
    return sign, agree


def bisected(row, order, low, high, needles, needle, size, depth: int, upper: bool) -> np.ndarray:
    """For each needle the first place of `order` within [low, high) that is not below it; with `upper`, that is above it."""
    low, high = low.copy(), high.copy()
    todo = np.flatnonzero(low < high)
    while len(todo):
        middle = (low[todo] + high[todo]) >> 1
        sign, _ = compared(row, order[middle], needles, needle[todo], size[todo], depth)
        right = sign <= 0 if upper else sign < 0
        low[todo[right]] = middle[right] + 1
        high[todo[~right]] = middle[~right]
        todo = todo[low[todo] < high[todo]]
    return low


@dataclass
class Items:
    """What the tasks know of the items: their words, their distinct windows, and their suffixes in order."""

    ids: list[str]
    words: dict[bytes, int]
    row: np.ndarray  # the items' words, 0 after each item
    item: np.ndarray  # the item at each place
    begin: np.ndarray  # the first place of each item
    windows: dict[int, np.ndarray]  # by width: the first place of each distinct window
    holders: dict[int, list[list[int]]]  # by width: the items of each distinct window
    suffixes: np.ndarray  # places of whole windows, in order
    group: np.ndarray  # the suffixes of each distinct whole window: its first and last in `suffixes`

    @staticmethod
    def of(rows: list[tuple[str, bytes]]) -> Items:
        rows = sorted(set(rows))
        words: dict[bytes, int] = {}
        texts = [[words.setdefault(w, len(words) + 1) for some in words_of(t) for w in some] for _, t in rows]
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.r_[0, np.cumsum(sizes + 1)[:-1]] if len(texts) else np.zeros(0, np.int64)
        row = np.zeros(int((sizes + 1).sum()) + 2 * WINDOW, np.int32)
        item = np.zeros(len(row), np.int64)
        for i, t in enumerate(texts):
            row[begin[i] : begin[i] + len(t)] = t
            item[begin[i] : begin[i] + len(t)] = i
        order = suffix_array(row, int(sizes.max(initial=1)))
        windows, holders, suffixes, group = {}, {}, order[:0], np.zeros((0, 2), np.int64)
        for width in sorted(set(np.minimum(sizes, WINDOW).tolist()) - {0}):
            if width == WINDOW:
                starts = order[known_ahead(row)[order] >= WINDOW]
            else:  # items that are one window
                starts = order[np.isin(order, begin[sizes == width])]
            table = row[starts[:, None] + np.arange(width)]
            new = np.r_[True, (table[1:] != table[:-1]).any(axis=1)]
            windows[width] = starts[new]
            firsts = np.r_[np.flatnonzero(new), len(starts)]
            of = item[starts].tolist()
            holders[width] = [sorted(set(of[a:b])) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]
            if width == WINDOW:
                suffixes, group = starts, np.stack([firsts[:-1], firsts[1:]], axis=1)
        return Items([i for i, _ in rows], words, row, item, begin, windows, holders, suffixes, group)

    def narrowest(self) -> int:
        return min(self.windows, default=WINDOW)


def occurrences(shard: np.ndarray, items: Items) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, place, window) of all windows that occur in a shard of word numbers."""
    least = items.narrowest()
    shard = np.r_[shard, np.zeros(2 * WINDOW, shard.dtype)]
    edge = np.flatnonzero(np.diff(np.r_[0, (shard > 0).view(np.int8), 0]))
    short = (edge[1::2] - edge[::2]) < least  # stretches of known words too short for any window
    for s, e in zip(edge[::2][short].tolist(), edge[1::2][short].tolist(), strict=True):
        shard[s:e] = 0
    order = suffix_array(shard, WINDOW)
    order = order[known_ahead(shard)[order] >= least]
    if not len(order):
        return
    spread = len(items.words) + 2
    two = shard[order].astype(np.int64) * spread + shard[order + 1]
    for width, windows in items.windows.items():
        first = items.row[windows].astype(np.int64) * spread
        if width == 1:
            low, high = np.searchsorted(two, first), np.searchsorted(two, first + spread)
        else:
            first += items.row[windows + 1]
            low, high = np.searchsorted(two, first), np.searchsorted(two, first, "right")
            size = np.full(len(windows), width)
            start = bisected(shard, order, low, high, items.row, windows, size, 2, False)
            low, high = start, bisected(shard, order, start, high, items.row, windows, size, 2, True)
        found = np.flatnonzero(low < high)
        many = (high - low)[found]
        if len(found):
            window = np.repeat(found, many)
            place = order[np.repeat(low[found] - np.cumsum(many) + many, many) + np.arange(len(window))]
            yield width, place, window


def longest_matches(shard: np.ndarray, place: np.ndarray, window: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """For places where a whole window occurs the length of the longest verbatim match from there, and where in the items."""
    longest = int(known_ahead(items.row).max(initial=0))
    shard = np.r_[shard, np.zeros(longest + 1, shard.dtype)]
    low, high = items.group[window, 0], items.group[window, 1]
    # Roles change: the places of the shard are searched among the items' suffixes.
    at = bisected(items.row, items.suffixes, low, high, shard, place, known_ahead(shard)[place], WINDOW, False)
    best, where = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    for near in (at - 1, at):
        inside = np.flatnonzero((near >= low) & (near < high))
        there = items.suffixes[near[inside]]
        _, agree = compared(items.row, there, shard, place[inside], known_ahead(shard)[place[inside]], WINDOW)
        better = agree > best[inside]
        best[inside[better]], where[inside[better]] = agree[better], there[better]
    return best, where


SPAN = StructType([StructField("start", LongType(), False), StructField("end", LongType(), False)])
LONGEST = StructType([
    StructField("length", LongType()), StructField("start", LongType()), StructField("item", StringType()),
    StructField("item_start", LongType())])
FOUND = StructType([
    StructField("n_words", LongType()), StructField("spans", ArrayType(SPAN, False)),
    StructField("items", ArrayType(StringType(), False)), StructField("longest", LONGEST)])
FOUND_ARROW = pa.struct([
    pa.field("n_words", pa.int64()),
    pa.field("spans", pa.list_(pa.field("element", pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "end")]), False))),
    pa.field("items", pa.list_(pa.field("element", pa.string(), False))),
    pa.field("longest", pa.struct([
        pa.field("length", pa.int64()), pa.field("start", pa.int64()), pa.field("item", pa.string()),
        pa.field("item_start", pa.int64())])),
])


def search(texts: list[bytes], items: Items) -> list[dict]:
    """For each text its number of words, the spans of words hit, the items found and the longest verbatim match."""
    coded = []
    for text in texts:
        coded += [np.fromiter((items.words.get(w, 0) for w in some), np.int32, len(some)) for some in words_of(text)]
        coded.append(None)
    starts, ends, parts, at = [0], [], [], 0
    for part in coded:
        if part is None:
            ends.append(at)
            parts.append(np.zeros(1, np.int32))
            at += 1
            starts.append(at)
        else:
            parts.append(part)
            at += len(part)
    row = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    begin = np.array(starts[:-1], np.int64)
    marks = np.zeros(len(row) + 1, np.int64)
    held: list[set[int]] = [set() for _ in texts]
    longest: list[tuple | None] = [None] * len(texts)
    for first in range(0, len(row), SHARD_WORDS):
        shard = row[first : first + SHARD_WORDS + WINDOW - 1]
        for width, place, window in occurrences(shard, items):
            np.add.at(marks, first + place, 1)
            np.add.at(marks, first + place + width, -1)
            text = np.searchsorted(begin, first + place, "right") - 1
            pair = np.unique(text * len(items.windows[width]) + window)
            for t, w in zip(*(x.tolist() for x in np.divmod(pair, len(items.windows[width]))), strict=True):
                held[t].update(items.holders[width][w])
            if width == WINDOW:
                size, where = longest_matches(row[first:], place, window, items)
            else:
                size, where = np.full(len(place), width), items.windows[width][window]
            by = np.lexsort((where, place, -size, text))
            by = by[np.r_[True, text[by][1:] != text[by][:-1]]]
            for t, n, p, w in zip(text[by].tolist(), size[by].tolist(), (first + place[by]).tolist(), where[by].tolist(), strict=True):
                i = int(items.item[w])
                new = (-n, p - starts[t], items.ids[i], w - int(items.begin[i]))
                longest[t] = min(longest[t], new) if longest[t] else new
    hit = np.cumsum(marks[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.r_[0, hit.view(np.int8), 0]))
    spans: list[list[dict]] = [[] for _ in texts]
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        t = int(np.searchsorted(begin, s, "right")) - 1
        spans[t].append({"start": s - starts[t], "end": e - starts[t]})
    names = ("length", "start", "item", "item_start")
    return [{
        "n_words": ends[t] - starts[t], "spans": spans[t], "items": sorted({items.ids[i] for i in held[t]}),
        "longest": dict(zip(names, (-longest[t][0], *longest[t][1:]), strict=True)) if longest[t] else None,
    } for t in range(len(texts))]


def merged(a: dict | None, b: dict) -> dict:
    """What two passes over other items found in the same text."""
    if a is None:
        return b
    spans: list[dict] = []
    for x in sorted(a["spans"] + b["spans"], key=lambda x: x["start"]):
        if spans and x["start"] <= spans[-1]["end"]:
            spans[-1] = {"start": spans[-1]["start"], "end": max(spans[-1]["end"], x["end"])}
        else:
            spans.append(x)
    longest = min((x["longest"] for x in (a, b) if x["longest"]), default=None,
                  key=lambda m: (-m["length"], m["start"], m["item"], m["item_start"]))
    return {"n_words": b["n_words"], "spans": spans, "items": sorted({*a["items"], *b["items"]}), "longest": longest}


def matches(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
            name: str = "matches", whole: bool = True, most: int = ITEM_BYTES) -> DataFrame:
    """`docs` with a column `matches`: n_words, spans, items and longest.

    Words are lower-cased (A-Z) and hold digits, letters and everything beyond ASCII. A window
    is ten consecutive words of an item, or all words of a shorter one; items without words
    have none. `spans` are the stretches of the text's words [start, end) that lie in
    occurrences of windows, `items` the ids of the items with an occurring window as text,
    each once and sorted, `longest` the longest verbatim match (length, start, item,
    item_start): of equal ones the first in the text, then the smallest item id.

    Null, empty and blank texts have no words and no matches. Items with the same id are one
    item; a null id is the text ''. A very long text is searched in overlapping shards: windows
    are found in all of it, and `longest` is followed to its end beyond a shard. Repeated rows
    are answered each; an empty table, or an empty benchmark, gives rows without matches; other
    columns pass through, one with the name of the new column is replaced. Without `whole` the
    text itself is left out of the result.
    """
    rows = items.select(
        F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("id"), utf8(F.col(f"`{item_text}`")).alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // most))
    docs = docs.drop(name) if name != text else docs
    columns = docs.columns
    docs = docs.withColumn("\u0001null", F.col(f"`{text}`").isNull()).withColumnRenamed(text, "\u0001text")
    for turn in range(passes):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == turn) if passes > 1 else rows
        told = part.toArrow()  # at most about `most` bytes
        known = Items.of(list(zip(told["id"].to_pylist(), told["text"].to_pylist(), strict=True)))
        again = whole or turn < passes - 1

        def work(texts: list[bytes], before: list | None = None, known: Items = known, again: bool = again) -> list[pa.Array]:
            new = [merged(a, b) for a, b in zip(before or [None] * len(texts), search(texts, known), strict=True)]
            return [*([pa.array(texts, pa.binary())] if again else []), pa.array(new, FOUND_ARROW)]

        fields = [*([StructField("\u0001text", BinaryType())] if again else []), StructField(f"\u0001{turn}", FOUND)]
        docs = map_texts(docs, "\u0001text", fields, lambda work=work: work, f"\u0001{turn - 1}").drop(f"\u0001{turn - 1}")
    same = F.when(~F.col("\u0001null"), F.col("\u0001text").cast("string")).alias(text) if whole else None
    kept = [same if c == text else F.col(f"`{c}`") for c in columns if whole or c != text]
    return docs.select(*kept, F.col(f"\u0001{passes - 1}").alias(name))


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of `docs`, in its columns, in which no window of an item occurs; see `matches`."""
    found = matches(docs, items, text, name="\u0001matches", **options)
    return found.where(F.size("\u0001matches.items") == 0).select(*[f"`{c}`" for c in docs.columns])
