"""Hierarchical packing of documents into windows of several lengths.

Each task packs the documents of its own input split, block by block, so nothing
is shuffled and memory is bounded by the block. Whole windows are cut from long
documents first. What remains is routed to tiers by length (512, 1024, 2048, 4096);
tiers are packed from long to short: a window of the tier opens with its longest
piece, its gap is filled with the longest pieces of the shorter tiers that fit, and
only if none fits the shortest left is cut. What can't fill the last window of a
block goes to windows that are powers of two, so no window is padded. Windows of a
tier are dealt to steps of equal tokens by their attention cost, in turns.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tapeloom.llm.common import slices, utf8

TIERS = (512, 1024, 2048, 4096)
#: Tokens of a step: as many windows of a tier as make up eight of the longest.
STEP_TOKENS = 8 * 4096
#: Bytes of text packed at once, and split into words at once: these are objects of their own, many times the text.
BLOCK_BYTES, ENCODED_BYTES = 4 << 20, 1 << 20
#: Distinct words, and bytes of words and ids, after which a worker begins a new table of words; what it meets again it
#: takes from the last one.
REMEMBERED, REMEMBERED_BYTES = 400_000, 24 << 20
#: Signs that may stand between words sent to the tokenizer together; the first that is one token is used.
SEPARATORS = ("⚽", "✨", "♥", "🎉")
#: Words in a line, and lines in a call: the library's answers are many times the ids.
LINE, CALL = 500, 8


# The steps of a tokenizer whose ids of a text are those of its words.
NORMALIZERS = [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_words(tokenizer_path: str) -> bool:
    """Whether the tokenizer's normaliser and pre-tokenizer are those that `encoder` counts on."""
    with open(tokenizer_path, encoding="utf-8") as file:
        told = json.load(file)
    normal = (told.get("normalizer") or {}).get("normalizers", [])
    steps = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [(n["type"], n.get("pattern", {}).get("Regex")) for n in normal] == NORMALIZERS
        and [s["type"] for s in steps] == ["Split", "ByteLevel"]
        and steps[0]["pattern"].get("Regex") == SPLIT and not steps[1]["add_prefix_space"]
        and told.get("post_processor") is None and not told["model"].get("dropout")
    )


def kept_encoder(tokenizer_path: str, end: int):
    """The encoder of this worker process, which its tasks share. It hangs on the library's module: functions
    that travel with a plan have no module of their own on the worker."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("encoders_of_this_process", {})
    if (tokenizer_path, end) not in kept:
        kept[tokenizer_path, end] = encoder(tokenizer_path, end)
    return kept[tokenizer_path, end]


def encoder(tokenizer_path: str, end: int):
    """A function from UTF-8 texts to arrays of token ids, each closed by `end`.

    The vocabulary lowers letters, drops white space, and none of its steps looks across
    it, so the ids of a text are those of its words. Each distinct word is encoded once
    and kept, without the stop or comma after its last letter, which is a pre-token of its
    own. Distinct words go to the tokenizer in lines, with a sign between them that is one
    token. Texts with that sign or the beginning of a special token are encoded whole.
    """
    from tokenizers import Tokenizer

    if not by_words(tokenizer_path):
        raise ValueError(f"{tokenizer_path}: another normaliser or pre-tokenizer than the words are cut for")
    # Spark's tasks are the parallelism; the library's own threads cost memory and time on top.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(tokenizer_path)

    def plain(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    sign = next(s for s in SEPARATORS if len(plain([s])[0]) == 1)
    between, sign_id, sign_bytes = f" {sign} ", plain([sign])[0][0], sign.encode()
    tails = {mark: ids.tobytes() for mark, ids in zip((b".", b","), plain([".", ","]), strict=True)}
    last = np.array([end], np.uint32).tobytes()
    known: dict[bytes, bytes] = {}
    older: dict[bytes, bytes] = {}
    held = 0

    def learn(words: set[bytes]) -> None:
        nonlocal held
        bare = {w: w[:-1] for w in words if w[-1:] in tails and w[-2:-1].isalpha()}
        new = (words.difference(bare) | set(bare.values())).difference(known)
        again = {w: older[w] for w in new if w in older}
        known.update(again)
        new = list(new.difference(again))
        for at in range(0, len(new), LINE * CALL):
            some = new[at : at + LINE * CALL]
            lines = [some[i : i + LINE] for i in range(0, len(some), LINE)]
            for line, ids in zip(lines, plain([between.join(w.decode() for w in line) for line in lines]), strict=True):
                cuts = np.flatnonzero(ids == sign_id).tolist()
                starts, ends = [0, *(4 * c + 4 for c in cuts)], [*(4 * c for c in cuts), 4 * len(ids)]
                flat = ids.tobytes()
                known.update((w, flat[a:b]) for w, a, b in zip(line, starts, ends, strict=True))
        known.update((w, known[core] + tails[w[-1:]]) for w, core in bare.items())
        held += sum(len(w) + len(known[w]) for w in words)

    def encode_some(texts: list[bytes]) -> list[np.ndarray]:
        nonlocal known, older, held
        whole = {i for i, t in enumerate(texts) if b"<|" in t or sign_bytes in t}
        words = [[] if i in whole else t.lower().split() for i, t in enumerate(texts)]  # ASCII letters and blanks
        if len(known) > REMEMBERED or held > REMEMBERED_BYTES:
            known, older, held = {}, known, 0
        learn(set().union(*words).difference(known))
        found = [np.frombuffer(b"".join(map(known.__getitem__, ws)) + last, np.uint32) for ws in words]
        for i, ids in zip(sorted(whole), plain([texts[i].decode() for i in sorted(whole)]), strict=True):
            found[i] = np.append(ids, np.uint32(end))
        return found

    def encode(texts: list[bytes]) -> list[np.ndarray]:
        found, start, held = [], 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= ENCODED_BYTES or i == len(texts) - 1:
                found += encode_some(texts[start : i + 1])
                start, held = i + 1, 0
        return found

    return encode


def pack_block(lengths: list[int]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (size, pieces) for documents of these lengths; a piece is (document, start, length).

    Every token is in exactly one piece and every window is full.
    """
    longest = TIERS[-1]
    windows = []
    left = []  # (length, document, start), sorted
    for doc, length in enumerate(lengths):
        rest = length % longest
        windows += [(longest, [(doc, start, longest)]) for start in range(0, length - rest, longest)]
        if rest:
            left.append((rest, doc, length - rest))
    left.sort()
    while left:
        length, doc, start = left.pop()
        size = next(t for t in TIERS if t >= length)
        pieces, gap = [(doc, start, length)], size - length
        while gap and left:
            fits = bisect_right(left, gap, key=lambda x: x[0])
            if fits:
                length, doc, start = left.pop(fits - 1)
                pieces.append((doc, start, length))
                gap -= length
            else:
                length, doc, start = left.pop(0)
                pieces.append((doc, start, gap))
                insort(left, (length - gap, doc, start + gap))
                gap = 0
        if gap:
            windows += powers_of_two(pieces, size - gap)
        else:
            windows.append((size, pieces))
    return windows


def powers_of_two(pieces: list[tuple[int, int, int]], total: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """The pieces, `total` tokens in all, in windows that are the powers of two `total` is the sum of."""
    windows, todo = [], pieces[::-1]
    while total:
        size = 1 << (total.bit_length() - 1)
        window, room = [], size
        while room:
            doc, start, length = todo.pop()
            take = min(room, length)
            window.append((doc, start, take))
            if length > take:
                todo.append((doc, start + take, length - take))
            room -= take
        windows.append((size, window))
        total -= size
    return windows


def step_numbers(windows: list[tuple[int, list[tuple[int, int, int]]]]) -> list[int]:
    """For each window the number of its step: windows of one size, dealt to and fro by falling attention cost."""
    by_size: dict[int, list[int]] = {}
    for i, (size, _) in enumerate(windows):
        by_size.setdefault(size, []).append(i)
    numbers, first = [0] * len(windows), 0
    for size, members in sorted(by_size.items()):
        cost = {i: sum(n * n for _, _, n in windows[i][1]) for i in members}
        steps = -(-len(members) * size // STEP_TOKENS)
        for turn, i in enumerate(sorted(members, key=lambda i: (-cost[i], i))):
            lap, at = divmod(turn, steps)
            numbers[i] = first + (at if lap % 2 == 0 else steps - 1 - at)
        first += steps
    return numbers


def pack(docs: DataFrame, tokenizer_path: str, end: int, text: str = "text", ids: bool = True) -> DataFrame:
    """The pieces of all rows of `docs`: its columns but the text, and where each piece went.

    start and length place the piece in its document's ids, which are closed by `end`;
    ids_crc32 is their checksum as little-endian 32-bit numbers; doc_tokens the
    document's length; sequence_id, offset and window its place; step_group the step;
    `ids`, if asked for, the ids themselves. A null or empty text is the one id `end`.
    Repeated rows are packed each. An empty table gives an empty table. Columns of `docs`
    with the name of a new column are dropped.
    """
    new = [
        StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType()),
        StructField("doc_tokens", LongType()), StructField("sequence_id", LongType()), StructField("offset", LongType()),
        StructField("window", IntegerType()), StructField("step_group", LongType()),
        *([StructField("ids", ArrayType(IntegerType()))] if ids else []),
    ]
    taken = {f.name for f in new} | {text}
    keep = [f for f in docs.schema.fields if f.name not in taken]
    schema = StructType([*keep, *new])
    carried = docs.select(*[F.col(f"`{f.name}`") for f in keep], utf8(F.col(f"`{text}`")).alias("\u0001text"))
    at, names = len(keep), [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept_encoder(tokenizer_path, end)
        base = TaskContext.get().partitionId() << 40  # tasks number their windows apart
        sequences = steps = base
        for batch in batches:
            for part in slices(batch, at, BLOCK_BYTES):
                found = encode(part.column(at).to_pylist())
                windows = pack_block(list(map(len, found)))
                rows = []
                for i, ((size, pieces), step) in enumerate(zip(windows, step_numbers(windows), strict=True)):
                    offset = 0
                    for doc, start, length in pieces:
                        checksum = zlib.crc32(found[doc][start : start + length])
                        rows.append((doc, start, length, checksum, len(found[doc]), sequences + i, offset, size, steps + step))
                        offset += length
                sequences += len(windows)
                steps += max((r[8] for r in rows), default=steps) - steps + 1
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                kept = part.select(list(range(at))).take(columns[0]).columns
                arrays = [*kept, *columns[1:7], columns[7].cast(pa.int32()), columns[8]]
                if ids:
                    arrays.append(pa.array([found[d][s : s + n].astype(np.int32) for d, s, n, *_ in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=names)
                pa.default_memory_pool().release_unused()

    return carried.mapInArrow(run, schema)
