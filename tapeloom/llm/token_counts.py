"""Token counts from the pieces of distinct pre-tokens.

A SentencePiece BPE vocabulary without a piece that crosses from a character
into a space can be counted by pre-token: a run of spaces and what follows it up
to the next space. The character U+2581 is a space to the model, and so it is here. Each task keeps the piece count of every distinct pre-token it
has met, joins it to a document's pre-token frequencies, and sums; ids are never
made. There is no shuffle: the frequencies of all documents would be many times
the text, the distinct pre-tokens of a task are few.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from tapeloom.llm.common import map_texts

PRE_TOKEN = re.compile(" +[^ ]*")
#: Distinct pre-tokens a task remembers; beyond it the table starts anew, which costs time, never exactness.
REMEMBERED = 500_000


def crossing_pieces(model_path: str) -> list[str]:
    """The pieces with a space after another character; the counts below are exact only if there is none."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = map(model.id_to_piece, range(model.get_piece_size()))
    return [p for p in pieces if "▁" in p.lstrip("▁")]


def piece_counter(model_path: str):
    """A function from UTF-8 texts to token counts."""
    import sentencepiece

    if crossing_pieces(model_path):
        raise ValueError(f"{model_path} has pieces that cross pre-tokens")
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    # The model puts one space before a text by itself, so a pre-token goes in without its first space.
    # A lone space is a piece of its own, which an empty text would not show.
    known = {" ": 1}

    def count(texts: list[bytes]) -> list[int]:
        nonlocal known
        frequencies = [Counter(PRE_TOKEN.findall(" " + t.decode().replace("▁", " "))) if t else Counter() for t in texts]
        new = list({p for f in frequencies for p in f if p not in known})
        if len(known) + len(new) > REMEMBERED:
            known = {" ": 1}
            new = list({p for f in frequencies for p in f if p != " "})
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            known.update(zip(some, map(len, model.encode([p[1:] for p in some], num_threads=1)), strict=True))
        return [sum(known[p] * n for p, n in f.items()) for f in frequencies]

    return count


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """`docs` with n_bytes, n_tokens and over_limit in the place of the text column.

    Counts equal SentencePiece's default encoding without begin and end tokens.
    Null and empty texts have 0 bytes and 0 tokens; a very long text is counted whole
    and handled alone in its slice; repeated rows are counted each;
    an empty table gives an empty table; other columns are passed on, whatever
    their names or nulls.
    """

    def make():
        count = piece_counter(model_path)
        return lambda texts: [
            pa.array([len(t) for t in texts], pa.int64()), pa.array(count(texts), pa.int64()),
        ]

    counted = map_texts(docs, text, [StructField("n_bytes", LongType()), StructField("n_tokens", LongType())], make)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
