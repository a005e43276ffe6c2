"""Byte-level BPE of whole texts as a tree reduction over a monoid, and its inverse.

An element of the monoid is a stretch of text with its ids. A text longer than a leaf is halved, the halves encoded
recursively and joined: a window around the seam, from a proven boundary on the left to one on the right, is
encoded anew and takes the place of the ids between them; the window doubles until it has such boundaries
or holds both halves. A boundary is proven where a blank follows a character that is no white space: no
alternative of the splitting pattern has white space after another character, so a match ends there whatever
stands further left, and what precedes it ends in a match that white space ends as the end of text does. Decoding
concatenates the tokens' bytes up the same tree.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import holds, lean, slices

VOCABULARY = "byte_bpe_50k.tiktoken"
LEAF = 16_384
#: Bytes of texts that a task encodes at once.
TEXTS = 1 << 20
WINDOW = 64


@functools.lru_cache(maxsize=4)
def encoding(path: str | None = None):
    """The tiktoken encoding of a file of ranks; by default the public one under VOCABULARY."""
    import public_tokenizers
    import tiktoken

    ranks = {}
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        for line in file:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


holds(__name__, encoding.cache_clear)


def _last_boundary(text: str, least: int) -> int:
    """The last proven boundary from `least` on, or -1."""
    at = len(text)
    while (at := text.rfind(" ", max(least, 1), at)) > 0:
        if not text[at - 1].isspace():
            return at
    return -1


def _first_boundary(text: str, most: int) -> int:
    """The first proven boundary before `most`, or -1."""
    at = 0
    while (at := text.find(" ", at + 1, most)) > 0:
        if not text[at - 1].isspace():
            return at
    return -1


def _join(enc, left: str, a: np.ndarray, right: str, b: np.ndarray) -> np.ndarray:
    window = WINDOW
    while True:
        # Without a boundary in reach the window takes in the whole half.
        p, q = _last_boundary(left, len(left) - window), _first_boundary(right, window)
        whole_left, whole_right = p < 0 and window >= len(left), q < 0 and window >= len(right)
        if (p >= 0 or whole_left) and (q >= 0 or whole_right):
            tail, head = (left[p:], a) if p >= 0 else (left, a), (right[:q], b) if q >= 0 else (right, b)
            old_tail = _ids(enc, tail[0]) if p >= 0 else a
            old_head = _ids(enc, head[0]) if q >= 0 else b
            # What is replaced must be what stands there; else the window grows.
            if np.array_equal(a[len(a) - len(old_tail) :], old_tail) and np.array_equal(b[: len(old_head)], old_head):
                return np.concatenate([a[: len(a) - len(old_tail)], _ids(enc, tail[0] + head[0]), b[len(old_head) :]])
        if window >= len(left) and window >= len(right):
            return _ids(enc, left + right)
        window *= 2


def _ids(enc, text: str) -> np.ndarray:
    return np.array(enc.encode_ordinary(text), dtype="<u4")


def encode_text(text: str, enc=None, leaf: int = LEAF) -> np.ndarray:
    """The ids of a whole text."""
    enc = enc or encoding()
    if len(text) <= max(leaf, 2):
        return _ids(enc, text)
    half = len(text) // 2
    left, right = text[:half], text[half:]
    return _join(enc, left, encode_text(left, enc, leaf), right, encode_text(right, enc, leaf))


def decode_ids(ids: np.ndarray, enc=None, leaf: int = LEAF) -> bytes:
    """The bytes of ids."""
    enc = enc or encoding()
    if len(ids) <= max(leaf, 2):
        return enc.decode_bytes(ids.tolist())
    half = len(ids) // 2
    return decode_ids(ids[:half], enc, leaf) + decode_ids(ids[half:], enc, leaf)


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, leaf: int = LEAF, keep: tuple[str, ...] = (), decoded: str | None = None
) -> DataFrame:
    """One row per row of docs: id_col, the columns in keep, n_tokens, ids (binary, little-endian unsigned 32-bit), and where a name
    is given for it, the bytes that the ids decode to.

    Null texts count as empty and have no ids. Repeated rows, ties and null ids stay as they are; other columns
    are left out unless kept. An empty table gives an empty one.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)])
    names = ["_id", *[f"_keep_{i}" for i in range(len(keep))], "n_tokens", "ids", *["_decoded"] * bool(decoded)]

    def run(batches):
        enc = encoding(vocabulary)
        for batch in batches:
            for at, count in slices(batch.column(1), TEXTS):
                part = batch.slice(at, count)
                ids = [encode_text(t, enc, leaf) for t in part.column(1).to_pylist()]
                back = [pa.array([decode_ids(x, enc, leaf) for x in ids], pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), *back], names=names)

    types = dict(docs.dtypes) | {"n_tokens": "long", "ids": "binary", "_decoded": "binary"}
    schema = ", ".join(f"{n} {types[n]}" for n in names)
    made = docs.mapInArrow(lean(run), schema)
    own = [F.col("_id").alias(id_col), *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "ids"]
    return made.select(*own, *([F.col("_decoded").alias(decoded)] if decoded else []))


def decode(encoded: DataFrame, ids_col: str = "ids", to: str = "decoded", vocabulary: str | None = None, leaf: int = LEAF) -> DataFrame:
    """encoded with a binary column `to` in place of its ids column: the bytes of the ids; null ids count as none."""
    rest = [c for c in encoded.columns if c != ids_col]
    encoded = encoded.select(F.coalesce(F.col(ids_col), F.lit(b"")).alias("_ids"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(rest)])

    def run(batches):
        enc = encoding(vocabulary)
        for batch in batches:
            for at, count in slices(batch.column(0), TEXTS):
                part = batch.slice(at, count)
                made = pa.array([decode_ids(np.frombuffer(x.as_buffer(), "<u4"), enc, leaf) for x in part.column(0)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], made], names=[*[f"_{i}" for i in range(len(rest))], "_made"])

    types = dict(encoded.dtypes)
    schema = ", ".join([*[f"_{i} {types[f'_{i}']}" for i in range(len(rest))], "_made binary"])
    return encoded.mapInArrow(lean(run), schema).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(rest)], F.col("_made").alias(to))
