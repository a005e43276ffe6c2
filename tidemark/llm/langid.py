"""Language ID by unigrams over a fixed public vocabulary, with the segmentation summed out.

A word is a run of letters and their marks in any script, lower-cased, with a blank in front. Each language has a probability
for every piece of the vocabulary (tokens of a public byte-level vocabulary: lower case, at most 8 bytes, so that a piece is one number).
The probability of a word is the sum over all its segmentations into pieces of the product of their probabilities, by the
forward algorithm over the whole word, however long; probabilities are fitted by expectation maximisation (forward and backward
over the words of a sample). A text's score for a language is the sum over all words of the whole text, plus the language's prior.

Words repeat, so a worker runs the forward algorithm once for each distinct one it remembers, over all new words
of a batch together.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import _MASK, hash_words, holds, lean, raw, slices, word_bounds

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The sample: about so many rows a language (drawn by a hash of the id), its so many most frequent words of at most so many characters.
ROWS, WORDS, LONGEST = 600, 30_000, 100
PIECE = 8  # bytes of the longest piece, so that a piece is one 64-bit number
#: Cells of a lattice that are worked on at once; steps after which the forward sums are scaled anew.
CELLS, SCALED = 4_000_000, 16
ROUNDS = 6
CACHE = 400_000
SLICE = 1 << 20  # bytes of text worked on at once

_OUTSIDE = np.ones(256, dtype=bool)
_OUTSIDE[97:123] = False
_OUTSIDE[128:] = False


@functools.lru_cache(maxsize=4)
def pieces(path: str | None = None) -> np.ndarray:
    """The vocabulary as sorted little-endian numbers: all single bytes, and the lower-case pieces."""
    import public_tokenizers

    found = {bytes([b]) for b in range(1, 256)}
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        for line in file:
            if line.strip():
                token = base64.b64decode(line.split()[0])
                if 0 < len(token) <= PIECE and not _OUTSIDE[list(token.removeprefix(b" "))].any():
                    found.add(token)
    return np.array(sorted(int.from_bytes(t, "little") for t in found), dtype=np.uint64)


def held_out(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % 3) == 1


def letters(texts: pa.Array) -> pa.Array:
    """Texts lower-cased, with blanks for all that is neither a letter nor a mark; of bytes from 128 on none else is left."""
    texts = pc.utf8_lower(texts)
    strange = pc.invert(pc.string_is_ascii(texts))
    if pc.any(strange).as_py():
        texts = pc.if_else(strange, pc.replace_substring_regex(texts, r"[^\p{L}\p{M}]+", " "), texts)
    return texts


def _lattice(buf, starts, size, keys):
    """Piece numbers of all (start, length) in words of `size` bytes with a blank in front; len(keys) where there is none."""
    rows = np.empty((len(starts), size + 1 + PIECE), dtype=np.uint8)
    rows[:, 0] = 32
    rows[:, 1 : size + 1] = buf[starts[:, None] + np.arange(size)]
    rows[:, size + 1 :] = 0
    out = np.full((len(starts), size + 1, PIECE), len(keys), dtype=np.int32)
    for j in range(size + 1):
        packed = np.ascontiguousarray(rows[:, j : j + PIECE]).view("<u8")[:, 0]
        for n in range(1, min(PIECE, size + 1 - j) + 1):
            key = packed & _MASK[n]
            at = np.searchsorted(keys, key)
            at[at == len(keys)] = 0
            out[:, j, n - 1] = np.where(keys[at] == key, at, len(keys))
    return out


def _forward(lattice: np.ndarray, p: np.ndarray) -> np.ndarray:
    """alpha (words, places, languages) of short words. p has a last row of zeros for no piece."""
    words, size, _ = lattice.shape
    alpha = np.zeros((words, size + 1, p.shape[1]))
    alpha[:, 0] = 1
    for j in range(1, size + 1):
        for n in range(1, min(PIECE, j) + 1):
            alpha[:, j] += alpha[:, j - n] * p[lattice[:, j - n, n - 1]]
    return alpha


def score_words(buf, starts, ends, keys, p) -> np.ndarray:
    """Log probability of each word for each language: the sum over all its segmentations."""
    size = ends - starts
    out = np.zeros((len(starts), p.shape[1]))
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        # Words of nearly one length together; a shorter one is read off where it ends.
        most = int(size[order[at]] * 1.25) + 2
        stop = int(np.searchsorted(size[order], most, "right"))
        stop = min(stop, at + max(1, CELLS // ((most + 1) * PIECE)))
        part = order[at:stop]
        out[part] = _score(buf, starts[part], size[part], keys, p)
        at = stop
    return out


def _score(buf, starts, size, keys, p) -> np.ndarray:
    """Log probabilities of words sorted by size. Sums of the last PIECE places are kept, scaled anew every SCALED steps."""
    most, words = int(size[-1]), len(starts)
    need = int(starts.max()) + most + 1
    if need > len(buf):
        buf = np.concatenate([buf, np.zeros(need - len(buf), np.uint8)])
    lattice = _lattice(buf, starts, most, keys)
    out, scale = np.zeros((words, p.shape[1])), np.zeros((words, p.shape[1]))
    ring = np.zeros((PIECE, words, p.shape[1]))
    ring[0] = 1
    # A word of `size` bytes with its blank ends at place size + 1; the words before `done` have ended.
    done = 0
    for j in range(1, most + 2):
        total = np.zeros((words - done, p.shape[1]))
        for n in range(1, min(PIECE, j) + 1):
            total += ring[(j - n) % PIECE, done:] * p[lattice[done:, j - n, n - 1]]
        ring[j % PIECE, done:] = total
        if j % SCALED == 0:
            scale[done:] += np.log(total)
            ring[:, done:] /= total
        end = int(np.searchsorted(size, j - 1, "right"))
        if end > done:
            out[done:end] = np.log(ring[j % PIECE, done:end]) + scale[done:end]
            done = end
    return out


def fit(words: list[tuple[str, str, int]], keys: np.ndarray, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages, and piece probabilities (pieces + 1, languages), from rows (language, word, count)."""
    languages = sorted({x for x, _, _ in words})
    p = np.zeros((len(keys) + 1, len(languages)))
    total = np.zeros(len(keys) + 1)
    counts = []
    own: dict[str, list] = {x: [] for x in languages}
    for x, w, n in words:
        own[x].append((w, n))
    for language in languages:
        buf, offsets = raw(pa.array([w for w, _ in own[language]]))
        a, b = offsets[:-1], offsets[1:]
        weight = np.array([n for _, n in own[language]], dtype=np.float64)
        groups = []
        for n in np.unique(b - a):
            at = np.flatnonzero(b - a == n)
            step = max(1, CELLS // ((int(n) + 1) * PIECE))
            groups += [(_lattice(buf, a[at[i : i + step]], int(n), keys), weight[at[i : i + step]]) for i in range(0, len(at), step)] if n else []
        q = np.full(len(keys) + 1, 1 / len(keys))
        q[-1] = 0
        for _ in range(rounds):
            c = np.zeros(len(keys) + 1)
            for lattice, w in groups:
                _expect(lattice, q, w, c)
            c[-1] = 0
            q = (c + 0.01) / (c.sum() + 0.01 * len(keys))
            q[-1] = 0
        counts.append(c)
        total += c
    spread = (total + 0.1) / (total.sum() + 0.1 * len(keys))
    for i, c in enumerate(counts):
        p[:, i] = (c + 20 * spread) / (c.sum() + 20)
    p[-1] = 0
    return languages, p


def _expect(lattice: np.ndarray, q: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> None:
    """Adds the expected number of each piece in words of one length, weighted.

    Each place's sums are divided by their own scale, forward and backward by the same, so that no word is too long.
    """
    words, size, _ = lattice.shape
    alpha, beta, scale = np.zeros((size + 1, words)), np.zeros((size + 1, words)), np.ones((size + 1, words))
    alpha[0] = 1
    for j in range(1, size + 1):
        # The product of the scales between the two places of a piece.
        between = np.ones(words)
        for n in range(1, min(PIECE, j) + 1):
            alpha[j] += alpha[j - n] * q[lattice[:, j - n, n - 1]] / between
            between = between * scale[j - n]
        scale[j] = alpha[j]
        alpha[j] = 1
    beta[size] = 1
    for j in range(size - 1, -1, -1):
        between = np.ones(words)
        for n in range(1, min(PIECE, size - j) + 1):
            between = between * scale[j + n]
            x = lattice[:, j, n - 1]
            step = q[x] * beta[j + n] / between
            beta[j] += step
            counts += np.bincount(x, weights=weight * alpha[j] * step, minlength=len(counts))


def sample_words(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = ROWS, most: int = WORDS) -> tuple[list[tuple[str, str, int]], dict[str, int]]:
    """(language, word, count) of the sample, and how many rows each language has in all. ROWS, WORDS and LONGEST bound it for each language."""
    usable = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = usable.groupBy("lang").count()
    size = {r[0]: r[1] for r in sizes.collect()}  # a row a language
    if not size:
        return [], {}
    part = F.map_from_arrays(F.array(*[F.lit(x) for x in size]), F.array(*[F.lit(min(1.0, rows / n)) for n in size.values()]))
    drawn = usable.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < F.element_at(part, F.col("lang")) * (1 << 30))
    word = F.explode(F.split(F.lower("text"), r"[^\p{L}\p{M}]+")).alias("word")
    counted = drawn.select("lang", word).where(f"word <> '' and length(word) <= {LONGEST}").groupBy("lang", "word").count()
    top = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    found = counted.withColumn("_n", top).where(F.col("_n") <= most).collect()  # at most `most` rows a language
    found = sorted((r["lang"], r["word"], r["count"]) for r in found)
    return found, size


_seen: dict[bytes, list] = {}
holds(__name__, _seen.clear)


def _lookup(buf, starts, ends, keys, p, mark: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the batch's distinct words, and the number of each word among them."""
    h = hash_words(buf, starts, ends)
    distinct, first, number = np.unique(h, return_index=True, return_inverse=True)
    if mark not in _seen:
        _seen.clear()
        _seen[mark] = [np.zeros(0, np.uint64), np.zeros((0, p.shape[1]))]
    known, scores = _seen[mark]
    at = np.searchsorted(known, distinct)
    at[at == len(known)] = 0
    old = known[at] == distinct if len(known) else np.zeros(len(distinct), bool)
    out = np.empty((len(distinct), p.shape[1]))
    out[old] = scores[at[old]]
    new = np.flatnonzero(~old)
    out[new] = score_words(buf, starts[first[new]], ends[first[new]], keys, p)
    if len(known) + len(new) > CACHE:
        known, scores = np.zeros(0, np.uint64), scores[:0]
    merged = np.concatenate([known, distinct[new]])
    order = np.argsort(merged, kind="stable")
    _seen[mark] = [merged[order], np.concatenate([scores, out[new]])[order]]
    return out, number


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of the columns in keep (by default id_col), lang_pred and score of docs, by a model from train()."""
    languages, p, prior = model
    keep = (id_col,) if keep is None else keep
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(letter.alias("_letter"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])
    types = dict(rows.dtypes)
    own = [F.col(f"_{i}").alias(c) for i, c in enumerate(keep)]

    if not languages:
        return rows.select(*own, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    mark = hashlib.sha256(repr(languages).encode() + p.tobytes()).digest()

    def run(batches):
        keys, names = pieces(), np.array([*languages, "und"])
        for batch in batches:
            for at, count in slices(batch.column(1), SLICE):
                part = batch.slice(at, count)
                buf, offsets = raw(letters(part.column(1)), fold=False)
                starts, ends, before = word_bounds(buf, offsets, _OUTSIDE)
                total = np.tile(prior, (count, 1))
                if len(starts):
                    scores, number = _lookup(buf, starts, ends, keys, p, mark)
                    doc = np.repeat(np.arange(count), np.diff(before))
                    for i in range(len(languages)):
                        total[:, i] += np.bincount(doc, weights=scores[number, i], minlength=count)
                best = total.argmax(axis=1)
                sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                lettered = part.column(0).to_numpy(zero_copy_only=False).astype(bool)
                best, sure = np.where(lettered, best, len(languages)), np.where(lettered, sure, 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(names[best].tolist(), pa.string()), pa.array(sure, pa.float64())], names=[*[f"_{i}" for i in range(len(keep))], "lang_pred", "score"])

    schema = ", ".join([*[f"_{i} {types[f'_{i}']}" for i in range(len(keep))], "lang_pred string", "score double"])
    return rows.mapInArrow(lean(run), schema).select(*own, "lang_pred", "score")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS, most: int = WORDS):
    """A model from labelled rows; without any, one that predicts und only."""
    words, size = sample_words(docs, id_col, text_col, lang_col, rows, most)
    if not words:
        return [], np.zeros((0, 0)), np.zeros(0)
    languages, p = fit(words, pieces())
    prior = np.log(np.array([size[x] for x in languages], dtype=np.float64) / sum(size.values()))
    return languages, p, prior


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: id_col, held_out, lang_pred, score.

    Learns from text and non-null language of rows that are not held out. lang_pred is a learned value, und
    where the text is null or has no letter or nothing could be learned; score is the posterior probability, 0 for und.
    Equal scores go to the first language by name. Every language with a row to learn from can be predicted. Texts of any length are
    scored whole. Repeated rows and null ids (held_out null) are scored like others; other columns
    are left out, whatever their names. An empty table gives an empty one.
    """
    model = train(docs.where(~held_out(F.col(id_col))), id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col).withColumn("held_out", held_out(F.col(id_col)))
