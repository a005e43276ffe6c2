"""Benchmark decontamination: test items found in whole documents within an edit distance, by pigeonhole and Myers.

An item of m characters may differ in k = m // 16 edits. It is cut into k + 1 pieces, of which an occurrence
within k edits must hold one unchanged, so exact hits of pieces (one automaton for all pieces) give all places
to look at; each place is verified by Myers' bit-parallel distance of the whole item against the text around it.
Texts and items are compared lower-cased, with runs of white space as one blank.

The items are read in blocks of at most about BLOCK characters, dealt by a hash of the item's text; each
block's pieces go to all tasks. So what is sent to a task has a bound, and documents are never shuffled.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import holds, lean, slices

EDIT_SHARE = 16  # one edit for so many characters
BLOCK = 2_000_000


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, share: int = EDIT_SHARE) -> int:
    return len(item) // share


def pieces(item: str, share: int = EDIT_SHARE) -> list[tuple[int, str]]:
    """Budget plus one pieces (offset, text) of about equal length."""
    n = budget(item, share) + 1
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, text: str) -> tuple[int, int]:
    """The least edit distance of item to any stretch of text, and where the first such stretch ends."""
    m = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & mask), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        pv, mv = mh | (~(xv | ph) & mask), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


@functools.lru_cache(maxsize=4)
def _automaton(items: tuple[str, ...], share: int):
    import ahocorasick

    where: dict[str, list[tuple[int, int]]] = {}
    for i, item in enumerate(items):
        for at, piece in pieces(item, share):
            where.setdefault(piece, []).append((i, at))
    machine = ahocorasick.Automaton()
    for piece, at in where.items():
        machine.add_word(piece, (len(piece), at))
    machine.make_automaton()
    return machine


holds(__name__, _automaton.cache_clear)


def search(text: str, items: tuple[str, ...], share: int = EDIT_SHARE) -> list[tuple[int, int, int]]:
    """(item number, distance, end in the normalised text) of the best occurrence of each item within its budget."""
    places: dict[int, list[int]] = {}
    for last, (size, at) in _automaton(items, share).iter(text):
        for i, offset in at:
            places.setdefault(i, []).append(last + 1 - size - offset)
    found = []
    for i, starts in places.items():
        item, k = items[i], budget(items[i], share)
        best, windows = None, []
        for s in sorted(set(starts)):
            a, b = max(0, s - k), min(len(text), s + len(item) + k)
            if windows and a <= windows[-1][1]:
                windows[-1][1] = max(b, windows[-1][1])
            else:
                windows.append([a, b])
        for a, b in windows:
            distance, end = myers(item, text[a:b])
            if distance <= k and (best is None or distance < best[0]):
                best = distance, a + end
        if best:
            found.append((i, *best))
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: int = EDIT_SHARE, block: int = BLOCK) -> DataFrame:
    """A row (id_col, item_col, distance, item_chars, ends_at) for each row of docs and each item found in it: the occurrence of least
    distance, the first of such.

    Null and empty texts and items match nothing. Repeated rows of either side give a row each. ends_at counts in the normalised
    text. Other columns are left out. Empty tables give an empty one.
    """
    spark = docs.sparkSession
    key = f"{item_col} {dict(benchmark.dtypes)[item_col]}"
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    items = benchmark.select(F.col(item_col).alias("_item"), F.col(item_text).alias("_text")).where("_text is not null and _text rlike '[^ \\t\\n\\r\\f]'")
    total = items.agg(F.sum(F.length("_text"))).first()[0] or 0
    blocks = int(total // block) + 1
    schema = f"_id {dict(rows.dtypes)['_id']}, {key}, distance long, item_chars long, ends_at long"
    out = None
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("_text"), F.lit(blocks)) == b).orderBy("_item", "_text").collect()
        names, texts = [r["_item"] for r in mine], tuple(normalise(r["_text"]) for r in mine)
        names, texts = [n for n, t in zip(names, texts, strict=True) if t], tuple(t for t in texts if t)
        if not texts:
            continue

        def run(batches, names=names, texts=texts):
            wanted = pa.schema([("item", pa.array(names).type)])
            for batch in batches:
                for at, count in slices(batch.column(1)):
                    part = batch.slice(at, count)
                    row, hits = [], []
                    for n, t in enumerate(part.column(1).to_pylist()):
                        for hit in search(normalise(t), texts, share):
                            row.append(n)
                            hits.append(hit)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(row, pa.int64())), pa.array([names[h[0]] for h in hits], wanted.field(0).type), *[pa.array(x, pa.int64()) for x in ([h[1] for h in hits], [len(texts[h[0]]) for h in hits], [h[2] for h in hits])]],
                        names=["_id", item_col, "distance", "item_chars", "ends_at"],
                    )

        found = rows.mapInArrow(lean(run), schema)
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnRenamed("_id", id_col)
