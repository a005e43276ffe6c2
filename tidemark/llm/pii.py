"""Personal data in whole texts: exact patterns, extended by a skip-chain conditional random field.

Nodes are the tokens that personal data could be: what the patterns found (labels given), strings that look like such data but
fail a pattern (an address without a domain ending, a number without its plus or with parts left out), and other numbers of
some length. Neighbouring nodes share a transition potential; nodes that repeat or resemble each other (same digits at the
end, same local part), however far apart, share a skip potential; a node's own potential sees its shape and the word
before it. Loopy sum-product passing makes labels consistent across the document. All weights are fitted together by pseudo-likelihood on a
sample of documents (at most about SAMPLE, drawn by a hash): there the patterns' findings are labels, each once as it stands and once
damaged (its ending, plus or last part left out), beside its original or alone, and once rewritten beside its original; what fails the patterns is no data. What
reaches the driver are counts of feature combinations.

The patterns' spans always stay; the field only adds spans.
"""

from __future__ import annotations

import ast
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SAMPLE = 4000
ROUNDS = 8
#: Buckets that the word before a node is hashed to, and the square penalty of the weights.
CUES, PENALTY = 48, 2e-4

# Matches begin at the first digit of a run, so that a long run is looked at once.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}(?![0-9A-Za-z])")
_HANDLE = re.compile(r"@[A-Za-z0-9-]+")
_DIGITS = re.compile(r"(?<![0-9A-Za-z])[0-9][0-9().-]+[0-9](?![0-9A-Za-z])")
_BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]*$")
_SHAPE = 14


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _before(text: str, at: int, floor: int) -> int:
    """Start of the run of local-part characters that ends at `at`, not before `floor`."""
    while at > floor and text[at - 1] in _LOCAL:
        at -= 1
    return at


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans by kind, then start: leftmost, not overlapping within a kind; matches that fail a test are dropped."""
    out, end = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = _before(text, m.start(), end)
            if start < m.start():
                end = m.end()
                out.append(("email", start, end))
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int, tuple, str]]:
    """A document's nodes by start: (start, end, label or -1, features, what links it to similar ones)."""
    nodes = [(s, e, LABELS.index(k)) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    reach = np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []

    def free(s: int, e: int) -> bool:
        import bisect

        i = bisect.bisect_left(starts, e)
        return i == 0 or reach[i - 1] <= s

    last = 0
    if "@" in text:
        for m in _HANDLE.finditer(text):
            s = _before(text, m.start(), last)
            if s < m.start() and free(s, m.end()):
                nodes.append((s, m.end(), -1))
                last = m.end()
    numbers = [(*m.span(), -1) for m in _NUMBER.finditer(text) if free(*m.span())]
    nodes += numbers
    if nodes:
        held = iter(sorted(numbers))
        last = next(held, None)
        for m in _DIGITS.finditer(text):
            while last and last[1] <= m.start():
                last = next(held, None)
            if free(*m.span()) and not (last and last[0] < m.end()) and len(_digits(m.group())) > 3:
                nodes.append((*m.span(), -1))
    nodes.sort()
    found = []
    for s, e, label in nodes:
        found.append((s, e, label, _features(text[s:e], text[max(0, s - 24) : s]), _key(text[s:e])))
    return found


def _key(t: str) -> str:
    """What nodes that resemble each other share."""
    return "@" + t.split("@")[0].lower() if "@" in t else "#" + _digits(t)[-7:]


def _features(t: str, before: str) -> tuple:
    d, at = _digits(t), "@" in t
    cue = _BEFORE.search(before)
    shape = (at, "+" in t, min(len(d), 20) // 4, t.count("."), "(" in t, "-" in t or " " in t, not at and 13 <= len(d) <= 19 and luhn(d))
    return (*shape[:3], min(shape[3], 3), *shape[4:], zlib.crc32(cue[1].lower().encode()) % CUES + 1 if cue else 0)


def _featured(features: tuple) -> np.ndarray:
    """Indicator vector of one node's features."""
    at, plus, size, dots, paren, gap, check, cue = features
    x = np.zeros(_SHAPE + CUES + 1)
    x[0] = 1
    x[1 + size] = 1
    x[7:_SHAPE] = at, plus, dots == 3, dots == 2, paren, gap, check
    x[_SHAPE + cue] = 1
    return x


def damaged(kind: str, t: str) -> str:
    """A mention as it may stand where its pattern doesn't find it."""
    if kind == "email":
        return t.rsplit(".", 1)[0] if t.split("@")[1].count(".") == 1 else t.split("@")[0] + "@" + t.split("@")[1].split(".")[0]
    return t[1:] if kind == "phone" else t.rsplit(".", 1)[0] if kind == "ip" else t[:-1]


def rewritten(kind: str, t: str) -> str:
    """A mention as it may be repeated: a number without what leads it, in other groups."""
    d = _digits(t)
    if kind == "email":
        return damaged(kind, t)
    return "-".join(x for x in (d[-10:-7], d[-7:-4], d[-4:]) if x)


def fit(rows: dict, steps: int = 300) -> dict:
    """Weights from counts of (features, label before, label behind, labels of similar nodes, label): the gradient of the pseudo-likelihood."""
    size = len(LABELS)
    rows = {k: n for k, n in rows.items() if n}
    x = np.array([_featured(k[0]) for k in rows]).reshape(len(rows), _SHAPE + CUES + 1)
    ends = np.array([(k[1], k[2]) for k in rows], dtype=int).reshape(-1, 2)  # size stands for none there
    twins = np.array([[min(k[3].count(j), 1) for j in range(size)] for k in rows], dtype=float).reshape(-1, size)
    y, n = np.array([k[4] for k in rows], dtype=int), np.array(list(rows.values()), dtype=float)
    w, chain, skip = np.zeros((_SHAPE + CUES + 1, size)), np.zeros((size + 1, size + 1)), 0.0
    w[0, 0] = 1.0  # without a sample: none
    share = n / n.sum() if len(n) else n
    seen = [np.full_like(w, 1e-8), np.full_like(chain, 1e-8), 1e-8]
    for _ in range(steps if len(n) else 0):
        z = x @ w + chain[ends[:, 0], :size] + chain[:size, ends[:, 1]].T + skip * twins
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= share[:, None]
        steep, links = np.zeros_like(chain), float((p * twins).sum()) + PENALTY * skip
        np.add.at(steep, (ends[:, 0][:, None], np.arange(size)[None, :]), p)
        np.add.at(steep, (np.arange(size)[None, :], ends[:, 1][:, None]), p)
        own, steep = x.T @ p + PENALTY * w, steep + PENALTY * chain
        seen = [seen[0] + own**2, seen[1] + steep**2, seen[2] + links**2]
        w -= 0.3 * own / np.sqrt(seen[0])
        chain -= 0.3 * steep / np.sqrt(seen[1])
        skip -= 0.3 * links / math.sqrt(seen[2])
    return {"unary": w, "chain": chain[:size, :size], "first": chain[size, :size], "last": chain[:size, size], "skip": float(skip)}


def infer(nodes: list, model: dict, rounds: int = ROUNDS) -> np.ndarray:
    """Marginals (nodes, labels) by loopy sum-product. Nodes with a given label stay there."""
    size = len(LABELS)
    unary = np.array([_featured(f) for *_, f, _ in nodes]) @ model["unary"]
    unary[0] += model["first"]
    unary[-1] += model["last"]
    for i, (_, _, label, *_) in enumerate(nodes):
        if label >= 0:
            unary[i] = -50
            unary[i, label] = 0
    same = model["skip"] * np.eye(size)
    edges = [(i, i + 1, model["chain"]) for i in range(len(nodes) - 1)]
    groups = defaultdict(list)
    for i, node in enumerate(nodes):
        groups[node[4]].append(i)
    for at in groups.values():
        # Similar nodes in a ring by place: as many edges as nodes, and messages reach all of them;
        # each open one is also tied to the group's first given one.
        given = next((i for i in at if nodes[i][2] >= 0), None)
        pairs = {(a, b) for a, b in zip(at, at[1:], strict=False)}
        pairs |= {(min(i, given), max(i, given)) for i in at if given is not None and i != given and nodes[i][2] < 0}
        edges += [(a, b, same) for a, b in sorted(pairs)]
    if not edges:
        z = np.exp(unary - unary.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)
    a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
    pot = np.array([e[2] for e in edges])
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    table = np.concatenate([pot, pot.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    msg = np.zeros((len(src), size))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        out = (belief[src] - msg[back])[:, :, None] + table
        top = out.max(axis=1)
        new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        msg = 0.5 * msg + 0.5 * new
    belief = unary.copy()
    np.add.at(belief, dst, msg)
    z = np.exp(belief - belief.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def all_spans(text: str, base: list, model: dict) -> list[tuple[str, int, int]]:
    """The patterns' spans and those that the field adds, by kind and start."""
    nodes = mentions(text, base)
    if any(n[2] < 0 for n in nodes):
        best = infer(nodes, model).argmax(axis=1)
        base = base + [(LABELS[k], s, e) for (s, e, label, *_), k in zip(nodes, best.tolist(), strict=True) if label < 0 and k]
    return sorted(base, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _counts(texts) -> Counter:
    """(features, label before, label behind, labels of similar nodes, label) of the nodes of texts; similar open nodes of a given one are left out, since nobody knows."""
    rows, size = Counter(), len(LABELS)
    for t in texts:
        found = mentions(t, base_spans(t))
        given = defaultdict(list)
        for n in found:
            if n[2] >= 0:
                given[n[4]].append(n[2])
        labels = [size, *(max(n[2], 0) for n in found), size]
        for i, (s, e, label, features, key) in enumerate(found):
            ends = labels[i], labels[i + 2]
            if label < 0:
                if key not in given:
                    rows[features, *ends, (), 0] += 1
                continue
            others = tuple(sorted(given[key][:]))
            rows[features, *ends, tuple(x for k, x in enumerate(others) if k), label] += 1
            broken = _features(damaged(LABELS[label], t[s:e]), t[max(0, s - 24) : s])
            rows[broken, *ends, (), label] += 1
            rows[broken, *ends, (label,), label] += 1
            rows[_features(rewritten(LABELS[label], t[s:e]), t[max(0, s - 24) : s]), *ends, (label,), label] += 1
    return rows


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """A model from at most about `sample` rows that hold a digit or an @."""
    n = docs.count()
    part = min(1.0, sample / max(n, 1))
    drawn = docs.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("pii")), F.lit(1 << 30)) < int(part * (1 << 30))).select(F.col(text_col).alias("_text"))

    def run(batches):
        total = Counter()
        for batch in batches:
            total.update(_counts([t for t in batch.column(0).to_pylist() if t]))
        yield pa.RecordBatch.from_arrays([pa.array([repr(k) for k in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["k", "n"])

    got = drawn.mapInArrow(run, "k string, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return fit({ast.literal_eval(r["k"]): r["n"] for r in sorted(got, key=lambda r: r["k"])})


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: dict | None = None) -> DataFrame:
    """One row per row of docs: id_col, base and spans, arrays of (kind, start, end) by kind and start, in code points.

    Null and empty texts have no spans; texts of any length are read whole. Repeated rows, ties and null ids stay as they are; other
    columns are left out, whatever their names. An empty table gives an empty one.
    """
    model = model or train(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches):
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        row = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
        for batch in batches:
            for at, count in slices(batch.column(1)):
                part = batch.slice(at, count)
                base, every = [], []
                for t in part.column(1).to_pylist():
                    found = base_spans(t)
                    base.append(row(found))
                    every.append(row(all_spans(t, found, model)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, span), pa.array(every, span)], names=["_id", "base", "spans"])

    spans = "array<struct<kind: string, start: long, end: long>>"
    return rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, base {spans}, spans {spans}").withColumnRenamed("_id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id", counted: str = "spans") -> DataFrame:
    """find()'s rows as counts (of all spans, or of those in the column `counted`), a hash of the base spans, and all spans as one string."""
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter(counted, lambda x: x.kind == kind)).cast("long")
    return found.select(id_col, *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
