"""Token counts of whole texts with a public tokenizer; huge documents by overlapping chunks that are resynchronised.

A huge document is encoded in chunks of CHUNK characters that overlap by OVERLAP, with offsets. Two chunks are spliced
at a common boundary: a place in the overlap where both start a token and where the boundary is proven (a blank after a
character that is no white space, where the splitting pattern always starts a new match whatever is further left
or right). Without one in the overlap, the left chunk is widened, the overlap doubled, until there is one
or the left chunk reaches the end.

Other documents are cut at every proven boundary. The same words come again and again, so the library encodes each
distinct stretch once for a worker (at most CACHE of them are remembered) and counts are summed. Texts that hold
the string of an added token, and vocabularies for which boundaries aren't proven, go through the library whole.
"""

from __future__ import annotations

import functools
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import lean, slices

VOCABULARY = "byte_bpe_50k.json"
CHUNK, OVERLAP, CACHE = 65_536, 512, 1_000_000
_RUN = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


class Counter:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap, self.most = chunk, min(overlap, max(chunk // 2, 1)), cache
        made = json.loads(self.tokenizer.to_str())
        split = made.get("pre_tokenizer") or {}
        #: Byte level with its own pattern, no prefix blank, nothing that changes the text first.
        self.proven = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and made.get("normalizer") is None
        self.added = [x["content"] for x in made.get("added_tokens", [])]
        self.seen: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def stretches(self, texts: list[str]) -> list[int]:
        """Counts of texts that are not huge."""
        # Stretches are remembered without the blank that they begin with; a text's first one is counted apart.
        if len(self.seen) > self.most:
            self.seen = {}
        cut, plain, strange = [], [], []
        for i, t in enumerate(texts):
            if not self.proven or any(x in t for x in self.added):
                strange.append(i)
                cut.append(())
            elif _RUN.search(t) or t[:1] == " ":
                first, *rest = _CUT.split(t)
                cut.append([x[1:] for x in rest])
                plain.append((i, first))
            elif t:
                first, *rest = t.split(" ")
                cut.append(rest)
                plain.append((i, first))
            else:
                cut.append(())
        new = list(set().union(*cut).difference(self.seen))
        if new:
            found = self.tokenizer.encode_batch_fast([" " + x for x in new], add_special_tokens=False)
            self.seen |= dict(zip(new, map(len, found), strict=True))
        counts = [sum(map(self.seen.__getitem__, c)) for c in cut]
        for (i, _), n in zip(plain, map(len, self.tokenizer.encode_batch_fast([first for _, first in plain], add_special_tokens=False)), strict=True):
            counts[i] += n
        for i in strange:
            counts[i] = self.whole(texts[i])
        return counts

    def huge(self, text: str) -> int:
        """The count of a text by chunks."""
        if not self.proven or len(text) <= self.chunk:
            return self.whole(text)
        start, valid, total = 0, 0, 0  # the chunk from start on counts from valid on
        end = min(len(text), self.chunk)
        left = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        first = 0  # its first token that counts
        while end < len(text):
            overlap, spliced = self.overlap, False
            while not spliced:
                begin = max(valid, end - overlap)
                stop = min(len(text), begin + max(self.chunk, 2 * overlap))
                right = self.tokenizer.encode(text[begin:stop], add_special_tokens=False)
                at = end
                while not spliced and (at := text.rfind(" ", begin + 1, at)) > begin:
                    if text[at - 1].isspace():
                        continue
                    i, j = left.char_to_token(at - start), right.char_to_token(at - begin)
                    if i is not None and j is not None and left.token_to_chars(i)[0] == at - start and right.token_to_chars(j)[0] == at - begin:
                        total += i - first
                        left, first, start, valid, end, spliced = right, j, begin, at, stop, True
                if not spliced:
                    overlap *= 2
                    end = min(len(text), end + overlap)
                    left = self.tokenizer.encode(text[start:end], add_special_tokens=False)
                    # Tokens before `valid` are the same in the wider chunk, so `first` holds.
                    if end == len(text):
                        break
        return total + len(left) - first


@functools.lru_cache(maxsize=4)
def counter(path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> Counter:
    import os

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Counter(path or public_tokenizers.path(VOCABULARY), chunk, overlap)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of docs: id_col, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens).

    Null texts count as empty: no bytes, no tokens. Repeated rows, ties and null ids stay as they are; other
    columns are left out. An empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.octet_length(text).cast("long").alias("n_bytes"))

    def run(batches):
        count = counter(vocabulary, chunk, overlap)
        for batch in batches:
            for at, rows in slices(batch.column(1)):
                part = batch.slice(at, rows)
                texts = part.column(1).to_pylist()
                small = [i for i, t in enumerate(texts) if len(t) <= chunk]
                n = [0] * len(texts)
                for i, x in zip(small, count.stretches([texts[i] for i in small]), strict=True):
                    n[i] = x
                for i, t in enumerate(texts):
                    if len(t) > chunk:
                        n[i] = count.huge(t)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64())], names=["_id", "n_bytes", "n_tokens"])

    made = docs.mapInArrow(lean(run), f"_id {dict(docs.dtypes)['_id']}, n_bytes long, n_tokens long")
    return made.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
