"""Token counts of byte-pair models by heap-and-linked-list merging, without making any identifiers."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

SPACE = "▁"
#: Segments kept by a Python worker, and the longest that is kept.
CACHE, CACHE_LEN = 400_000, 48
_loaded: dict[str, PieceCounter] = {}


class PieceCounter:
    """Counts the pieces of a text under a sentencepiece BPE model with byte fallback and identity normalisation.

    A pair's rank is the place of its joined piece by falling score. No piece has a space mark after another
    character, so merges never cross from one word to the next and words are counted one by one (and remembered).
    """

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = [i for i in range(len(sp)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        scored = [(sp.id_to_piece(i), -sp.get_score(i)) for i in ids]
        self.rank = dict(scored)
        self.crossing = any(SPACE in p.lstrip(SPACE) for p in self.rank)
        if sp.encode("ﬁ  x", out_type=str)[:2] == ["▁", "f"]:
            raise ValueError("only models without text normalisation are supported")
        self.segments = re.compile(f"{SPACE}+[^{SPACE}]*").findall
        self.seen = _Seen(self.merge)

    def merge(self, text: str) -> int:
        """Initial symbols less merges; a symbol that is no piece counts one for each of its UTF-8 bytes."""
        rank = self.rank
        symbols = list(text)
        left, right = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        n = len(symbols)
        heap = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in rank:
                heap.append((rank[pair], i, pair, i + 1))
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, pair, j = heapq.heappop(heap)
            if symbols[i] is None or right[i] != j or symbols[j] is None or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            k = right[i] = right[j]
            count -= 1
            if k < n:
                left[k] = i
                pair = symbols[i] + symbols[k]
                if pair in rank:
                    heapq.heappush(heap, (rank[pair], i, pair, k))
            h = left[i]
            if h >= 0:
                pair = symbols[h] + symbols[i]
                if pair in rank:
                    heapq.heappush(heap, (rank[pair], h, pair, i))
        return count + sum(len(s.encode()) - 1 for s in symbols if s is not None and s not in rank)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        return self.merge(text) if self.crossing else sum(map(self.seen.__getitem__, self.segments(text)))


class _Seen(dict):
    """Counts by segment, forgotten when there are too many."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, segment: str) -> int:
        n = self.of(segment)
        if len(segment) <= CACHE_LEN:
            if len(self) >= CACHE:
                self.clear()
            self[segment] = n
        return n


def counter(model_path: str) -> PieceCounter:
    if model_path not in _loaded:
        _loaded[model_path] = PieceCounter(model_path)
    return _loaded[model_path]


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each whole text.

    A null or empty text has none; special strings inside a text are ordinary text; an empty table stays empty. Other
    columns pass through; one already named as `out` is replaced.
    """
    arrow_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(model_path).count
        for batch in texts:
            yield pd.Series([count(t) for t in batch], dtype="int64")

    return docs.withColumn(out, tokens(F.col(text)))
