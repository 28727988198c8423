"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 8)."""

from __future__ import annotations

import base64
import heapq
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from rankloom.llm.common import spread

TOKENIZERS = "/opt/tokenizers"

# Fixed value: the published split pattern of the byte-level vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same for texts of ASCII characters alone, for the faster standard module.
SPLIT_ASCII = SPLIT.replace(r"\s\p{L}\p{N}", r"\sA-Za-z0-9").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")


class ByteBpe:
    """Byte-pair encoding of many words at once by a pair occurrence index."""

    def __init__(self, path: str, keep: int = 400_000) -> None:
        lines = (x.split() for x in Path(path).read_bytes().splitlines() if x)
        self.rank = {base64.b64decode(a): int(b) for a, b in lines}
        self.token = {i: b for b, i in self.rank.items()}
        self.byte = [self.rank[bytes([i])] for i in range(256)]
        self.pair: dict[tuple[int, int], int] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.keep = keep
        self.any, self.ascii = regex.compile(SPLIT), re.compile(SPLIT_ASCII, re.ASCII)

    def _rank(self, a: int, b: int) -> int:
        """The id that the pair merges to, -1 if it doesn't."""
        r = self.pair.get((a, b))
        if r is None:
            r = self.pair[a, b] = self.rank.get(self.token[a] + self.token[b], -1)
        return r

    def learn(self, words: Iterable[str]) -> None:
        """Encode words not seen before, all together.

        The words lie end to end in one array of symbols. For each mergeable pair, under its rank, the index holds the
        positions where it occurs. The active ranks are taken in ascending order; all occurrences of one are merged from
        left to right, and the pairs that a merge ends or makes are taken out of their lists (by a check when their turn
        comes) or put in."""
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        if not new:
            return
        coded = [w.encode() for w in new]
        ends = np.cumsum([len(b) for b in coded]).tolist()
        sym = [self.byte[x] for x in b"".join(coded)]
        n = len(sym)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        for e in ends:
            right[e - 1] = -1
            if e < n:
                left[e] = -1
        at: dict[int, list[int]] = defaultdict(list)
        rank = self._rank
        for i, j in enumerate(right):
            if j >= 0 and (r := rank(sym[i], sym[j])) >= 0:
                at[r].append(i)
        active = list(at)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            places = at.pop(r, None)
            if places is None:
                continue
            places.sort()
            for i in places:
                j = right[i]
                if j < 0 or sym[i] < 0 or rank(sym[i], sym[j]) != r:
                    continue  # a merge before this one took one of the two
                sym[i], sym[j] = r, -1
                k = right[i] = right[j]
                right[j] = -1
                if k >= 0:
                    left[k] = i
                    if (x := rank(r, sym[k])) >= 0:
                        if x not in at:
                            heapq.heappush(active, x)
                        at[x].append(i)
                if (h := left[i]) >= 0 and (x := rank(sym[h], r)) >= 0:
                    if x not in at:
                        heapq.heappush(active, x)
                    at[x].append(h)
        start = 0
        for w, e in zip(new, ends):
            self.words[w] = tuple(s for s in sym[start:e] if s >= 0)
            start = e

    def split(self, text: str) -> list[str]:
        return (self.ascii if text.isascii() else self.any).findall(text)

    def encode_batch(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """The ids of each text; null and empty texts give an empty list."""
        pieces = [self.split(x) if x else [] for x in texts]
        if len(self.words) > self.keep:
            self.words.clear()
        self.learn(chain.from_iterable(pieces))
        get = self.words.__getitem__
        for p in pieces:
            yield list(chain.from_iterable(map(get, p)))

    def count_batch(self, texts: Iterable[str | None]) -> Iterator[int]:
        """The number of ids of each text."""
        for x in self.encode_batch(texts):
            yield len(x)


_loaded: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    """One for each Python worker, with its words."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


_sent: set[tuple[str, str]] = set()


def _send(spark: SparkSession, path: str) -> str:
    """Send the rank file to all executors, once a session; gives the name that they know it by."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _sent:
        spark.sparkContext.addFile(path)
        _sent.add(key)
    return Path(path).name


def _batches(pdf: pd.DataFrame, chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Parts of at most so many characters, or of one text, so that very long texts don't pile up."""
    size = pdf.iloc[:, 1].str.len().fillna(0).cumsum().to_numpy()
    part = (size // chars).astype("int64") if len(size) else size
    for p in np.unique(part):
        yield pdf[part == p]


def _mapped(df: DataFrame, id_col: str, text_col: str, schema: str, make: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for part in _batches(pdf):
                yield make(part)

    return spread(df.select(id_col, text_col)).mapInPandas(run, schema)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, ids): the token ids of every text without special tokens; strings that look like special tokens are text.

    Null and empty texts give an empty list. One row for each row of the input, repeated rows and null ids too; other
    columns are ignored. No shuffle: each partition encodes its distinct words once. `path` names the rank file where the
    driver sees it; it is sent to the executors."""
    kind, name = df.schema[id_col].dataType.simpleString(), _send(df.sparkSession, path)

    def make(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({id_col: p[id_col], "ids": [np.array(x, "int32") for x in tokenizer(SparkFiles.get(name)).encode_batch(p[text_col])]})

    return _mapped(df, id_col, text_col, f"`{id_col}` {kind}, ids array<int>", make)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, n_tokens): as encode(), but only the number of ids."""
    kind, name = df.schema[id_col].dataType.simpleString(), _send(df.sparkSession, path)

    def make(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({id_col: p[id_col], "n_tokens": np.fromiter(tokenizer(SparkFiles.get(name)).count_batch(p[text_col]), "int64", len(p))})

    return _mapped(df, id_col, text_col, f"`{id_col}` {kind}, n_tokens bigint", make)
