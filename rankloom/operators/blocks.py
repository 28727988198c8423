"""A batch of queries against blocks of documents: what a task does with the tokens of its documents and all queries.

A document's tokens lie in one row, so whether it matches and how it scores is settled where it is read: no (query,
document) row is shuffled. Queries of the same tree and words are answered once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rankloom.functions.scoring import K1, TITLE_WEIGHT, B
from rankloom.plans.query_language import Leaf, Node

TOKENS = 4_000_000  # tokens of a block, about
ROWS = 500_000  # rows given out together, about
PARTS = ("bm25_score", "bm25_score_body", "bm25_score_title")


@dataclass
class Asked:
    """What is sent to the tasks. A kind is a tree with its words, as places in terms (-1: in no document)."""

    terms: list[str]
    idf: np.ndarray
    average: tuple[float, float]  # of title and body lengths
    trees: list[tuple[Node | None, list[int]]] = field(default_factory=list)  # none: every document; words of each leaf
    words: list[np.ndarray] = field(default_factory=list)  # of each tree: a row a kind
    ptr: list[np.ndarray] = field(default_factory=list)  # and where each kind's queries begin in qids
    qids: list[np.ndarray] = field(default_factory=list)

    def add(self, tree: Node | None, sizes: list[int], words: np.ndarray, qids: np.ndarray) -> None:
        """words: a row a query, of which equal ones become one kind."""
        order = np.lexsort((qids, *words.T[::-1]))
        w = words[order]
        new = np.concatenate([[True], (w[1:] != w[:-1]).any(axis=1)])
        self.trees.append((tree, sizes))
        self.words.append(w[new])
        self.ptr.append(np.append(np.flatnonzero(new), len(w)))
        self.qids.append(qids[order])

    def kinds(self) -> Iterator[tuple[int, Node | None, list[list[int]], np.ndarray]]:
        """Number, tree, words of each leaf, queries."""
        n = 0
        for (tree, sizes), words, ptr, qids in zip(self.trees, self.words, self.ptr, self.qids):
            ends = np.cumsum([0, *sizes]).tolist()
            for i, w in enumerate(words):
                w = w.tolist()
                yield n, tree, [w[x:y] for x, y in zip(ends, ends[1:])], qids[ptr[i] : ptr[i + 1]]
                n += 1


class Block:
    """The asked words' occurrences in some documents: rows and places sorted by term."""

    def __init__(self, asked: Asked, docs: list[np.ndarray], lengths: list[np.ndarray], found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """lengths: (n, 2), of title and body. found: terms, and places counted over title and body of all documents in
        turn with a gap after each, so that words of different fields never stand side by side."""
        self.docs, self.length = np.concatenate(docs), np.concatenate(lengths)
        n, starts = len(self.docs), np.concatenate([[0], np.cumsum(self.length.ravel() + 1)])
        term, at = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(term, kind="stable")
        self.at, term = at[order], term[order]
        part = np.searchsorted(starts, self.at, "right") - 1
        self.row_at, pos, body = part // 2, self.at - starts[part], part % 2
        self.at_ptr = np.searchsorted(term, np.arange(len(asked.terms) + 1))
        self.key, first = np.unique(term * n + self.row_at, return_index=True)
        self.row, self.ptr, self.n = self.key % max(n, 1), np.searchsorted(self.key, np.arange(len(asked.terms) + 1) * n), n
        if len(first):
            tf_body = np.add.reduceat(body, first)
            tf_title = np.diff(np.append(first, len(body))) - tf_body
        else:
            tf_body = tf_title = first
        end = np.minimum(first + tf_title, max(len(pos) - 1, 0))
        long = self.length[self.row]
        self.first_title = np.where(tf_title > 0, pos[first] / np.maximum(long[:, 0], 1), 1.0)
        self.first_body = np.where(tf_body > 0, pos[end] / np.maximum(long[:, 1], 1), 1.0)
        weight = lambda tf, i: tf / (1 - B + B * (long[:, i] / asked.average[i])) if asked.average[i] > 0 else np.zeros(len(tf))
        body_w, title_w, idf = weight(tf_body, 1), weight(tf_title, 0), asked.idf[self.key // max(n, 1)]
        self.part = [idf * (w * (K1 + 1)) / (w + K1) for w in (body_w + TITLE_WEIGHT * title_w, body_w, title_w)]
        self._phrases: dict[tuple[int, ...], np.ndarray] = {}

    def rows(self, words: list[int]) -> np.ndarray:
        """Of the documents that hold the word, or the words side by side."""
        if min(words) < 0:
            return self.row[:0]
        if len(words) == 1:
            return self.row[self.ptr[words[0]] : self.ptr[words[0] + 1]]
        if (key := tuple(words)) not in self._phrases:
            places = [self.at[self.at_ptr[w] : self.at_ptr[w + 1]] - i for i, w in enumerate(words)]
            both = min(places, key=len)
            for p in places:
                both = both[np.isin(both, p, assume_unique=True)]
            own = self.at[self.at_ptr[words[0]] : self.at_ptr[words[0] + 1]]
            self._phrases[key] = np.unique(self.row_at[self.at_ptr[words[0]] : self.at_ptr[words[0] + 1]][np.searchsorted(own, both)])
        return self._phrases[key]

    def matching(self, tree: Node | None, leaves: list[list[int]]) -> np.ndarray:
        """Rows of the documents that a query matches, ascending."""
        if tree is None:
            return np.arange(self.n)
        count = -1

        def go(x: Node) -> np.ndarray:
            nonlocal count
            if isinstance(x, Leaf):
                count += 1
                m = np.zeros(self.n, bool)
                m[self.rows(leaves[count])] = True
                return m
            parts = [go(a) for a in x.args]
            if x.name == "NOT":
                return ~parts[0]
            out = np.full(self.n, x.name == "AND")
            for p in parts:
                out = out & p if x.name == "AND" else out | p
            return out

        return np.flatnonzero(go(tree))

    def scores(self, leaves: list[list[int]], part: int, room: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Of these rows. room: zeros for all rows, which it gives back as zeros."""
        held = [slice(self.ptr[w], self.ptr[w + 1]) for x in leaves for w in x if w >= 0]
        for s in held:
            room[self.row[s]] += self.part[part][s]
        out = room[rows]
        for s in held:
            room[self.row[s]] = 0
        return out


def blocks(asked: Asked, batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """batches: (doc_id, title_tokens, body_tokens)."""
    terms, kept, at = pa.array(asked.terms, pa.string()), ([], [], []), 0
    for b in batches:
        if not b.num_rows:
            continue
        fields = [b.column(1), b.column(2)]
        length = np.stack([f.value_lengths().to_numpy(zero_copy_only=False) for f in fields], axis=1).astype("i8")
        ends = np.cumsum(length.ravel() + 1)
        starts = (ends - length.ravel() - 1).reshape(-1, 2) + at
        both = []
        for i, f in enumerate(fields):
            t = pc.fill_null(pc.index_in(f.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False).astype("i8")
            own = np.repeat(starts[:, i] - (np.cumsum(length[:, i]) - length[:, i]), length[:, i]) + np.arange(len(t))
            both.append((t[t >= 0], own[t >= 0]))
        t, own = (np.concatenate(x) for x in zip(*both))
        order = np.argsort(own, kind="stable")
        for x, y in zip(kept, (b.column(0).to_numpy(zero_copy_only=False), length, (t[order], own[order]))):
            x.append(y)
        at += int(ends[-1])
        if at >= TOKENS:
            yield Block(asked, *kept)
            kept, at = ([], [], []), 0
    if at:
        yield Block(asked, *kept)


def _given(columns: list[str], rows: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows)], names=columns)


def all_matches(asked: Asked, batches: Iterator[pa.RecordBatch], score: bool) -> Iterator[pa.RecordBatch]:
    """(qid, doc_id) and, if asked for, the score over both fields, of all that match."""
    names = ["qid", "doc_id", PARTS[0]][: 2 + score]
    for block in blocks(asked, batches):
        room, rows, held = np.zeros(block.n), [], 0
        for _, tree, leaves, qids in asked.kinds():
            m = block.matching(tree, leaves)
            if not len(m):
                continue
            s = block.scores(leaves, 0, room, m) if score else m
            for q in qids:
                rows.append([np.full(len(m), q), block.docs[m], s][: 2 + score])
                held += len(m)
                if held >= ROWS:
                    yield _given(names, rows)
                    rows, held = [], 0
        if rows:
            yield _given(names, rows)


def best_matches(asked: Asked, batches: Iterator[pa.RecordBatch], k: int, part: int) -> Iterator[pa.RecordBatch]:
    """(kind, doc_id, score, n): of each kind of query the k rows of largest score, rounded to 9 places, and smallest
    doc_id; n, once a kind, is the number of all that match."""
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    total: dict[int, int] = {}
    for block in blocks(asked, batches):
        room = np.zeros(block.n)
        for i, tree, leaves, _ in asked.kinds():
            m = block.matching(tree, leaves)
            if not len(m):
                continue
            total[i] = total.get(i, 0) + len(m)
            s = np.round(block.scores(leaves, part, room, m), 9)
            if i in best and len(best[i][0]) >= k:
                keep = s >= best[i][0][-1]
                m, s = m[keep], s[keep]
            if len(s) > k:
                keep = s >= np.partition(s, -k)[-k]
                m, s = m[keep], s[keep]
            if not len(s):
                continue
            d = block.docs[m]
            if i in best:
                s, d = np.concatenate([best[i][0], s]), np.concatenate([best[i][1], d])
            order = np.lexsort((d, -s))[:k]
            best[i] = s[order], d[order]
    rows, held = [], 0
    for i, (s, d) in best.items():
        n = np.zeros(len(s), "i8")
        n[0] = total[i]
        rows.append([np.full(len(s), i), d, s, n])
        held += len(s)
        if held >= ROWS:
            yield _given(["kind", "doc_id", "score", "n"], rows)
            rows, held = [], 0
    if rows:
        yield _given(["kind", "doc_id", "score", "n"], rows)


def sums_of(asked: Asked, batches: Iterator[pa.RecordBatch], docs: np.ndarray, qids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What the features of given pairs (sorted by docs) are made of, for those that hold a word of the query."""
    kinds = list(asked.kinds())
    kind_of = {q: i for i, _, _, own in kinds for q in own.tolist()}
    known = [[w for x in leaves for w in x if w >= 0] for _, _, leaves, _ in kinds]
    size = np.array([len(x) for x in known] + [0])
    words, ptr = np.array([w for x in known for w in x], "i8"), np.concatenate([[0], np.cumsum(size)])
    kind = np.array([kind_of.get(q, len(known)) for q in qids.tolist()], "i8")
    names = ["qid", "doc_id", "s", "sb", "st", "k", "fb", "ft", "fb_min", "ft_min", "title_len", "body_len"]
    for block in blocks(asked, batches):
        low, high = np.searchsorted(docs, block.docs, "left"), np.searchsorted(docs, block.docs, "right")
        row = np.repeat(np.arange(block.n), high - low)
        pair = np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low) + np.arange(len(row))
        many = size[kind[pair]]
        own = np.repeat(np.arange(len(pair)), many)
        word = words[np.repeat(ptr[kind[pair]] - (np.cumsum(many) - many), many) + np.arange(len(own))]
        key = word * block.n + row[own]
        place = np.searchsorted(block.key, key)
        hit = place < len(block.key)
        hit[hit] = block.key[place[hit]] == key[hit]
        own, place = own[hit], place[hit]
        if not len(own):
            continue
        some, start = np.unique(own, return_index=True)
        total = lambda x: np.add.reduceat(x[place], start)
        least = lambda x: np.minimum.reduceat(x[place], start)
        count = np.diff(np.append(start, len(own)))
        fb, ft, long = block.first_body, block.first_title, block.length[row[some]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qids[pair[some]], block.docs[row[some]], *map(total, block.part), count, total(fb), total(ft), least(fb), least(ft), long[:, 0], long[:, 1])], names=names)
