"""Evaluation texts leaking into training text (problem 9).

Documents are indexed where they lie: each task builds FM-indexes over its own documents, shard by shard, without a
shuffle. The alphabet is the vocabulary of the test items (every other word is one separating symbol). All distinct
four-word phrases of the items are searched backwards through the ranks of a wavelet matrix, all at a time;
occurrences are located by sampled suffix positions. A passage of at least MIN_WORDS words with at most one word in
six changed keeps three such phrases near one diagonal, so that nothing is lost; these few candidates are verified
by an exact alignment of item and text that begins and ends with words of both: the longest passage, then those before and
after it, so that an item quoted several times is removed every time. Removal spans of all items of a document are merged.

The test items are the fixed table eval_items and go to every task; documents of any length are indexed whole.
Null and empty texts, and items of fewer than MIN_WORDS words, have no matches; repeated documents are all found.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: A leak is this many successive words of an item, with at most one word in ONE_IN changed, dropped or added.
MIN_WORDS, ONE_IN = 15, 6
#: Words of a search phrase, and how many phrases on nearby diagonals a leak keeps at least.
PHRASE, MIN_HITS = 4, 3
#: Symbols of one index; documents are never divided.
SHARD = 500_000
#: Every so many suffix positions are kept for locating.
SAMPLE = 8
#: Diagonals are grouped in overlapping bands of this width: no passage strays farther by insertions and deletions.
BAND = 32
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(unicodedata.normalize("NFKC", text).casefold())


class WaveletMatrix:
    """Ranks of symbols in a sequence: one level a bit, zeros before ones."""

    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.bits, self.ranks, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ranks.append(ones)
            z = len(seq) - int(ones[-1])
            self.zeros.append(z)
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] before at[i]."""
        lo, hi = np.zeros_like(at), at.copy()
        for level, ones in enumerate(self.ranks):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            l1, h1 = ones[lo], ones[hi]
            z = self.zeros[level]
            lo, hi = np.where(bit == 1, z + l1, lo - l1), np.where(bit == 1, z + h1, hi - h1)
        return hi - lo


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; an end is smaller than every symbol."""
    n = len(text)
    sa = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    s = text[sa]
    rank[sa] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
    k = 1
    while rank[sa[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        sa = np.argsort(key)
        s = key[sa]
        rank[sa] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
        k *= 2
    return sa


class FMIndex:
    """Backward search of many patterns at a time over integer text with symbols below 2**bits."""

    def __init__(self, text: np.ndarray, bits: int) -> None:
        text = np.append(text + 1, 0).astype(np.int64)  # 0 ends the text
        bits += 1
        self.n = len(text)
        sa = suffix_array(text)
        self.bwt = text[sa - 1]
        self.first = np.searchsorted(np.sort(text), np.arange(2**bits + 1)).astype(np.int64)
        self.wavelet = WaveletMatrix(self.bwt, bits)
        self.kept = sa % SAMPLE == 0
        self.kept_before = np.concatenate([[0], np.cumsum(self.kept)])
        self.positions = sa[self.kept]

    def count(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the rows of patterns."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, j].astype(np.int64) + 1
            start = self.first[c]
            lo, hi = start + self.wavelet.rank(c, lo), start + self.wavelet.rank(c, hi)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to the next kept position."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            done = self.kept[at[todo]]
            hit = todo[done]
            out[hit] = self.positions[self.kept_before[at[hit]]] + steps[hit]
            todo = todo[~done]
            c = self.bwt[at[todo]]
            at[todo] = self.first[c] + self.wavelet.rank(c, at[todo])
            steps[todo] += 1
        return out


class Items:
    """The test items as symbols (0: not in any item) and their search phrases."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        kept = [(i, w) for i, t in rows if t and len(w := words_of(t)) >= MIN_WORDS]
        self.ids = [i for i, _ in kept]
        vocabulary = sorted({w for _, ws in kept for w in ws})
        self.symbol = {w: k + 1 for k, w in enumerate(vocabulary)}
        self.bits = max(1, len(vocabulary).bit_length())
        self.texts = [np.array([self.symbol[w] for w in ws]) for _, ws in kept]
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for k, t in enumerate(self.texts):
            for j in range(len(t) - PHRASE + 1):
                places.setdefault(tuple(t[j : j + PHRASE]), []).append((k, j))
        self.phrases = np.array(list(places), dtype=np.int64).reshape(-1, PHRASE)
        self.places = [np.array(p) for p in places.values()]


#: More edits than any item has words.
FAR = 1 << 20


def leaked(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int] | None:
    """(first item word, words, end in text) of the longest passage of item in text within the allowed edits, or None.

    A passage begins and ends with words that are in the text: words changed at its edges aren't part of it, else any
    phrase of thirteen words would make one of fifteen. For every first word at once, size by size, the edit distance
    of item[first : first + size] to its best span of text that begins with the first word.
    """
    m, n = len(item), len(text)
    if not n:
        return None
    firsts = np.arange(m)
    dist = np.full((m, n + 1), FAR, np.int32)
    dist[:, :n][item[:, None] == text[None, :]] = 0
    offset = np.arange(n + 1, dtype=np.int32)
    best: tuple[int, int, int] | None = None
    for size in range(1, m + 1):
        firsts = firsts[: m - size + 1]
        dist = dist[: len(firsts)]
        differ = item[firsts + size - 1][:, None] != text[None, :]
        new = dist + 1
        np.minimum(new[:, 1:], dist[:, :-1] + differ, out=new[:, 1:])
        dist = np.minimum.accumulate(new - offset, axis=1) + offset
        if size >= MIN_WORDS:
            ending = np.where(differ, FAR, dist[:, 1:])
            least = ending.min(axis=1)
            ok = np.flatnonzero(least <= size // ONE_IN)
            if len(ok):
                k = ok[np.argmin(least[ok])]
                best = (int(firsts[k]), size, int(ending[k].argmin()) + 1)
    return best


def passages(item: np.ndarray, whole: np.ndarray, first: int, last: int) -> list[tuple[int, int]]:
    """(begin, end) of every passage of item in whole[first:last]: the longest, then those before and after it."""
    out, parts = [], [(first, last)]
    while parts:
        first, last = parts.pop()
        if last - first < MIN_WORDS - MIN_WORDS // ONE_IN or (found := leaked(item, whole[first:last])) is None:
            continue
        at, size, end = found
        span = whole[max(first, first + end - size - size // ONE_IN) : first + end]
        blocks = [x for x in SequenceMatcher(None, span.tolist(), item[at : at + size].tolist(), autojunk=False).get_matching_blocks() if x.size]
        begin, end = first + end - len(span) + (blocks[0].a if blocks else 0), first + end
        out.append((begin, end))
        parts += [(first, begin), (end, last)]
    return out


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap as one: windows of neighbouring bands may see one passage to different ends."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def search(doc_ids: list[int], texts: list[str], items: Items) -> list[tuple[int, int, int, int]]:
    """(doc_id, item_id, first character, end character) of the leaks in one shard of documents."""
    get = items.symbol.get
    tokens = [np.array([get(w, 0) for w in words_of(t)], dtype=np.int64) for t in texts]
    # the indexed text: documents one after another, separated; a run of foreign words is one symbol
    parts, origin, owner = [], [], []
    for k, t in enumerate(tokens):
        if not len(t):
            continue
        keep = np.flatnonzero((t != 0) | (np.concatenate([[1], t[:-1]]) != 0))
        parts += [t[keep], [0]]
        origin += [keep, [0]]
        owner.append(np.full(len(keep) + 1, k))
    if not parts or not len(items.phrases):
        return []
    text, origin_, owner_ = np.concatenate(parts).astype(np.int64), np.concatenate(origin), np.concatenate(owner)
    index = FMIndex(text, items.bits)
    lo, hi = index.count(items.phrases)
    counts = hi - lo
    which = np.repeat(np.arange(len(lo)), counts)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + lo[which]
    at = index.locate(rows)
    # every occurrence for every place of the phrase in the items
    n_places = np.array([len(p) for p in items.places])
    times = n_places[which]
    occ = np.repeat(np.arange(len(which)), times)
    inner = np.arange(len(occ)) - np.repeat(np.cumsum(times) - times, times)
    flat, start = np.concatenate(items.places), np.cumsum(n_places) - n_places
    place = flat[start[which[occ]] + inner]
    doc, pos = owner_[at[occ]], origin_[at[occ]]
    diagonal = pos - place[:, 1] + 4096
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for shift in (0, BAND // 2):
        key = np.stack([doc, place[:, 0], (diagonal + shift) // BAND], 1)
        order = np.lexsort((pos, key[:, 2], key[:, 1], key[:, 0]))
        k = key[order]
        cut = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)]))
        ends = np.append(cut[1:], len(k))
        for a, b in zip(cut[ends - cut >= MIN_HITS], ends[ends - cut >= MIN_HITS]):
            d, i = int(k[a, 0]), int(k[a, 1])
            hits = order[a:b]
            spans = found.setdefault((d, i), [])
            # phrases of passages that are known already say nothing new
            for begin, end in spans:
                hits = hits[(pos[hits] < begin) | (pos[hits] >= end)]
            if len(np.unique(place[hits, 1])) < MIN_HITS:
                continue
            item, whole = items.texts[i], tokens[d]
            first, last = max(0, int(pos[hits[0]]) - len(item) - BAND), min(len(whole), int(pos[hits[-1]]) + len(item) + BAND)
            spans += passages(item, whole, first, last)
    return [(doc_ids[d], items.ids[i], begin, end) for (d, i), spans in found.items() for begin, end in united(spans)]


def find(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, end_word): every passage of every item in every document."""
    rows = [(r["item_id"], r["text"]) for r in eval_items.select("item_id", "text").collect()]  # the fixed list of test items

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = Items(rows)
        ids: list[int] = []
        texts: list[str] = []
        size = 0

        def done() -> pd.DataFrame:
            return pd.DataFrame(search(ids, texts, items), columns=["doc_id", "item_id", "first_word", "end_word"])

        for batch in batches:
            for i, t in zip(batch["doc_id"], batch["text"]):
                if t:
                    ids.append(int(i))
                    texts.append(t)
                    size += len(t) // 6 + 1
                if size >= SHARD:
                    yield done()
                    ids, texts, size = [], [], 0
        if ids:
            yield done()

    return documents.filter("doc_id is not null").select("doc_id", "text").mapInPandas(shards, "doc_id bigint, item_id bigint, first_word bigint, end_word bigint")
