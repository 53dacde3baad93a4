"""Passages of held-out test items inside a large corpus.

A passage is ``words`` consecutive words of an item with at most ``errors`` words changed, added or dropped. Pigeonhole: cut into
errors + 1 pieces, one piece of any such passage stays intact. All pieces of the items are looked up in every text at once, by hashes of
word numbers; around each hit the passage is verified with Myers' bit-parallel distance over words, which alone decides. Words that no
item has cost one dictionary lookup each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Settings:
    """words and errors as in the module. Items are held by every task up to max_words in all; more are taken in several passes."""

    words: int = 12
    errors: int = 1
    max_words: int = 1_000_000

    @property
    def piece(self) -> int:
        return self.words // (self.errors + 1)


def tokens(text: str) -> list[str]:
    """Maximal runs of letters and digits, without regard to case."""
    return WORD.findall(text.casefold())


def myers(pattern: list, text: list) -> list[int]:
    """For every end in text the least edit distance of the pattern to a stretch that ends there, one word being one symbol."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    pv, mv, score, out = full, 0, m, []
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        out.append(score)
    return out


class Finder:
    """The pieces of a bounded set of items by hash, 24 bytes each, and the verification of their hits."""

    def __init__(self, items: list[tuple[int, str]], settings: Settings):
        self.settings = settings
        self.items = {i: w for i, w in ((i, tokens(t)) for i, t in items) if len(w) >= settings.words}
        self.vocabulary: dict[str, int] = {}
        for words in self.items.values():
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.factors = np.random.default_rng(settings.piece).integers(1, 2**63, settings.piece, np.uint64) | np.uint64(1)
        self.order = list(self.items)
        keys, owner, place = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        for number, i in enumerate(self.order):
            at, key = self._keys(self.items[i])
            keys.append(key)
            owner.append(np.full(len(at), number, np.int32))
            place.append(at.astype(np.int32))
        every = np.concatenate(keys)
        by = np.argsort(every, kind="stable")
        self.keys, self.owner, self.place = every[by], np.concatenate(owner)[by], np.concatenate(place)[by]

    def _keys(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(places, keys) of the pieces all of whose words some item has."""
        get, piece = self.vocabulary.get, self.settings.piece
        number = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        known = np.concatenate([[0], np.cumsum(number > 0)])
        if len(words) < piece or known[-1] < piece:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(known[piece:] - known[:-piece] == piece)
        key = np.zeros(len(at), np.uint64)
        for k, factor in enumerate(self.factors):
            key += (number[at + k] ^ (key >> np.uint64(29))) * factor
        return at, key

    def find(self, text: str) -> list[tuple[int, int, int, str]]:
        """(item, longest unchanged run, least distance, passage) of every item of which the text holds a passage."""
        if not len(self.keys):
            return []
        words = tokens(text)
        places, keys = self._keys(words)
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        hits: dict[int, list[tuple[int, int]]] = {}
        latest: dict[tuple[int, int], int] = {}  # by item and shift: a hit that goes on is no new seed, so repeated words stay cheap
        for k in np.flatnonzero(high > low).tolist():
            first = int(places[k])
            for item, at in zip(self.owner[low[k] : high[k]].tolist(), self.place[low[k] : high[k]].tolist()):
                if latest.get((item, first - at)) != first - 1:
                    hits.setdefault(item, []).append((first, at))
                latest[item, first - at] = first
        found = []
        for number, seeds in hits.items():
            item = self.order[number]
            best = self._verify(words, self.items[item], seeds)
            if best is not None:
                found.append((item, *best))
        return found

    def _verify(self, words: list[str], item: list[str], seeds: list[tuple[int, int]]) -> tuple[int, int, str] | None:
        """The best passage around the seeds: least distance, then longest unchanged run."""
        n, errors = self.settings.words, self.settings.errors
        best = None
        for d, i in seeds:
            distance, stop = self._distance(words, item, d, i)
            if distance > errors:
                continue
            run = 0  # may be less than a piece, should two pieces share a key
            while d + run < len(words) and i + run < len(item) and words[d + run] == item[i + run]:
                run += 1
            start, stop = (d, max(stop, d + run)) if distance == 0 else (max(0, stop - n), stop)
            if best is None or (distance, -run) < (best[1], -best[0]):
                best = run, distance, " ".join(words[start:stop])
        return best

    def _distance(self, words: list[str], item: list[str], d: int, i: int) -> tuple[int, int]:
        """(distance, end) of the best passage of the item that holds the piece at i, near the text's word d."""
        n, errors, piece = self.settings.words, self.settings.errors, self.settings.piece
        low = max(0, d - n - errors)
        text = words[low : d + n + errors]
        best = n, low
        for first in range(max(0, i + piece - n), min(i, len(item) - n) + 1):
            scores = myers(item[first : first + n], text)
            least = min(scores)
            if least < best[0]:
                best = least, low + scores.index(least) + 1
        return best


_finders: dict = {}


def _finder(shared, settings: Settings) -> Finder:
    """The finder of a broadcast, built once a worker and kept until another is asked for."""
    key = shared._jbroadcast.id() if shared._jbroadcast is not None else shared._path
    if (key, settings) not in _finders:
        _finders.clear()
        _finders[key, settings] = Finder(shared.value, settings)
    return _finders[key, settings]


def leaks(documents: DataFrame, items: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_key, run, distance, passage): documents that hold a passage of an item, one row per document and item.

    distance is that of the best passage, 0 if it is unchanged; run the longest stretch of unchanged consecutive words from its first
    intact piece on. Null texts and items of fewer words than a passage give nothing. Items are read by the driver in parts of at most max_words words; the
    whole corpus is read once a part.
    """
    spark = documents.sparkSession
    kinds = dict(documents.dtypes)[key], dict(items.dtypes)[item_key]
    rows = spread_scan(documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()))
    schema = f"k {kinds[0]}, item {kinds[1]}, run int, distance int, passage string"
    parts, part, amount = [], [], 0
    for row in items.where(F.col(item_text).isNotNull()).select(item_key, item_text).distinct().orderBy(item_key).toLocalIterator():
        size = len(tokens(row[1]))
        if part and amount + size > settings.max_words:
            parts.append(part)
            part, amount = [], 0
        part.append((row[0], row[1]))
        amount += size
    out = None
    for part in [*parts, part]:
        shared = spark.sparkContext.broadcast(part)

        def find(frames, shared=shared):
            finder = _finder(shared, settings)
            for frame in frames:
                hits = [(k, *hit) for k, t in zip(frame["k"], frame["t"]) for hit in finder.find(t)]
                yield pd.DataFrame(hits, columns=["k", "item", "run", "distance", "passage"])

        found = rows.mapInPandas(find, schema)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("k").alias(key), F.col("item").alias(item_key), "run", "distance", "passage").dropDuplicates([key, item_key])


def spread_scan(rows: DataFrame) -> DataFrame:
    """rows, shuffled to all tasks if the scan has fewer partitions than the cluster runs at once; a large table stays as it is."""
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * parallel) if rows.rdd.getNumPartitions() < parallel else rows
