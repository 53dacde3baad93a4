"""Text that was decoded with a wrong character encoding: found, and restored where that is still possible.

Counts of adjacent characters over the whole corpus give every pair its share of the corpus' mutual information. Among the pairs with
a character beyond ASCII, those of the greatest shares, which together make up nearly all of it, are probable, the others improbable,
the more so the less their share; maximum-scoring segments isolate the runs they make up. Inside these runs only, inverse mappings are
tested: the characters are encoded as the wrong encoding did not, decoded as the right one, and kept if the corpus finds the outcome
clearly more probable. Characters that were lost count only inside runs, too. Pure ASCII is never improbable here, as no mapping tested
yields it.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.leaks import spread_scan

#: Single-byte encodings that text is taken for, tested with UTF-8 and with each other where ALPHABETS says so.
SINGLE = ("cp1252", "latin-1", "cp1251", "cp1250", "iso8859-2", "koi8-r", "cp437", "cp850", "cp866", "mac-roman", "cp1253", "cp1254", "cp1257", "iso8859-5", "iso8859-15", "mac-cyrillic")
#: Multi-byte encodings that UTF-8 is taken for.
MULTI = ("gbk", "cp932", "big5", "euc-kr", "euc-jp")
#: Right encodings other than UTF-8 by the wrong single-byte one.
ALPHABETS = {
    "cp1251": ("cp1252", "koi8-r", "cp1250", "cp866"),
    "cp1252": ("cp1251", "koi8-r", "cp1250", "gbk", "shift-jis", "euc-jp", "big5", "cp437", "cp850", "cp866", "mac-roman", "euc-kr"),
    "koi8-r": ("cp1251", "cp1252", "cp866"),
    "cp437": ("cp1252", "cp866"),
    "cp850": ("cp1252",),
    "cp866": ("cp1251", "koi8-r", "cp1252"),
    "cp1250": ("cp1252",),
    "mac-roman": ("cp1252",),
    "iso8859-2": ("cp1252",),
}
BLANK = frozenset(" \t\n\r")
OPEN, CLOSE = "\"'`«“‘„‹「『(", "\"'`»”’“›」』)"


@dataclass(frozen=True)
class Settings:
    """probable: the part of the mutual information beyond ASCII that probable pairs make up. floor: information of

    a pair in bits, at least, since a common pair is no improbable one for being rarer than chance. least: score of a run, 1 being that
    of a pair never seen. gain: bits a pair that a restored run must save on average. gain_alphabet: the same for mappings that keep the
    number of characters. layers: wrong decodings undone one after another.
    """

    probable: float = 0.95
    floor: float = 0.5
    least: float = 0.5
    gain: float = 1.0
    gain_alphabet: float = 2.5
    layers: int = 4


def symbol(code: np.ndarray) -> np.ndarray:
    """Characters as symbols of a fixed alphabet: one by one in alphabetic scripts and signs, by blocks of 256 elsewhere."""
    single = (code < 0x0600) | ((code >= 0x2000) & (code < 0x2700)) | ((code >= 0x3000) & (code < 0x3100)) | ((code >= 0xFF00) & (code < 0x10000))
    return np.where(single, code, 0x10000 + (code >> 8)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def pair_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """(a, b, n): how often symbol b follows symbol a in all texts; ASCII letters count as themselves."""

    def count(frames):
        for frame in frames:
            joined = "\n\n".join(frame["text"])
            s = symbol(_codes(joined))
            key, n = np.unique((s[:-1] << 20) | s[1:], return_counts=True)
            yield pd.DataFrame({"a": key >> 20, "b": key & 0xFFFFF, "n": n})

    rows = spread_scan(documents.select(F.col(text).alias("text")).where(F.col("text").isNotNull()))
    return rows.mapInPandas(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


@dataclass
class Pairs:
    """Costs in bits and improbability of symbol pairs; size is bound by the alphabet, not by the corpus.

    score: 1 for pairs never seen, less the nearer their share is to that of the least probable pair, -0.6 for probable ones.
    """

    index: dict[int, int]
    cost: np.ndarray
    score: np.ndarray
    unseen: float
    lookup: np.ndarray = field(default=None)

    def ids(self, text: str) -> np.ndarray:
        if self.lookup is None:
            table = np.zeros(0x20000, np.int32)
            for s, i in self.index.items():
                table[s] = i
            self.lookup = table
        return self.lookup[symbol(_codes(text))]


def pair_model(counts: pd.DataFrame, settings: Settings) -> Pairs:
    """From the counts of all pairs: cost = -log2 p(ab), share = p(ab) max(floor, log2(p(ab) / p(a)p(b)))."""
    a, b, n = (counts[c].to_numpy(np.int64) for c in "abn")
    names = np.unique(np.concatenate([a, b])) if len(n) else np.zeros(0, np.int64)
    index = {int(s): i + 1 for i, s in enumerate(names)}  # 0 stands for symbols never seen
    size, total = len(names) + 1, max(1, n.sum())
    cost = np.full((size, size), math.log2(total / 0.25), np.float64)
    score = np.ones((size, size), np.float32)
    if len(n):
        ia, ib = np.searchsorted(names, a) + 1, np.searchsorted(names, b) + 1
        p, pa, pb = n / total, np.bincount(ia, n, size) / total, np.bincount(ib, n, size) / total
        share = p * np.maximum(np.log2(p / (pa[ia] * pb[ib])), settings.floor)
        cost[ia, ib] = -np.log2(p)
        mass = np.where((a > 127) | (b > 127), share, 0)
        order = np.argsort(-mass, kind="stable")
        last = order[min(np.searchsorted(np.cumsum(mass[order]), settings.probable * mass.sum()), len(order) - 1)]
        low = np.log2(np.maximum(mass[last], 1e-300) / np.maximum(mass, 1e-300))
        score[ia, ib] = np.where(mass >= mass[last], -0.6, np.clip(low / 4, 0.05, 1))
    return Pairs(index, cost, score, math.log2(total / 0.25))


def segments(score: np.ndarray) -> list[tuple[int, int]]:
    """All maximal scoring segments [start, end) of a sequence of scores (Ruzzo and Tompa), in linear time."""
    runs: list[tuple[int, int, float, float]] = []  # start, end, sum before it, sum at its end
    total = 0.0
    for i, s in enumerate(score.tolist()):
        if s <= 0:
            total += s
            continue
        start, left, right = i, total, total + s
        total = right
        while True:
            k = len(runs) - 1
            while k >= 0 and runs[k][2] >= left:
                k -= 1
            if k < 0 or runs[k][3] >= right:
                runs.append((start, i + 1, left, right))
                break
            start, left = runs[k][0], runs[k][2]
            del runs[k:]
    return [(a, b) for a, b, _, _ in runs]


def _byte_maps() -> dict[str, dict[str, int]]:
    """Character to byte of the single-byte encodings; bytes without a character stand for themselves, as browsers have it."""
    maps = {}
    for name in SINGLE:
        table: dict[str, int] = {}
        for byte in range(256):
            try:
                char = bytes([byte]).decode(name)
            except UnicodeDecodeError:
                char = chr(byte)
            table.setdefault(char, byte)
        maps[name] = table
    maps["cp1252"] |= {chr(b): b for b in range(128, 160) if chr(b) not in maps["cp1252"]}
    return maps


class Restorer:
    """Finds and undoes wrong decodings in one text after another."""

    def __init__(self, pairs: Pairs, settings: Settings = Settings()):
        self.pairs, self.settings, self.maps = pairs, settings, _byte_maps()
        self.cache: dict[tuple[str, str, str], tuple[str, str] | None] = {}

    def mean_cost(self, text: str) -> float:
        ids = self.pairs.ids(text)
        return float(self.pairs.cost[ids[:-1], ids[1:]].mean()) if len(ids) > 1 else 0.0

    def known(self, text: str) -> bool:
        """Whether the corpus has every pair of the text."""
        ids = self.pairs.ids(text)
        return bool((self.pairs.cost[ids[:-1], ids[1:]] < self.pairs.unseen).all())

    def runs(self, text: str) -> list[tuple[int, int]]:
        """Improbable runs [start, end), widened to the words they touch; none without a character beyond ASCII.

        A word ends at ASCII blanks only, since others come out of wrong decodings, and, where a script has no blanks, at a probable
        pair.
        """
        ids = self.pairs.ids(text)
        codes = _codes(text)
        wide, dense = codes > 127, (codes >= 0x3040) & (codes < 0xE000) | (codes >= 0xF900) & (codes < 0xFF00)
        score = np.where(wide[:-1] | wide[1:], self.pairs.score[ids[:-1], ids[1:]], -0.6)
        score = np.where((codes[:-1] == 0xFFFD) | (codes[1:] == 0xFFFD), 1.0, score)  # lost characters are never probable
        total = np.concatenate([[0.0], np.cumsum(score)])
        ends = np.concatenate([[False], dense[:-1] & dense[1:] & (score < 0), [False]])  # of words, before the character
        found: list[tuple[int, int]] = []
        for a, b in segments(score):
            if total[b] - total[a] < self.settings.least:
                continue
            b += 1
            while a > 0 and text[a - 1] not in BLANK and not ends[a]:
                a -= 1
            while b < len(text) and text[b] not in BLANK and not ends[b]:
                b += 1
            if found and a <= found[-1][1]:
                found[-1] = found[-1][0], max(b, found[-1][1])
            else:
                found.append((a, b))
        return found

    def _encoded(self, run: str, wrong: str) -> bytes | None:
        if wrong in self.maps:
            table = self.maps[wrong]
            try:
                return bytes([table[c] for c in run])
            except KeyError:
                return None
        try:
            return run.encode(wrong)
        except UnicodeEncodeError:
            return None

    def invert(self, run: str, before: str = " ", after: str = " ") -> tuple[str, str] | None:
        """(restored, mapping) by the mapping that the corpus finds most probable, None if none is clearly better than the run."""
        key = run, before, after
        if key not in self.cache:
            if len(self.cache) > 50_000:
                self.cache.clear()
            self.cache[key] = self._invert(run, before, after)
        return self.cache[key]

    def _invert(self, run: str, before: str, after: str) -> tuple[str, str] | None:
        own, best = self.mean_cost(before + run + after), None
        signs = [c for c in run if ord(c) > 127]
        blank = all(c.isspace() or unicodedata.category(c) == "Cf" for c in signs)
        for wrong in SINGLE + MULTI:
            raw = self._encoded(run, wrong)
            if raw is None:
                continue
            for right, gain in [("utf-8", self.settings.gain), *((r, self.settings.gain_alphabet) for r in ALPHABETS.get(wrong, ()))]:
                try:
                    text = raw.decode(right)
                except UnicodeDecodeError:
                    continue
                if text == run or blank and right != "utf-8" or any(ord(c) < 32 and c not in "\t\n\r" or 127 <= ord(c) < 160 and right != "utf-8" for c in text):
                    continue
                if right != "utf-8" and (len(run) < 3 and not (before.isalpha() and after.isalpha()) or not self.known(before + text + after)):
                    continue
                saved = own - self.mean_cost(before + text + after)
                if saved >= gain and (best is None or saved > best[0]):
                    best = saved, text, f"{right} read as {wrong}"
        return best and best[1:]

    @staticmethod
    def quoted(text: str, start: int, end: int) -> bool:
        """Whether the run is a quotation of its own: put in quotation marks, with or without blanks inside them."""
        inner = text[start:end].rstrip(".,;:!?")
        if len(inner) > 2 and inner[0] in OPEN and inner[-1] in CLOSE:
            return True
        before, after = text[max(0, start - 2) : start].strip(), text[end : end + 2].strip()
        return bool(before and after and before[-1] in OPEN and after[0] in CLOSE)

    def check(self, text: str) -> tuple[str, list[str], bool, bool]:
        """(restored text, mappings, garbled, lost): garbled without lost means that all was restored."""
        mappings: list[str] = []
        garbled, lost = False, False
        if text.isascii():
            return text, mappings, garbled, lost
        for _ in range(self.settings.layers):
            out, at, changed = [], 0, False
            for a, b in self.runs(text):
                if a < at:
                    continue
                out.append(text[at:a])
                piece = self._restore(text, a, b, mappings)
                changed |= piece != text[a:b]
                out.append(piece)
                at = b
            out.append(text[at:])
            if not changed:
                break
            text, garbled = "".join(out), True
        for a, b in self.runs(text) if "\ufffd" in text else ():
            for i in range(a, b):
                around = (text[i - 1 : i] + text[i + 1 : i + 2]).replace("\ufffd", "x")
                if text[i] == "\ufffd" and any(c.isalnum() for c in around):
                    garbled = lost = True
        return text, list(dict.fromkeys(mappings)), garbled, lost

    def _restore(self, text: str, a: int, b: int, mappings: list[str]) -> str:
        """The run restored as a whole, or word by word, or stretch by stretch of characters beyond ASCII."""
        run = text[a:b]
        before, after = text[a - 1 : a] or " ", text[b : b + 1] or " "
        words = run.split(" ")
        if len(words) == 1 and self.quoted(text, a, b):
            return run
        if whole := self.invert(run, before, after):
            mappings.append(whole[1])
            return whole[0]
        out, at = [], a
        for word in words:
            end = at + len(word)
            out.append(self._word(text, at, end, mappings) if not word.isascii() else word)
            at = end + 1
        return " ".join(out)

    def _word(self, text: str, a: int, b: int, mappings: list[str]) -> str:
        if self.quoted(text, a, b):
            return text[a:b]
        if found := self.invert(text[a:b], text[a - 1 : a] or " ", text[b : b + 1] or " "):
            mappings.append(found[1])
            return found[0]
        out, at = [], a
        while at < b:
            end = at + 1
            if ord(text[at]) > 127:
                while end < b and ord(text[end]) > 127:
                    end += 1
                found = self.invert(text[at:end], text[at - 1 : at] or " ", text[end : end + 1] or " ")
                if found:
                    mappings.append(found[1])
                out.append(found[0] if found else text[at:end])
            else:
                out.append(text[at])
            at = end
        return "".join(out)


def garbled(documents: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, restored, mappings, lost) of the documents that hold a wrongly decoded passage, one row per input row that does.

    restored is the text with everything undone that could be, lost tells whether replacement characters in words are left. A passage
    that stands in quotation marks of its own, or a replacement character between blanks, is talked about and no case. Null and
    empty texts are none either; other columns are ignored.
    """
    counts = pair_counts(documents, text).toPandas()  # pairs of a fixed alphabet: bounded, however large the corpus
    shared = documents.sparkSession.sparkContext.broadcast(pair_model(counts, settings))

    def check(frames):
        restorer = Restorer(shared.value, settings)
        for frame in frames:
            out = []
            for k, t in zip(frame["key"], frame["text"]):
                restored, mappings, bad, lost = restorer.check(t)
                if bad:
                    out.append((k, restored, mappings, lost))
            yield pd.DataFrame(out, columns=["key", "restored", "mappings", "lost"])

    kind = dict(documents.dtypes)[key]
    rows = spread_scan(documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7F]")))
    return rows.mapInPandas(check, f"key {kind}, restored string, mappings array<string>, lost boolean").withColumnRenamed("key", key)
