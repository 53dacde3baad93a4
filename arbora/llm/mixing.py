"""Mixing sources to target shares of all tokens.

Texts are counted by source and exact token length. Every source's budget is filled with whole rounds over its texts first; what is
left is spread over the lengths in proportion, and the last part is fitted by a bounded-knapsack dynamic program over the remaining
counts, so that shares are met to the token wherever lengths allow. The documents themselves are drawn by a seeded hash, so many of
each length as the fit says.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.session import cut

#: Fixed value: the split pattern that goes with the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 256


@dataclass(frozen=True)
class Settings:
    """ranks: file of a byte-level vocabulary that every machine has. tokens: size of the mix, None for the largest that the caps

    allow. window: tokens that the dynamic program fits exactly; the rest is spread in proportion.
    """

    ranks: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = PATTERN
    tokens: int | None = None
    seed: int = 1
    window: int = 20_000


_encodings: dict = {}


def encoding(ranks: str, pattern: str):
    """The tokenizer, read once a process."""
    if (ranks, pattern) not in _encodings:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encodings[ranks, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encodings[ranks, pattern]


def counted(documents: DataFrame, settings: Settings, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, text_id, n): tokens of every document with a text and a source, sources in one spelling, text_id 128 bits of hash."""
    ranks, pattern = settings.ranks, settings.pattern

    def count(frames):
        own = encoding(ranks, pattern)
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "source": frame["source"], "h1": frame["h1"], "h2": frame["h2"], "n": [len(own.encode_ordinary(t)) for t in frame["text"]]})

    kind = dict(documents.dtypes)[key]
    name = F.lower(F.regexp_replace(F.col(source), r"^\s+|\s+$", ""))
    rows = documents.where(F.col(text).isNotNull() & F.col(source).isNotNull()).select(F.col(key).alias("id"), name.alias("source"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), F.col(text)).alias("h2"), F.col(text).alias("text"))
    return rows.mapInPandas(count, f"id {kind}, source string, h1 long, h2 long, n int").where("n > 0")


def fit(counts: dict[int, int], budget: int, window: int) -> dict[int, int]:
    """How many documents of each length to take so that their tokens come as close to the budget as possible without exceeding it.

    counts: documents by length. First so many of every length as its part of all tokens says, then, from the longest, whole documents
    while more than the window is left, then the largest sum within the rest by dynamic programming over the remaining counts.
    """
    total = sum(length * n for length, n in counts.items())
    if budget >= total:
        return dict(counts)
    taken = {length: n * budget // total for length, n in counts.items()}
    left = budget - sum(length * n for length, n in taken.items())
    for length in sorted(counts, reverse=True):
        more = min(counts[length] - taken[length], max(0, left - window) // length)
        taken[length] += more
        left -= more * length
    reach, steps = 1, []  # bit t is set if t tokens can be made up
    full = (1 << left + 1) - 1
    for length in sorted(counts, reverse=True):
        free, lot = min(counts[length] - taken[length], left // length), 1
        while free:
            lot = min(lot, free)
            steps.append((length, lot, reach))
            reach |= reach << length * lot & full
            free -= lot
            lot *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for length, lot, before in reversed(steps):
        if not before >> at & 1:
            taken[length] += lot
            at -= length * lot
    return taken


def plan(counts: dict[str, dict[int, int]], targets: list[tuple[str, float, int | None]], settings: Settings) -> dict[str, tuple[int, dict[int, int]]]:
    """(rounds, extra by length) per source. Sources without texts get nothing; the shares of the others are scaled to 1 among them."""
    size = {s: sum(length * n for length, n in by.items()) for s, by in counts.items()}
    usable = [(s, share, cap) for s, share, cap in targets if share > 0 and size.get(s) and cap != 0]
    scale = sum(share for _, share, _ in usable)
    caps = [cap * size[s] / (share / scale) for s, share, cap in usable if cap is not None]
    total = settings.tokens if settings.tokens is not None else (min(caps) if caps else sum(size[s] for s, _, _ in usable))
    if caps:
        total = min(total, min(caps))
    out = {}
    for s, share, cap in usable:
        budget = round(total * share / scale)
        rounds = budget // size[s]
        extra = fit(counts[s], budget - rounds * size[s], settings.window) if cap is None or rounds < cap else {}
        out[s] = int(rounds), {length: n for length, n in extra.items() if n}
    return out


def mix(documents: DataFrame, targets: DataFrame, settings: Settings = Settings(), **columns: str) -> DataFrame:
    """(id, source, n, repeats): the documents of the mix, one row each, with their tokens and how often they are used.

    Every text counts once, under its least id and the least targeted source it occurs in. targets: (source, target_share,
    max_repeats), null max_repeats meaning no cap; sources are one if they differ in case or outer blanks only, then their shares add
    up and the least cap holds. Documents with null or empty text, null source or a source without target are left out. The size of
    the mix is what the tightest cap allows, or settings.tokens if that is less. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    name = F.lower(F.regexp_replace("source", r"^\s+|\s+$", ""))
    goals = targets.where(F.col("source").isNotNull()).groupBy(name.alias("source")).agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("cap"))
    wanted = [(r["source"], float(r["share"] or 0), r["cap"]) for r in goals.orderBy("source").collect()]
    aimed = goals.where("share > 0").select("source")
    rows = counted(documents, settings, **columns).join(F.broadcast(aimed), "source", "left_semi")
    texts = cut(rows.groupBy("h1", "h2").agg(F.min(F.struct("source", "id", "n")).alias("v")).select("v.*", F.xxhash64(F.lit(settings.seed), "h1", "h2").alias("draw")))
    lengths = texts.groupBy("source", "n").agg(F.count("*").alias("count")).collect()  # one row a source and length: no text is longer than the longest
    counts: dict[str, dict[int, int]] = {}
    for r in lengths:
        counts.setdefault(r["source"], {})[r["n"]] = r["count"]
    fitted = plan(counts, wanted, settings)
    quota = [(s, length, rounds, extra.get(length, 0)) for s, (rounds, extra) in fitted.items() for length in counts[s]]
    quotas = spark.createDataFrame(quota, "source string, n int, rounds int, extra long")
    # the first ``extra`` by draw of each length, ranked within ranges of the draw, so that a common length is no single task
    bucket = F.shiftrightunsigned("draw", 56).cast("int")
    spread = texts.withColumn("bucket", bucket)
    sizes = spread.groupBy("source", "n", "bucket").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.partitionBy("source", "n").orderBy("bucket")) - F.col("size")).drop("size")
    placed = spread.join(before, ["source", "n", "bucket"]).join(quotas, ["source", "n"])
    rank = F.row_number().over(Window.partitionBy("source", "n", "bucket").orderBy("draw", "id")) + F.col("before")
    used = placed.withColumn("repeats", F.col("rounds") + F.when(rank <= F.col("extra"), 1).otherwise(0))
    return used.where("repeats > 0").select("id", "source", "n", "repeats")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, texts, uses, tokens, actual_share, most_repeats), one row per target source.

    actual_share is 0 for sources without texts.
    """
    name = F.lower(F.regexp_replace("source", r"^\s+|\s+$", ""))
    goals = targets.where(F.col("source").isNotNull()).groupBy(name.alias("source")).agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    got = mixed.groupBy("source").agg(F.count("*").alias("texts"), F.sum("repeats").alias("uses"), F.sum(F.col("n").cast("long") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    total = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy(F.lit("all")))
    joined = goals.join(got, "source", "left").withColumn("total", total)  # as many rows as there are targets
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    share = F.when(F.col("total") > 0, F.coalesce("tokens", F.lit(0)) / F.col("total")).otherwise(0.0).alias("actual_share")
    return joined.select("source", "target_share", "max_repeats", zero("texts"), zero("uses"), zero("tokens"), share, zero("most_repeats"))
