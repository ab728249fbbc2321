"""Filling fixed-capacity containers: large-item matching, smaller items best-fit into the gaps.

Texts enter the plan only by their length: the plan is made on the histogram of lengths, whose size the capacity
bounds, and holds runs of equal containers; items then find their container by their rank within their length.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import materialize

TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048
#: Items of one length that are ranked in one group.
BUCKET = 200_000


def count_tokens(df: DataFrame, text: str, out: str = "n_tokens", vocabulary: str = TOKENIZER_FILE) -> DataFrame:
    """Add ``out`` (INT): tokens of the whole text. NULL and empty texts have 0. An existing ``out`` is replaced.
    ``vocabulary``: a file of the driver, which Spark hands to the executors."""
    df.sparkSession.sparkContext.addFile(vocabulary)
    kept, name = {}, os.path.basename(vocabulary)

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        import tiktoken

        if "e" not in kept:
            with open(SparkFiles.get(name), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            kept["e"] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return texts.map(lambda s: len(kept["e"].encode_ordinary(s)) if s else 0)

    return df.withColumn(out, count(F.coalesce(F.col(text), F.lit(""))))


def plan(histogram: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """Length -> [(first rank, how many, first container)], and the number of containers.

    Items of more than a third of the capacity are matched, largest first, each with the largest other that fits beside
    it (at most two such a container). The rest go, largest first, into the smallest gap that holds them; where there
    is none, new containers are opened."""
    left = {s: n for s, n in histogram.items() if n > 0 and s > 0}
    assert not left or max(left) <= capacity
    placed: dict[int, list[tuple[int, int, int]]] = {s: [] for s in left}
    rank = dict.fromkeys(left, 0)
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # gaps that some container has

    def put(s: int, n: int, at: int) -> None:
        placed[s].append((rank[s], n, at))
        rank[s] += n
        left[s] -= n

    def leave(gap: int, at: int, n: int) -> None:
        if gap <= 0 or n <= 0:
            return
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append((at, n))

    large = sorted(s for s in left if 3 * s > capacity)
    for s in reversed(large):
        while left[s]:
            i = bisect_left(large, min(s, capacity - s) + 1) - 1
            while i >= 0 and (left[large[i]] == 0 or (large[i] == s and left[s] < 2)):
                i -= 1
            if i < 0:
                n = left[s]
                put(s, n, bins)
                leave(capacity - s, bins, n)
            elif large[i] == s:
                n = left[s] // 2
                put(s, n, bins)
                put(s, n, bins)
                leave(capacity - 2 * s, bins, n)
            else:
                n = min(left[s], left[large[i]])
                put(s, n, bins)
                put(large[i], n, bins)
                leave(capacity - s - large[i], bins, n)
            bins += n
    for s in sorted((s for s in left if left[s]), reverse=True):
        while left[s]:
            i = bisect_left(order, s)
            if i < len(order):
                gap = order[i]
                at, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[i]
                k = min(n, left[s])
                put(s, k, at)
                leave(gap - s, at, k)
                leave(gap, at + k, n - k)
                continue
            each = capacity // s
            full, rest = divmod(left[s], each)
            for _ in range(each if full else 0):
                put(s, full, bins)
            leave(capacity - each * s, bins, full)
            bins += full
            for _ in range(rest):
                put(s, 1, bins)
            leave(capacity - rest * s, bins, 1 if rest else 0)
            bins += 1 if rest else 0
    return placed, bins


def pack(df: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, from_token, size, container): every item in a container, none over ``capacity``.

    An item longer than the capacity is cut into full pieces and a rest; no other is split. Items of size 0 or NULL
    need no room and go to container 0. Repeated keys are items of their own. The rank of an item within its length is
    found by hash buckets and their counts, so that a length that most items share isn't ranked in one task; buckets are
    as many as keep each at about ``BUCKET`` items of one length."""
    spark = df.sparkSession
    items = df.select(F.col(key).alias("__k"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("__s"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("__s") - 1, F.lit(0)), F.lit(capacity).cast("long"))
    pieces = items.select("__k", "__s", F.posexplode(starts).alias("piece", "from_token")).select("__k", "piece", "from_token", F.least(F.col("__s") - F.col("from_token"), F.lit(capacity)).cast("int").alias("size"))
    pieces = materialize(pieces)
    histogram = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), max(histogram.values(), default=0) // BUCKET + 1)
    pieces = pieces.withColumn("__b", F.pmod(F.xxhash64("__k", "piece"), F.lit(buckets)).cast("int"))
    counts = pieces.groupBy("size", "__b").count()
    offsets = counts.withColumn("__o", F.sum("count").over(Window.partitionBy("size").orderBy("__b")) - F.col("count")).drop("count")
    placed, _ = plan({s: n for s, n in histogram.items() if s > 0}, capacity)
    runs = {s: (np.array([r[0] for r in v]), np.array([r[2] for r in v])) for s, v in placed.items()}
    own = F.row_number().over(Window.partitionBy("size", "__b").orderBy("__k", "piece")) - 1
    ranked = pieces.withColumn("__r", own).join(offsets, ["size", "__b"]).withColumn("__r", F.col("__r") + F.col("__o"))

    @F.pandas_udf("long")
    def container(sizes: pd.Series, ranks: pd.Series) -> pd.Series:
        out = np.zeros(len(sizes), dtype=np.int64)
        s, r = sizes.to_numpy(), ranks.to_numpy()
        for one in np.unique(s):
            if one > 0:
                first, at = runs[int(one)]
                own = s == one
                i = np.searchsorted(first, r[own], side="right") - 1
                out[own] = at[i] + r[own] - first[i]
        return pd.Series(out)

    return ranked.select(F.col("__k").alias(key), "piece", "from_token", "size", container("size", "__r").alias("container"))


def pack_texts(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = TOKENIZER_FILE) -> DataFrame:
    """``pack`` of texts by their tokens."""
    return pack(count_tokens(df.select(key, text), text, "__n", vocabulary), key, "__n", capacity)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens, the least number of containers that could do, and the share filled."""
    each = packed.groupBy("container").agg(F.sum("size").alias("used"), F.count("*").alias("n"))
    return each.agg(F.count("*").alias("containers"), F.sum("n").alias("pieces"), F.sum("used").alias("tokens"), F.max("used").alias("fullest")).withColumn("least", F.ceil(F.col("tokens") / capacity)).withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * capacity), 6))


def faults(packed: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, and what must be 0: containers above ``capacity``, items split that would fit, items not covered by
    their pieces once each."""
    items = packed.groupBy(key).agg(F.sum("size").alias("n"), F.count("*").alias("pieces"), F.max(F.col("from_token") + F.col("size")).alias("end"), F.count_distinct("piece").alias("own"))
    torn, lost = (F.col("pieces") > 1) & (F.col("n") <= capacity), (F.col("end") != F.col("n")) | (F.col("own") != F.col("pieces"))
    over = packed.groupBy("container").agg(F.sum("size").alias("used")).agg(F.count_if(F.col("used") > capacity).alias("overfull"))
    return items.agg(F.count("*").alias("items"), F.count_if(torn).alias("torn"), F.count_if(lost).alias("lost")).crossJoin(F.broadcast(over))  # one row each
