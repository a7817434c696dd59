"""Problem 7: documents packed whole into containers of a fixed number of tokens, by vector best-fit.

A container has three capacities: tokens, documents and attention cost (the sum of squared lengths). Items come longest
first; of the containers in which an item fits in every dimension, the one with the least weighted norm of what would
remain is taken. Items are dealt evenly over groups of GROUP_ITEMS, each packed by one task; what stands in containers
filled below REOPEN is packed again over fewer groups, so that no container is left poor because of where a group ended.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut

CAPACITY = 4_096
MAX_DOCUMENTS = 64
#: Squared tokens a container may cost in attention within documents; at capacity squared only tokens bind.
MAX_ATTENTION = CAPACITY * CAPACITY
WEIGHTS = (1.0, 0.1, 0.1)
GROUP_ITEMS = 20_000
REOPEN = 0.97
ROUNDS = 3
TOKENIZER = os.environ.get("TALLYLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# Fixed value: the pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, tokens. Null texts count as empty; the tokenizer's file must be on every executor."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(tokenizer).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": [len(encode(t)) if t else 0 for t in b["text"]]})

    return documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInPandas(count, "doc_id bigint, tokens int")


def best_fit(lengths: list[int], capacity: int = CAPACITY, max_documents: int = MAX_DOCUMENTS, max_attention: int = MAX_ATTENTION, weights: tuple[float, float, float] = WEIGHTS) -> list[int]:
    """The container number of each item, items longest first."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    where = [0] * len(lengths)
    # open containers by tokens left, then by documents and attention left; those alike in all three are interchangeable
    levels: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(capacity + 1)]
    mask = made = 0
    wt, wd, wa = weights
    for i in order:
        n = lengths[i]
        best, best_norm = None, math.inf
        m = mask >> n
        level = n
        while m:
            step = (m & -m).bit_length() - 1
            m >>= step
            level += step
            floor_norm = wt * ((level - n) / capacity) ** 2
            if floor_norm >= best_norm:
                break
            for d, a in levels[level]:
                if d < 1 or a < n * n:
                    continue
                norm = floor_norm + wd * ((d - 1) / max_documents) ** 2 + wa * ((a - n * n) / max_attention) ** 2
                if norm < best_norm or (norm == best_norm and best[0] == level and (d, a) < best[1]):
                    best, best_norm = (level, (d, a)), norm
            m >>= 1
            level += 1
        if best is None:
            b, rest, d, a = made, capacity - n, max_documents - 1, max_attention - n * n
            made += 1
        else:
            level, state = best
            alike = levels[level][state]
            b = alike.pop()
            if not alike:
                del levels[level][state]
                if not levels[level]:
                    mask &= ~(1 << level)
            rest, d, a = level - n, state[0] - 1, state[1] - n * n
        where[i] = b
        if d > 0:
            levels[rest].setdefault((d, a), []).append(b)
            mask |= 1 << rest
    return where


def pack(counts: DataFrame, capacity: int = CAPACITY, max_documents: int = MAX_DOCUMENTS, max_attention: int = MAX_ATTENTION, group_items: int = GROUP_ITEMS) -> DataFrame:
    """container, doc_id, piece, tokens: every document of counts (doc_id, tokens) in one container.

    A document beyond the capacity is cut into full pieces and a rest, each an item; all others stay whole. Documents of no
    tokens take a place but no room. Null counts are taken as 0, repeated rows are items of their own, an empty table gives
    an empty result. Containers and their names depend on the rows alone, not on their order or partitions. An item dearer than max_attention by itself (possible only if that is set below capacity squared) has
    a container of its own.
    """
    # rows that are alike are counted, then told apart by a copy number
    items = counts.groupBy("doc_id", F.coalesce("tokens", F.lit(0)).alias("total")).agg(F.count("*").alias("n")).select("doc_id", "total", F.explode(F.expr("sequence(1L, n)")).alias("row"))
    pieces = F.expr(f"sequence(0, greatest(cast(ceil(total / {capacity}) as int) - 1, 0))")
    items = items.select("doc_id", "row", "total", F.explode(pieces).alias("piece"))
    items = cut(items.select("doc_id", "row", "piece", F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).cast("int").alias("tokens")))
    schema = "container string, fill int, doc_id bigint, row bigint, piece int, tokens int"
    out, rest, last_groups = None, items, 0
    for k in range(ROUNDS):
        n = rest.count()
        groups = max(1, math.ceil(n / group_items))
        if n == 0:
            break
        final_round = groups == 1 or groups == last_groups or k == ROUNDS - 1
        last_groups = groups

        def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["tokens", "doc_id", "row", "piece"], ascending=[False, True, True, True])
            where = best_fit(rows["tokens"].tolist(), capacity, max_documents, max_attention)
            rows = rows.assign(bin=where)
            rows["fill"] = rows.groupby("bin")["tokens"].transform("sum").astype("int32")
            rows["container"] = [f"{key[1]}-{key[0]}-{b}" for b in where]
            return rows[["container", "fill", "doc_id", "row", "piece", "tokens"]]

        done = cut(rest.select("doc_id", "row", "piece", "tokens").groupBy(F.pmod(F.xxhash64("doc_id", "row", "piece", F.lit(k)), F.lit(groups)).alias("g"), F.lit(k).alias("k")).applyInPandas(packed, schema))
        again = F.col("fill") < capacity * REOPEN
        final = done if final_round else done.where(~again)
        out = final if out is None else out.unionByName(final)
        if final_round:
            break
        rest = done.where(again)
    if out is None:
        out = counts.sparkSession.createDataFrame([], schema)
    return out.select("container", "doc_id", "piece", "tokens")


def container_loads(packed: DataFrame, capacity: int = CAPACITY, max_documents: int = MAX_DOCUMENTS, max_attention: int = MAX_ATTENTION) -> DataFrame:
    """container, tokens, documents, attention and, for each dimension, the share of its capacity left unused (0 where one item alone exceeds it)."""
    loads = packed.groupBy("container").agg(F.sum("tokens").cast("bigint").alias("tokens"), F.count("*").alias("documents"), F.sum(F.col("tokens").cast("bigint") * F.col("tokens")).alias("attention"))
    return loads.withColumns({"tokens_unused": 1 - F.col("tokens") / capacity, "documents_unused": 1 - F.col("documents") / max_documents, "attention_unused": F.greatest(1 - F.col("attention") / max_attention, F.lit(0.0))})


def packing_checks(counts: DataFrame, packed: DataFrame, capacity: int = CAPACITY, max_documents: int = MAX_DOCUMENTS, max_attention: int = MAX_ATTENTION) -> DataFrame:
    """One row: documents given and placed, and how often each promise is broken (0 when all hold).

    tokens_lost: documents whose pieces don't sum to their tokens; split: documents within the capacity that are in pieces;
    over_*: containers beyond a capacity (a single item dearer than max_attention is none).
    """
    placed = packed.groupBy("doc_id").agg(F.sum("tokens").alias("got"), F.count("*").alias("pieces"))
    given = counts.groupBy(F.col("doc_id").alias("_id")).agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.count("*").alias("n"), F.max("tokens").alias("most"))
    both = given.join(placed, F.col("_id").eqNullSafe(F.col("doc_id")), "left")
    docs = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.coalesce(F.sum(F.when(F.col("got").isNotNull(), F.col("n"))), F.lit(0)).alias("placed"), F.count_if(~(F.coalesce("got", F.lit(-1)) == F.col("tokens"))).alias("tokens_lost"), F.count_if((F.coalesce("most", F.lit(0)) <= capacity) & (F.col("pieces") > F.col("n"))).alias("split"))
    loads = container_loads(packed, capacity, max_documents, max_attention)
    over = loads.agg(F.count_if(F.col("tokens") > capacity).alias("over_tokens"), F.count_if(F.col("documents") > max_documents).alias("over_documents"), F.count_if((F.col("attention") > max_attention) & (F.col("documents") > 1)).alias("over_attention"))
    return docs.join(F.broadcast(over))  # one row each
