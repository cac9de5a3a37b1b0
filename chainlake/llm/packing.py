"""Problem 6: filling fixed-capacity containers, by vector best-fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlake.llm.spread import spread
from chainlake.storage import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


#: How byte-level BPE vocabularies cut a text before merging; the same for texts of ASCII characters only.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def text_lengths(tokenizer: str, held: int = 1 << 20):
    """A function from a list of texts to their numbers of tokens.

    Byte-level BPE cuts a text into pieces and merges within each, so a text's number is the sum of its pieces', and a
    piece that comes again need not be merged again; at most `held` pieces are remembered at a time. Tokenizers of
    another kind encode whole texts.
    """
    import json
    import os
    import re

    import regex

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer)
    model.encode_special_tokens = True
    with open(tokenizer, encoding="utf-8") as f:
        kind = json.load(f)
    cut = kind.get("pre_tokenizer") or {}
    if kind.get("normalizer") or cut.get("type") != "ByteLevel" or not cut.get("use_regex") or cut.get("add_prefix_space"):

        def whole(texts: list[str]) -> list[int]:
            return [len(e.ids) for k in range(0, len(texts), 64) for e in model.encode_batch_fast(texts[k : k + 64], add_special_tokens=False)]  # 64: bounds what the encodings hold in memory

        return whole

    class Pieces(dict):
        def __missing__(self, piece: str) -> int:
            n = len(model.encode(piece, add_special_tokens=False).ids)
            if len(self) < held:
                self[piece] = n
            return n

    lengths = Pieces()
    any_text, ascii_text = regex.compile(_PIECES), re.compile(_ASCII_PIECES)

    def by_piece(texts: list[str]) -> list[int]:
        if len(lengths) >= held:
            lengths.clear()
        return [sum(map(lengths.__getitem__, (ascii_text if t.isascii() else any_text).findall(t))) for t in texts]

    return by_piece


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens) of whole texts; null and empty texts have 0 tokens. Special tokens' strings are ordinary text."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths = text_lengths(tokenizer)
        for texts in batches:
            yield pd.Series(lengths(texts.fillna("").tolist()), dtype="int64")

    udf = F.pandas_udf(count, "bigint")
    return spread(documents.select(F.col(key), F.col(text))).select(F.col(key), udf(F.col(text)).alias("n_tokens"))


def vector_best_fit(sizes: np.ndarray, capacity: int, max_documents: int, max_attention: float, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.1, 0.1)) -> np.ndarray:
    """Bin of each item, items largest first; every bin keeps all three capacities, an item alone always fits.

    Demands are tokens, one document, and attention cost (tokens squared), each as a share of its
    capacity. rule "norm" takes the bin with the smallest weighted norm of what would be left; "dot" the one
    whose residual has the largest weighted dot product with the demand. Ties: the oldest bin.
    """
    w = np.asarray(weights)
    order = np.argsort(-sizes, kind="stable")
    demand = np.stack([sizes / capacity, np.full(len(sizes), 1 / max_documents), sizes.astype(float) ** 2 / max_attention], axis=1)
    residual = np.empty((len(sizes), 3))
    number = np.empty(len(sizes), dtype=np.int64)  # of the open bins
    bins = np.empty(len(sizes), dtype=np.int64)
    smallest = demand.min(axis=0) if len(sizes) else None
    opened = live = 0
    for k in order:
        d = demand[k]
        left = residual[:live] - d
        fits = np.flatnonzero((left >= -1e-9).all(axis=1))
        if len(fits):
            value = -(left[fits] ** 2 @ w) if rule == "norm" else residual[fits] @ (w * d)
            at = int(fits[value.argmax()])
            residual[at] -= d
        else:
            at, number[live] = live, opened
            residual[at] = 1 - d
            live, opened = live + 1, opened + 1
        bins[k] = number[at]
        if (residual[at] < smallest - 1e-9).any():  # nothing fits any more: keep the list of open bins short
            residual[at : live - 1], number[at : live - 1] = residual[at + 1 : live].copy(), number[at + 1 : live].copy()
            live -= 1
    return bins


def _fill(key: str, round_number: int, capacity: int, max_documents: int, max_attention: float, rule: str):
    """applyInPandas function that packs one shard."""

    def fill(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([key, "part"], kind="stable")
        bins = vector_best_fit(rows["n_tokens"].to_numpy(), capacity, max_documents, max_attention, rule)
        filled = np.bincount(bins, weights=rows["n_tokens"].to_numpy()).astype(np.int64)
        context = (np.int64(round_number) << 58) + (np.int64(group[0]) << 24) + bins
        return rows.assign(context_id=context, filled=filled[bins])[["context_id", key, "part", "first_token", "n_tokens", "filled"]]

    return fill


def pack(
    sizes: DataFrame,
    key: str = "doc_id",
    size: str = "n_tokens",
    capacity: int = 2048,
    max_documents: int = 32,
    attention: float = 0.875,
    rule: str = "norm",
    shard_rows: int = 4096,
    rounds: int = 3,
    enough: float = 0.995,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Puts items into containers: (context_id, key, part, first_token, n_tokens).

    An item larger than the capacity is cut into full parts and a rest; no other is ever cut. Items are
    spread by hash over shards of about shard_rows, each packed by vector_best_fit in one task; what lies in
    containers filled less than `enough` is dealt out and packed again in the next rounds, on fewer
    shards, so the loss at the shards' ends does not grow with the data. Each shard of a round is a task of its own.

    Besides its tokens a container holds at most max_documents documents, and the sum of their squared tokens, the cost of
    attention within documents, is at most `attention` times the squared capacity (1 lifts this limit, for no
    container exceeds it); an item that breaks a limit alone has a container alone. Null and non-positive sizes need no container and have no row; keys may repeat
    (each row is placed); no rows give no rows.
    """
    spark = sizes.sparkSession
    scratch = scratch or Scratch(spark, "pack")
    max_attention = attention * capacity**2
    items = sizes.where(F.col(size) > 0).select(F.col(key), F.col(size).cast("bigint").alias("whole"), F.lit(capacity).cast("bigint").alias("c"))
    parts = items.select(key, F.posexplode(F.expr("sequence(0L, (whole - 1) div c)")).alias("part", "at"), "whole", "c")
    parts = parts.select(key, "part", (F.col("at") * F.col("c")).alias("first_token"), F.least("c", F.col("whole") - F.col("at") * F.col("c")).alias("n_tokens"))
    todo = scratch.save(parts, "parts")
    done = []
    schema = f"context_id bigint, {key} {dict(todo.dtypes)[key]}, part int, first_token bigint, n_tokens bigint, filled bigint"
    for k in range(rounds):
        n = todo.count()
        if not n:
            break
        shards = max(1, -(-n // shard_rows))

        dealt = todo.withColumn("shard", F.pmod(F.xxhash64(F.col(key), "part", F.lit(k)), F.lit(shards)))
        packed = scratch.save(dealt.repartition(min(shards, 20_000), "shard").groupBy("shard").applyInPandas(_fill(key, k, capacity, max_documents, max_attention, rule), schema), f"packed{k}")
        last = k == rounds - 1 or shards == 1
        done.append(packed if last else packed.where(F.col("filled") >= enough * capacity))
        if last:
            break
        todo = packed.where(F.col("filled") < enough * capacity).drop("context_id", "filled")
    if not done:
        return spark.createDataFrame([], schema).drop("filled")
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return whole.drop("filled")


def contexts(documents: DataFrame, capacity: int = 2048, tokenizer: str = TOKENIZER, **options) -> DataFrame:
    """pack() over the token counts of documents."""
    scratch = Scratch(documents.sparkSession, "contexts")
    counts = scratch.save(token_counts(documents, tokenizer), "counts")
    return pack(counts, capacity=capacity, scratch=scratch, **options)
