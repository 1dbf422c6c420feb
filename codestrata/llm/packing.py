"""Documents into containers of fixed capacity: vector bin packing by the dot-product heuristic."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.files import spread
from codestrata.session import python_rows, ship

CAPACITY = 2048
#: Segments that one container may hold, and tokens in it that bear loss.
MAX_SEGMENTS, MAX_LOSS_TOKENS = 64, 2048
#: What of a text asks and bears no loss: its first paragraph, if another follows.
PROMPT = r"(?s)^\s*\S.*?\n[ \t]*\n(?=.*\S)"
#: Pieces that are packed together in one task; groups are drawn by hash, so each has the corpus's mix of lengths.
PIECES_PER_GROUP = 20_000
#: A stated number of partitions keeps groups from being merged into few long tasks.
MAX_TASKS = 10_000
#: Public tokenizer: a file of ranks, one token a line, and the pattern that splits a text before merging.
TOKENIZER = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut(total: int, silent: int, capacity: int, loss_tokens: int) -> Iterator[tuple[int, int, int]]:
    """(start, tokens, loss-bearing tokens) of the pieces of a text whose first ``silent`` tokens bear no loss.

    A text within both limits is one piece; else each piece goes as far as the limits let it.
    """
    at = 0
    while at < total:
        quiet = max(0, min(total, silent) - at)
        n = min(capacity, total - at, quiet + loss_tokens)
        yield at, n, max(0, n - quiet)
        at += n


def _lengths(path: str, capacity: int, loss_tokens: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        for pdf in batches:
            ids, pieces, starts, sizes, loss = [], [], [], [], []
            for doc, text, prompt in zip(pdf["doc_id"], pdf["text"], pdf["prompt"]):
                total = len(encoder.encode_ordinary(text))
                silent = len(encoder.encode_ordinary(prompt)) if isinstance(prompt, str) else 0
                for k, (at, n, lossy) in enumerate(cut(total, silent, capacity, loss_tokens)):
                    ids.append(doc), pieces.append(k), starts.append(at), sizes.append(n), loss.append(lossy)
            yield pd.DataFrame({"doc_id": ids, "piece": pieces, "token_start": starts, "tokens": sizes, "loss_tokens": loss}).astype(
                {"doc_id": "int64", "piece": "int32", "token_start": "int64", "tokens": "int32", "loss_tokens": "int32"})

    return rows


def pieces(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, prompt: Column | str | None = None,
           loss_tokens: int = MAX_LOSS_TOKENS) -> DataFrame:
    """doc_id, piece, token_start, tokens and loss_tokens of what is packed.

    A text of up to ``capacity`` tokens, ``loss_tokens`` of them bearing loss,
    is one piece; a longer one is split into pieces that reach a limit and a
    rest. ``prompt`` is a column or expression for the start of the text that bears no
    loss (null or empty: all tokens do); by default it is PROMPT. Null ids,
    null and empty texts have nothing to pack.
    """
    if capacity < 1 or loss_tokens < 1:
        raise ValueError("a container needs room for one token")
    path = tokenizer or tokenizer_path()
    asked = F.regexp_extract("text", PROMPT, 0) if prompt is None else F.col(prompt) if isinstance(prompt, str) else prompt
    rows = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text", asked.cast("string").alias("prompt")), "doc_id")
    return python_rows(rows, _lengths(path, capacity, loss_tokens), "doc_id long, piece int, token_start long, tokens int, loss_tokens int")


def pack(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of each row of ``sizes`` (items by dimensions).

    Containers are filled one at a time: among the items that still fit, the
    one whose demand has the greatest dot product with the room left goes in,
    both relative to the limits. Items with equal demands form one class, so
    each step scores classes. A last pass moves on when nothing fits. An item
    beyond a limit fits nowhere and is an error.
    """
    if len(sizes) and (sizes > limits).any():
        raise ValueError("an item exceeds a limit")
    demand, kind = np.unique(sizes, axis=0, return_inverse=True)
    kind = kind.ravel()
    order = np.argsort(kind, kind="stable")
    starts = np.searchsorted(kind[order], np.arange(len(demand) + 1))
    used = starts[:-1].copy()
    relative = demand / limits
    left = np.diff(starts)
    out = np.zeros(len(sizes), dtype=np.int64)
    container, remaining = -1, len(sizes)
    while remaining:
        container += 1
        room = limits.astype(np.int64).copy()
        while True:
            fits = (left > 0) & (demand <= room).all(axis=1)
            if not fits.any():
                break
            score = np.where(fits, relative @ (room / limits), -1.0)
            best = int(np.argmax(score))
            out[order[used[best]]] = container
            used[best] += 1
            left[best] -= 1
            room -= demand[best]
            remaining -= 1
    return out


def _pack_group(limits: tuple[int, int, int]):
    top = np.array(limits, dtype=np.int64)

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        sizes = np.stack([pdf["tokens"], np.ones(len(pdf)), pdf["loss_tokens"]], axis=1).astype(np.int64)
        number = pack(sizes, top)
        return pd.DataFrame({
            "container": [f"{g}-{n}" for g, n in zip(pdf["part"], number)], "doc_id": pdf["doc_id"], "piece": pdf["piece"],
            "token_start": pdf["token_start"], "tokens": pdf["tokens"], "loss_tokens": pdf["loss_tokens"],
        })

    return packed


def pack_documents(items: DataFrame, capacity: int = CAPACITY, segments: int = MAX_SEGMENTS, loss_tokens: int = MAX_LOSS_TOKENS,
                   per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """container, doc_id, piece, token_start, tokens, loss_tokens: each piece once.

    No container exceeds ``capacity`` tokens, ``segments`` pieces or
    ``loss_tokens``; a piece that does by itself is an error (``pieces`` makes
    none with the same limits). Full pieces are containers of their own. The others are
    packed in groups of about ``per_group``, drawn by a hash of document and
    piece whatever their source, so a group neither grows with the corpus nor
    with a hot source.
    """
    limit = min(loss_tokens, capacity)
    bad = items.where((F.col("tokens") > capacity) | (F.col("loss_tokens") > limit))
    if segments < 1 or bad.limit(1).count():
        raise ValueError("a piece exceeds a limit of the containers")
    full = items.where(F.col("tokens") >= capacity).select(
        F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container"), "doc_id", "piece", "token_start", "tokens", "loss_tokens"
    )
    rest = items.where(F.col("tokens") < capacity)
    ship(items.sparkSession)
    groups = max(1, -(-rest.count() // per_group))
    packed = (
        rest.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
        .repartition(min(groups, MAX_TASKS), "part").groupBy("part")
        .applyInPandas(_pack_group((capacity, segments, limit)),
                       "container string, doc_id long, piece int, token_start long, tokens int, loss_tokens int")
    )
    return packed.unionByName(full)


def container_fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per container: tokens, segments, loss-bearing tokens and the unused room."""
    return packed.groupBy("container").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("segments"), F.sum("loss_tokens").alias("loss_tokens"),
        (F.lit(capacity) - F.sum("tokens")).alias("unused"),
    )
