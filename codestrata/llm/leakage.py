"""Evaluation passages inside training documents: size-partitioned MinHash containment search, then exact verification."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.files import spread
from codestrata.session import python_rows

#: Least number of consecutive words, or of Chinese characters, that a document shares with a passage.
WORD_RUN, CJK_RUN = 15, 30
#: Units of one shingle; a run of n units has n - shingle + 1 shingles.
WORD_SHINGLE, CJK_SHINGLE = 5, 10
#: Chance, at most, that a shared run of the least length holds no signature value of its passage.
MISS = 1e-6
#: Up to so many bytes of passages are handed to every task, with their signatures (fewer values than
#: passages have words and characters, 8 bytes each); more are joined by shuffles.
MAX_BROADCAST_TEXT = 8 << 20

_WORDS = re.compile(r"[a-z0-9]+")
_CJK = re.compile(r"[㐀-䶿一-鿿豈-﫿\U00020000-\U0003134F]")
_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def units(text: str) -> tuple[list[str], list[str]]:
    """The words (runs of a-z and 0-9 in any case) and the Chinese characters of a text, in order."""
    # lower() alone would turn some letters beyond ASCII into ASCII ones
    return _WORDS.findall(text.translate(_ASCII_LOWER)), _CJK.findall(text)


# -- shingles of many texts at once, by numpy

_WORD_BYTE = np.zeros(256, dtype=np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _WORD_BYTE[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _WORD_BYTE[_c] = _c + 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words that begin within so many bytes are hashed at once; longer words than the second are hashed by themselves.
_BLOCK, _LONGEST = 1 << 18, 4096


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and those of its inverse modulo 2**64."""
    steps = [np.full(_BLOCK + _LONGEST + 1, b) for b in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))]
    for s in steps:
        s[0] = 1
    return np.multiply.accumulate(steps[0]), np.multiply.accumulate(steps[1])


def _word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the words data[first:last]: sums of bytes by powers, from running sums shifted to the words' starts."""
    up, down = _powers()
    out = np.zeros(len(first), dtype=np.uint64)
    long = last - first > _LONGEST
    cuts = np.searchsorted(first, np.arange(0, len(data) + _BLOCK, _BLOCK))
    for i, j in zip(cuts, cuts[1:]):
        if i < j:
            at = first[i]
            part = data[at:at + _BLOCK + _LONGEST].astype(np.uint64)
            total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(part * up[:len(part)])])
            end = np.minimum(last[i:j] - at, len(part))
            out[i:j] = (total[end] - total[first[i:j] - at]) * down[first[i:j] - at]
    for i in np.nonzero(long)[0]:
        out[i] = int.from_bytes(hashlib.blake2b(data[first[i]:last[i]].tobytes(), digest_size=8).digest(), "little")
    return _mixed(out)


def _mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64 bits that looks like another hash function for each salt."""
    h = h ^ np.uint64(salt * 0x9FB21C651E98DF25 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _windows(h: np.ndarray, owner: np.ndarray, width: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, owner) of every run of ``width`` units that have one owner."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    out = np.full(n, np.uint64(salt))
    for i in range(width):
        out = out * _BASE + h[i:i + n]
    whole = owner[:n] == owner[width - 1:]
    return _mixed(out[whole]), owner[:n][whole]


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of all shingles of words and of Chinese characters.

    All words of the texts are hashed together, block by block.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    # a separator after each text keeps its last word from the next text's first
    data = _WORD_BYTE[np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)]
    ends = np.cumsum([len(r) + 1 for r in raw])
    inside = data != 0
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    first, last = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    found, owners = [], []
    if len(first):
        word = _word_hashes(data, first, last)
        h, owner = _windows(word, np.searchsorted(ends, first, side="right"), WORD_SHINGLE, 1)
        found.append(h), owners.append(owner)
    wide = [i for i, r in enumerate(raw) if not r.isascii()]
    if wide:
        chars = [_CJK.findall(texts[i]) for i in wide]
        point = np.fromiter((ord(c) for row in chars for c in row), dtype=np.uint64)
        h, owner = _windows(_mixed(point), np.repeat(np.array(wide, dtype=np.int64), [len(row) for row in chars]), CJK_SHINGLE, 2)
        found.append(h), owners.append(owner)
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(found), np.concatenate(owners)


# -- signatures of passages, by size class


def size_class(n: int) -> int:
    """The upper bound of the size class of a passage with ``n`` shingles: classes double."""
    return 1 << max(0, n - 1).bit_length()


def bands(upper: int, run: int) -> int:
    """MinHash values that a passage of up to ``upper`` shingles needs.

    A leaked piece has at least ``run`` of them. One value lies outside of it
    with a chance of 1 - run / upper, so this many all do with a chance of MISS at most.
    """
    return 1 if run >= upper else math.ceil(math.log(MISS) / math.log1p(-run / upper))


def signature(h: np.ndarray, run: int) -> np.ndarray:
    """The passage's MinHash values: its least shingle under each of its size class's functions.

    Each is given as the shingle's plain hash, so a document of any length is
    asked whether it contains it, and needs no signature of its own.
    """
    if not len(h):
        return h
    return np.unique([h[np.argmin(_mixed(h, k + 1))] for k in range(bands(size_class(len(np.unique(h))), run))])


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, values = [], []
        for i, text in zip(pdf["item_id"], pdf["passage"]):
            words, chars = units(text)
            # the two kinds of units are asked for separately, each by its own runs
            for part, run in ((" ".join(words), WORD_RUN - WORD_SHINGLE + 1), ("".join(chars), CJK_RUN - CJK_SHINGLE + 1)):
                h, _ = shingles([part])
                if len(h) >= run:
                    got = signature(h, run)
                    ids.append(np.full(len(got), i, dtype=np.int64)), values.append(got.view(np.int64))
        yield pd.DataFrame({"item_id": np.concatenate(ids) if ids else np.zeros(0, "int64"), "value": np.concatenate(values) if values else np.zeros(0, "int64")})


def runs(text: str) -> set[str]:
    """All runs of the least length, of words and of Chinese characters, as texts."""
    words, chars = units(text)
    found = {" ".join(words[i:i + WORD_RUN]) for i in range(len(words) - WORD_RUN + 1)}
    found.update("".join(chars[i:i + CJK_RUN]) for i in range(len(chars) - CJK_RUN + 1))
    return found


def shares_run(text: str, passage: str) -> bool:
    """Exact containment: whether some run of the least length occurs in both texts."""
    return not runs(passage).isdisjoint(runs(text))


def _values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        h, owner = shingles(pdf["text"].tolist())
        yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[owner], "value": h.view(np.int64)}).drop_duplicates()


def _by_joins(docs: DataFrame, passages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Candidates by a join of shingle hashes, verified after joins with both texts; for any number of items."""
    pairs = python_rows(spread(docs, "doc_id"), _values, "doc_id long, value long").join(wanted, "value").select("doc_id", "item_id").distinct()

    @F.pandas_udf("boolean")
    def verified(text: pd.Series, passage: pd.Series) -> pd.Series:
        out, last, own = [], None, set()
        for t, p in zip(text, passage):
            if t is not last and t != last:
                last, own = t, runs(t)
            out.append(not runs(p).isdisjoint(own))
        return pd.Series(out, dtype="bool")

    # sorted by document, so its runs are built once for all items it may hold
    full = pairs.join(docs, "doc_id").join(passages, "item_id").sortWithinPartitions("doc_id")
    return full.where(verified("text", "passage")).select("doc_id", "item_id").distinct()


def _in_tasks(docs: DataFrame, passages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Candidates and their verification where the documents lie, with the items' signatures and passages at hand."""
    spark = docs.sparkSession
    rows, texts = wanted.toPandas().sort_values("value"), passages.toPandas()
    shared = spark.sparkContext.broadcast((
        rows["value"].to_numpy(np.int64).view(np.uint64), rows["item_id"].to_numpy(np.int64), dict(zip(texts["item_id"].tolist(), texts["passage"]))))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, item, passage = shared.value
        order = np.argsort(asked, kind="stable")
        asked, item = asked[order], item[order]
        known: dict[int, set[str]] = {}
        for pdf in batches:
            texts = pdf["text"].tolist()
            h, owner = shingles(texts)
            at = np.searchsorted(asked, h)
            hit = np.nonzero(asked[np.minimum(at, len(asked) - 1)] == h)[0] if len(asked) else np.zeros(0, dtype=np.int64)
            met = {(int(owner[i]), int(item[k])) for i in hit for k in range(at[i], np.searchsorted(asked, h[i], side="right"))}
            out, last, own = [], None, set()
            for doc, i in sorted(met):
                if i not in known:
                    known[i] = runs(passage[i])
                if doc != last:
                    last, own = doc, runs(texts[doc])
                if not known[i].isdisjoint(own):
                    out.append((pdf["doc_id"].iloc[doc], i))
            yield pd.DataFrame(out, columns=["doc_id", "item_id"]).astype("int64")

    return python_rows(spread(docs, "doc_id"), found, "doc_id long, item_id long").distinct()


def leaked_items(documents: DataFrame, items: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """(doc_id, item_id) of documents that contain a piece of an item's passage.

    A piece is a run of WORD_RUN words (runs of a-z and 0-9 in any case, what
    stands between does not count) or of CJK_RUN Chinese characters. Null ids,
    texts and passages, and passages shorter than a piece, match nothing; a
    repeated item_id counts with all its passages. Passages that share
    sentences each report the documents that hold them.

    Passages are partitioned by their number of shingles. Each size class has
    as many MinHash values as the containment of a least piece in its largest
    passage asks for (``bands``), and a document that contains any of a
    passage's values is a candidate, however long it is; exact runs verify it.
    The search may miss a pair with a chance of MISS. ``broadcast`` says whether tasks
    get all signatures; by default they do up to a stated size.
    """
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    passages = items.where("item_id is not null and passage is not null").select("item_id", "passage").distinct()
    wanted = python_rows(passages, _signatures, "item_id long, value long").distinct()
    if broadcast is None:
        size = passages.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("ids"), F.sum(F.octet_length("passage")).alias("bytes")).first()
        broadcast = size["n"] == size["ids"] and (size["bytes"] or 0) <= MAX_BROADCAST_TEXT
    return _in_tasks(docs, passages, wanted) if broadcast else _by_joins(docs, passages, wanted)


def leak_report(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents per item, for every item that leaked."""
    found = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return items.select("item_id", "suite", "category").distinct().join(found, "item_id")
