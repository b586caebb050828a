"""Evaluation passages inside a training corpus, found with an FM-index per shard.

A shard is a block of documents of about ``block_words`` words.  Its words are
written as ids of the words of the test items (any other word is 0) and indexed
(``fm_index``).  All phrases of ``seed`` words of the items are backward-searched
and their occurrences located from sampled suffix positions, once each.

An item can only be leaked by a document that holds enough of its phrases, so a
document must hold one of its rarer phrases: all but the few most frequent ones
in the block.  Only documents that do are looked at, and only there the frequent
phrases are added, so a stock phrase of many items costs nothing.  Items are
taken in slices of about ``SLICE`` occurrences; one item never has more than the
block has words, times the places of a phrase in it.

The score of a document and an item is the share of the item's words covered by
occurrences whose offset between document and item lies in a narrow band, which
inserted or lost words shift only little.  Where that share reaches ``FIRST``,
an exact check compares the words of item and document at every offset of the
band and counts the item's words in equal runs of at least ``RUN`` words.

The bounds follow from what a leak is: half of the item, one word in eight
changed.  A word then stands in an equal run of three or more with probability
7/8 * (1 - (1/8)^2 * (1 + 2 * 7/8)) = 0.83, so such a passage covers 0.42 of the
item in expectation, and a quarter of an item at most 0.25; ``SHARE`` = 0.36
lies between.  In runs of five or more, as the index sees them, a word stands
with probability 0.77, which makes 0.38 of the item; ``FIRST`` is half of that.

The items are broadcast in groups of about ``GROUP_CHARS`` characters, each one
pass over the documents.  A document longer than a block is cut into pieces that
overlap by twice the longest item.

Defined results: null and empty texts leak nothing; an item of fewer than
``seed`` words is never found; equal documents and equal items are each
reported; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from horograph.llm.fm_index import FMIndex, phrase_steps
from horograph.llm.text import WordIds, words

SEED, FIRST, RUN, SHARE, BLOCK_WORDS = 5, 0.18, 3, 0.36, 800_000
SLICE, GROUP_CHARS = 4_000_000, 8_000_000
SCHEMA = "doc_id bigint, item_id bigint, share double, first_word bigint, last_word bigint"


class Phrases:
    """The items' phrases, ready for a backward search."""

    def __init__(self, items: list[tuple[int, str]], seed: int) -> None:
        self.seed = seed
        self.item_ids = np.array([i for i, _ in items], np.int64)
        texts = [words(t) for _, t in items]
        self.vocabulary: dict[str, int] = {}
        ids = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in t], np.int64) for t in texts]
        self.words = ids
        self.length = np.array([len(t) for t in ids], np.int64)
        place = [(n, p) for n, t in enumerate(ids) for p in range(len(t) - seed + 1)]
        every = np.array([ids[n][p : p + seed] for n, p in place], np.int64).reshape(-1, seed)
        phrases, of = np.unique(every, axis=0, return_inverse=True)
        of = of.ravel()
        self.count = len(phrases)
        self.steps = phrase_steps(phrases) if len(phrases) else []
        # item by item the phrase at each of its places
        self.phrase = of
        self.at = np.array([p for _, p in place], np.int64) if place else np.zeros(0, np.int64)
        self.first = np.searchsorted(np.array([n for n, _ in place], np.int64), np.arange(len(ids) + 1)) if place else np.zeros(len(ids) + 1, np.int64)


def _repeat_ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges first[i]..last[i]-1."""
    n = last - first
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(first, n)


def _best_band(offset: np.ndarray, at: np.ndarray, length: int, seed: int, need: int) -> tuple[int, int]:
    """Most words of an item covered by occurrences with offsets in one band, and the lowest offset of that band."""
    order = np.argsort(offset, kind="stable")
    offset, at = offset[order], at[order]
    width = max(16, length // 4)
    ends = np.searchsorted(offset, offset + width, side="right")
    best = (0, 0)
    for s in np.flatnonzero((ends - np.arange(len(offset))) * seed >= need):
        if s and offset[s] == offset[s - 1] or (ends[s] - s) * seed <= best[0]:
            continue
        cover = np.zeros(length + 1, np.int64)
        p = np.unique(at[s : ends[s]])
        np.add.at(cover, p, 1)
        np.add.at(cover, np.minimum(p + seed, length), -1)
        covered = int((np.cumsum(cover)[:length] > 0).sum())
        if covered > best[0]:
            best = (covered, int(offset[s]))
    return best


def _exact(item: np.ndarray, doc: np.ndarray, low: int, run: int) -> tuple[float, int, int]:
    """Share of the item's words in equal runs of ``run`` words at offsets of the band from ``low``, first and last document word."""
    n = len(item)
    if n < run:
        return 0.0, 0, 0
    width = max(16, n // 4)
    offset = np.arange(low - width // 2, low + width + 1)
    at = np.arange(n)[None] + offset[:, None]
    same = (at >= 0) & (at < len(doc)) & (doc[np.clip(at, 0, len(doc) - 1)] == item[None])
    begin = same[:, : n - run + 1].copy()
    for k in range(1, run):
        begin &= same[:, k : n - run + 1 + k]
    cover = np.zeros(same.shape, bool)
    for k in range(run):
        cover[:, k : n - run + 1 + k] |= begin
    if not cover.any():
        return 0.0, 0, 0
    return float(cover.any(axis=0).mean()), int(at[cover].min()), int(at[cover].max())


def _slices_of(weight: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of items with together at most ``most`` occurrences, or of one item."""
    out, start, held = [], 0, 0
    for n, w in enumerate(weight.tolist()):
        if held and held + w > most:
            out.append((start, n))
            start, held = n, 0
        held += w
    return [*out, (start, len(weight))] if len(weight) > start else out


def _rows_of(item: int, phrases: Phrases, first: np.ndarray, doc: np.ndarray, starts: np.ndarray, spot: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(place among the occurrences, position in the item) of the phrases of an item in the documents that hold one of its rarer phrases.

    ``first`` are the bounds of the occurrences of each phrase in ``spot``,
    which are in order, and ``doc`` the documents they lie in.
    """
    own = slice(phrases.first[item], phrases.first[item + 1])
    phrase, at = phrases.phrase[own], phrases.at[own]
    often = first[phrase + 1] - first[phrase]
    # a document needs that many places; without the most frequent ones but one it holds one of the others
    late = np.zeros(len(phrase), bool)
    spare = -(-need // phrases.seed) - 1
    if spare > 0:
        late[np.argsort(often, kind="stable")[len(phrase) - spare :]] = True
    late &= often > 0
    early = ~late & (often > 0)
    rows = _repeat_ranges(first[phrase[early]], first[phrase[early] + 1])
    where = np.repeat(at[early], often[early])
    if not len(rows) or not late.any():
        return rows, where
    held = np.unique(doc[rows])
    low, high = starts[held], np.r_[starts[1:], spot.max() + 1][held]
    parts, places = [rows], [where]
    for p, x in zip(phrase[late], at[late]):
        inside = spot[first[p] : first[p + 1]]
        more = first[p] + _repeat_ranges(np.searchsorted(inside, low), np.searchsorted(inside, high))
        parts.append(more)
        places.append(np.full(len(more), x))
    return np.concatenate(parts), np.concatenate(places)


def _search_block(seq: np.ndarray, starts: np.ndarray, phrases: Phrases, share: float) -> list[tuple[int, int, float, int, int]]:
    """(document index in the block, item, share, first word, last word)."""
    index = FMIndex(seq, len(phrases.vocabulary) + 1)
    lo, hi = index.search(phrases.steps)
    live = np.flatnonzero(lo < hi)
    if not len(live):
        return []
    # a position begins one phrase, so all occurrences together are no more than the words of the block
    spot = index.locate(_repeat_ranges(lo[live], hi[live]))
    spot = spot[np.lexsort((spot, np.repeat(live, (hi - lo)[live])))]
    first = np.r_[0, np.cumsum(hi - lo)]
    doc = np.searchsorted(starts, spot, side="right") - 1
    need = np.ceil(min(FIRST, share) * phrases.length).astype(np.int64)
    often = np.r_[0, np.cumsum((first[1:] - first[:-1])[phrases.phrase])]
    weight = often[phrases.first[1:]] - often[phrases.first[:-1]]
    out = []
    for low, high in _slices_of(weight, SLICE):
        found = [(i, *_rows_of(i, phrases, first, doc, starts, spot, int(need[i]))) for i in range(low, high) if weight[i] * phrases.seed >= need[i]]
        if not found:
            continue
        item = np.concatenate([np.full(len(r), i) for i, r, _ in found])
        row, at = np.concatenate([r for _, r, _ in found]), np.concatenate([a for _, _, a in found])
        key = doc[row] * len(phrases.length) + item
        # an item's phrases that occur bound what they can cover
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        keep = np.flatnonzero(count[inverse] * phrases.seed >= need[item])
        keep = keep[np.argsort(key[keep], kind="stable")]
        cuts = np.flatnonzero(np.r_[True, key[keep][1:] != key[keep][:-1]]) if len(keep) else []
        for s, e in zip(cuts, np.r_[cuts[1:], len(keep)] if len(keep) else []):
            k = keep[s:e]
            d, i = int(doc[row[k[0]]]), int(item[k[0]])
            covered, band = _best_band(spot[row[k]] - starts[d] - at[k], at[k], int(phrases.length[i]), phrases.seed, int(need[i]))
            if covered >= need[i]:
                end = starts[d + 1] if d + 1 < len(starts) else len(seq)
                part, a, b = _exact(phrases.words[i], seq[starts[d] : end], band, RUN)
                if part >= share:
                    out.append((d, i, part, a, b))
    return out


def _finder(shared, share: float, block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = shared.value
        if not phrases.count:
            return
        ids_of = WordIds(phrases.vocabulary)
        overlap = 2 * int(phrases.length.max())
        parts: list[np.ndarray] = []
        owners: list[tuple[int, int]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal parts, owners, held
            if parts:
                starts = np.cumsum([0, *(len(p) for p in parts)])[:-1]
                found = _search_block(np.concatenate(parts), starts, phrases, share)
                rows = [(owners[d][0], int(phrases.item_ids[i]), s, a + owners[d][1], b + owners[d][1]) for d, i, s, a, b in found]
                cols = list(zip(*rows)) if rows else [[]] * 5
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "item_id", "share", "first_word", "last_word"])
            parts, owners, held = [], [], 0

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of.of(text.as_py())
                if len(ids) < phrases.seed:
                    continue
                seq = np.array(ids + [0], dtype=np.int64)
                for s in range(0, max(1, len(seq) - overlap), block_words):
                    piece = seq[s : s + block_words + overlap]
                    if piece[-1]:
                        piece = np.append(piece, 0)
                    parts.append(piece)
                    owners.append((doc, s))
                    held += len(piece)
                    if held >= block_words:
                        yield from flush()
        yield from flush()

    return run


def find_leaks(docs: DataFrame, items: DataFrame, seed: int = SEED, share: float = SHARE, block_words: int = BLOCK_WORDS, group_chars: int = GROUP_CHARS) -> DataFrame:
    """(doc_id, item_id, share, first_word, last_word) for every document that reproduces at least about half of an item."""
    spark = docs.sparkSession
    test = items.where(F.col("item_id").isNotNull() & F.col("item_text").isNotNull()).select("item_id", "item_text")
    groups = max(1, -(-int(test.agg(F.sum(F.length("item_text"))).first()[0] or 0) // group_chars))
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    found = []
    for g in range(groups):
        own = test.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g)
        shared = spark.sparkContext.broadcast(Phrases([(r["item_id"], r["item_text"]) for r in own.orderBy("item_id").collect()], seed))
        found.append(texts.mapInArrow(_finder(shared, share, block_words), SCHEMA))
    # a passage in the overlap of two pieces is found twice
    best = F.max_by(F.struct("first_word", "last_word"), F.col("share"))
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), best.alias("b")).select("doc_id", "item_id", "share", "b.first_word", "b.last_word")


def removal_spans(leaks: DataFrame) -> DataFrame:
    """Overlapping passages of a document merged: (doc_id, first_word, last_word, items)."""
    before = Window.partitionBy("doc_id").orderBy("first_word", "last_word", "item_id").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("first_word", "last_word", "item_id")
    fresh = F.coalesce(F.col("first_word") > F.max("last_word").over(before) + 1, F.lit(True)).cast("int")
    marked = leaks.withColumn("new", fresh).withColumn("span", F.sum("new").over(upto))
    return marked.groupBy("doc_id", "span").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.array_sort(F.collect_set("item_id")).alias("items")).drop("span")
