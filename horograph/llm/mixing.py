"""A corpus whose sources hold target shares of all tokens, by the cube method.

A source that would have to give ``e`` copies of each of its tokens gives every
document ``floor(e)`` copies and one more with probability ``e - floor(e)``,
where ``e`` is at most its cap.  The cube method draws the extra copies so that
the number of documents and of tokens of each source come out as expected: in
each step three documents move along the null-space of the two constraints
until one of them is decided.  The steps run for many triples at once inside a
partition, which leaves at most two undecided documents per source; those of
all partitions run again in groups of at most ``GROUP`` documents until one
group per source is left, whose last two documents are landed.

``shortfalls`` reads the sources that cannot reach their share off the drawn
corpus: every document of such a source was taken as often as its cap allows,
and the tokens so taken are still too few.

The size of the corpus is the number of tokens of all documents that have a
text and a source, unless given.

Defined results: documents without text or source take no part; sources are
compared trimmed and in small letters; a source without documents reaches
nothing and falls short; sources without a target are not taken but count in
the size; empty texts have no tokens and are drawn as any document; repeated
rows are drawn each; empty tables give empty results.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horograph.runtime import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pattern that cuts a text before byte-pair encoding; a fixed value of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are encoded in pieces that end where white space begins, which is where the pattern cuts too.
PIECE = 100_000
_CUT = re.compile(r"(?<=\S)[ \n]")
#: Undecided documents of a source that one task takes.
GROUP = 8192


def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(encode, text: str) -> int:
    """Tokens of the whole text; a text without a place to cut is encoded in one piece."""
    total, start = 0, 0
    while len(text) - start > PIECE:
        cut = _CUT.search(text, start + PIECE)
        if cut is None:
            break
        total += len(encode(text[start : cut.start()]))
        start = cut.start()
    return total + len(encode(text[start:]))


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for b in batches:
            encode = encode or _encoding(shared.value).encode_ordinary
            n = [count_tokens(encode, t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    return run


def token_sizes(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of the documents with text and source; the source in the form it is compared in."""
    # the vocabulary goes with the job, so only the driver needs the file
    with open(tokenizer, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.where(F.col("text").isNotNull() & F.col("source").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.trim("source")).alias("source"), "text")
    return rows.mapInArrow(_counter(shared), "doc_id bigint, source string, tokens bigint")


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move inclusion probabilities to 0 or 1, keeping their sum and their sum weighted by ``size``; at most two stay open."""
    p = p.astype(np.float64).copy()
    scale = float(size.max()) if len(size) and size.max() > 0 else 1.0
    t = size / scale
    open_ = np.flatnonzero((p > 0) & (p < 1))
    while len(open_) > 2:
        rng.shuffle(open_)
        m = len(open_) // 3
        tri = open_[: 3 * m].reshape(m, 3)
        a, b, c = t[tri[:, 0]], t[tri[:, 1]], t[tri[:, 2]]
        u = np.stack([c - b, a - c, b - a], axis=1)
        flat = np.abs(u).max(axis=1) < 1e-12
        u[flat] = [1.0, -1.0, 0.0]
        u /= np.abs(u).max(axis=1, keepdims=True)
        # documents of nearly one size move together; a speck of direction would never decide one
        u[np.abs(u) < 1e-12] = 0.0
        q = p[tri]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min(axis=1)
            down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)).min(axis=1)
        step = np.where(rng.random(m) * (up + down) < down, up, -down)
        q = q + step[:, None] * u
        q[q < 1e-9] = 0.0
        q[q > 1 - 1e-9] = 1.0
        p[tri] = q
        open_ = open_[(p[open_] > 0) & (p[open_] < 1)]
    return p


def land(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide the last open units by systematic sampling, so the number of units comes out as near as it can."""
    start = rng.random()
    edges = np.floor(np.cumsum(p) + start)
    return (edges - np.floor(np.r_[0.0, np.cumsum(p)[:-1]] + start) > 0).astype(np.float64)


def _flyer(plan: dict[str, tuple[int, float]], seed: int):
    """Decides the documents of a partition; undecided ones keep a probability strictly between 0 and 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        held: dict[str, list[tuple[int, int, float]]] = {}

        def out(ids, source, tokens, p):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([source] * len(ids), pa.string()), pa.array(tokens, pa.int64()), pa.array(p, pa.float64())], names=["doc_id", "source", "tokens", "p"])

        for b in batches:
            source = np.array(b.column("source").to_pylist(), dtype=object)
            ids, tokens = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("tokens").to_numpy()
            start = b.column("p").to_numpy()
            for s in sorted(set(source.tolist())):
                if s not in plan:
                    continue
                m = source == s
                i, t, p = ids[m], tokens[m], start[m]
                if s in held:
                    hi, ht, hp = zip(*held.pop(s))
                    i, t, p = np.r_[np.array(hi, i.dtype), i], np.r_[np.array(ht, t.dtype), t], np.r_[hp, p]
                p = flight(p, t, rng)
                rest = (p > 0) & (p < 1)
                if rest.any():
                    held[s] = list(zip(i[rest].tolist(), t[rest].tolist(), p[rest].tolist()))
                yield out(i[~rest], s, t[~rest], p[~rest])
        for s, rows in held.items():
            i, t, p = zip(*rows)
            yield out(i, s, t, p)

    return run


def _lander(seed: int, last: bool):
    """One more flight over a group of undecided documents of a source; the last group is landed too."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("tokens", "ascending"), ("p", "ascending")])
        rng = np.random.default_rng([seed, key[1].as_py(), *key[0].as_py().encode()])
        p = flight(t.column("p").to_numpy(), t.column("tokens").to_numpy(), rng)
        rest = np.flatnonzero((p > 0) & (p < 1))
        if last:
            p[rest] = land(p[rest], rng)
        return pa.table({"doc_id": t.column("doc_id"), "source": t.column("source"), "tokens": t.column("tokens"), "p": pa.array(p, pa.float64())})

    return run


def settle(flown: DataFrame, seed: int, group: int = GROUP) -> DataFrame:
    """Decides the documents that the flights in the partitions left open."""
    schema = "doc_id bigint, source string, tokens bigint, p double"
    rest = (F.col("p") > 0) & (F.col("p") < 1)
    done, open_ = flown.where(~rest), flown.where(rest)
    turn = 0
    while True:
        turn += 1
        # two documents of a group stay open, so the groups shrink to one
        most = open_.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        groups = max(1, -(-most // group))
        of = F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(groups)).cast("int")
        landed = open_.withColumn("g", of).groupBy("source", "g").applyInArrow(_lander(seed + turn, groups == 1), schema)
        if groups == 1:
            return done.unionByName(landed)
        landed = materialize(landed)
        done, open_ = done.unionByName(landed.where(~rest)), landed.where(rest)


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, size: int | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(taken, report).

    ``taken``: (doc_id, source, tokens, copies) with at least one copy.
    ``report``: per source of ``targets`` the target share, the tokens and
    documents it has, the tokens and documents taken, the share reached and
    whether it falls short.
    """
    spark = docs.sparkSession
    sized = materialize(token_sizes(docs, tokenizer))
    # one row per source of the targets, a table of shares made by hand
    want = targets.where(F.col("source").isNotNull()).select(F.col("source").alias("name"), F.lower(F.trim("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("bigint").alias("cap")).collect()
    keys = [w["source"] for w in want]
    total = int(size if size is not None else sized.agg(F.sum("tokens")).first()[0] or 0)
    held = {r["source"]: (int(r["tokens"]), int(r["docs"])) for r in sized.where(F.col("source").isin(keys)).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()}
    plan: dict[str, tuple[int, float]] = {}
    for w in want:
        tokens, cap = held.get(w["source"], (0, 0))[0], max(0, w["cap"] or 0)
        e = min((w["share"] or 0.0) * total / tokens if tokens else 0.0, float(cap))
        plan[w["source"]] = (int(e), e - int(e))
    whole = F.create_map(*[F.lit(x) for s, (n, _) in plan.items() for x in (s, n)]) if plan else F.lit(None).cast("map<string,int>")
    part = F.create_map(*[F.lit(x) for s, (_, f) in plan.items() for x in (s, f)]) if plan else F.lit(None).cast("map<string,double>")
    drawn = sized.where(F.col("source").isin(keys)).withColumn("p", part[F.col("source")])
    schema = "doc_id bigint, source string, tokens bigint, p double"
    flown = materialize(drawn.mapInArrow(_flyer(plan, seed), schema))
    copies = whole[F.col("source")] + F.col("p").cast("int")
    taken = materialize(settle(flown, seed).select("doc_id", "source", "tokens", copies.alias("copies")).where(F.col("copies") > 0))
    drawn = shortfalls(taken, want, held, total)
    schema = "source string, target_share double, max_repeats bigint, tokens bigint, documents bigint, taken_tokens bigint, taken_documents bigint, share double, most_copies bigint, largest_document bigint, falls_short boolean, within_cap boolean, on_target boolean"
    return taken, spark.createDataFrame(drawn, schema)


def shortfalls(taken: DataFrame, want: list, held: dict[str, tuple[int, int]], total: int) -> list[tuple]:
    """Per source of the targets what the drawn rows hold and what follows from them alone.

    ``falls_short``: every document stands in the corpus as often as the cap
    allows and the tokens are still fewer than the share of ``total``.
    ``within_cap``: no document stands in it more often.  ``on_target``: the
    tokens miss the share by no more than two documents, which is what landing
    may cost, unless the source falls short.
    """
    tokens = F.col("tokens") * F.col("copies")
    caps = {w["source"]: max(0, w["cap"] or 0) for w in want}
    cap = F.create_map(*[F.lit(x) for s, c in caps.items() for x in (s, c)])[F.col("source")] if caps else F.lit(0)
    per = taken.groupBy("source").agg(
        F.sum(tokens).alias("tokens"), F.sum("copies").alias("docs"), F.max("copies").alias("most"), F.max("tokens").alias("largest"), F.sum((F.col("copies") == cap).cast("bigint")).alias("at_cap")
    )
    got = {r["source"]: r for r in per.collect()}
    corpus = sum(r["tokens"] for r in got.values())
    rows = []
    for w in want:
        has, n = held.get(w["source"], (0, 0))
        r = got.get(w["source"])
        t, d, most, largest, at_cap = (r["tokens"], r["docs"], r["most"], r["largest"], r["at_cap"]) if r else (0, 0, 0, 0, 0)
        wanted = (w["share"] or 0.0) * total
        short = t < wanted and (at_cap == n or caps[w["source"]] == 0)
        rows.append((w["name"], w["share"], w["cap"], has, n, t, d, t / corpus if corpus else 0.0, most, largest, bool(short), most <= caps[w["source"]], bool(short or abs(t - wanted) <= 2 * largest + 1)))
    return rows
