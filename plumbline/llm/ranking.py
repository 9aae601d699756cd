"""The best documents for each item of a query set, by groups of equal presence masks.

A first pass over the texts keeps, of each document, its length and how often it holds the
terms that items ask for; the numbers the weights need are sums over that table. A second
pass takes its documents in blocks. Each term has a bitmap of the documents of the block
that hold it; the bitmaps of an item's terms, turned over, give each document a mask of the
terms it holds, and documents of one mask form a group. No document of a group can score
more than the sum of the block's best parts of the mask's terms, so groups are evaluated by
descending bound until none can reach the item's ten best any more. A task carries the
scores of its best documents from block to block, and hands on ten rows for each item.

Items are taken in chunks of bounded size, and a chunk's terms go to every task; texts
never leave theirs, so a frequent term or an item that many documents match is no hot key.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.llm.names import unused
from plumbline.llm.words import blocks
from plumbline.sources.shared import written

# Letters, digits and everything beyond ASCII; A-Z are lower-cased before.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
# Bytes of text whose terms are counted at once.
PIECE_BYTES = 1 << 20
# Different terms of the items that are taken together, about.
CHUNK_TERMS = 1 << 16
# Cells of the matrix of terms and documents of a block.
CELLS = 1 << 22
# Documents whose scores are summed at once.
GROUP = 256
# Length counts so much against a document: 0 to 100.
LENGTH_PERCENT = 75
UNIT = 1_000_000_000


def term_counts(text: bytes) -> Counter:
    """How often a text, lower-cased, holds each term."""
    counts: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        if end < len(text):
            # A piece ends with a term.
            cut = TERM.match(text, end - 1)
            end = cut.end() if cut else end
        counts.update(TERM.findall(text, at, end))
        at = end
    return counts


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, texts in blocks(batch.column(1), lower=True):
            counts = [term_counts(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, last - first),
                    pa.array([list(c) for c in counts], pa.list_(pa.binary())),
                    pa.array([list(c.values()) for c in counts], pa.list_(pa.int64())),
                ],
                ["item", "terms", "times"],
            )


def _postings(known: dict[bytes, int]):
    """Length of each document, and places and counts of the known terms it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in blocks(batch.column(1), lower=True):
                lengths, ends, terms, times = [], [0], [], []
                for text in texts:
                    counts = term_counts(text)
                    lengths.append(counts.total())
                    held = sorted([(known[t], n) for t, n in counts.items() if t in known])
                    terms.extend([t for t, _ in held])
                    times.extend([n for _, n in held])
                    ends.append(len(terms))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(lengths, pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                        pa.ListArray.from_arrays(ends, pa.array(times, pa.int64())),
                    ],
                    ["id", "n", "terms", "times"],
                )

    return run


@dataclass
class _Item:
    number: int
    terms: np.ndarray
    weights: np.ndarray  # weight of each term, times its repeats in the item


class _Best:
    """Scores and ids of an item's best documents so far: descending, then by id."""

    def __init__(self, k: int):
        self.k = k
        self.scores = np.empty(0, np.int64)
        self.ids: list = []

    @property
    def bar(self) -> int:
        """What a document must reach to matter; as ids break ties, an equal score may."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        scores = np.concatenate([self.scores, scores])
        ids = self.ids + ids
        order = sorted(
            range(len(ids)),
            key=lambda i: (-scores[i], ids[i] is None, 0 if ids[i] is None else ids[i]),
        )[: self.k]
        self.scores, self.ids = scores[order], [ids[i] for i in order]


def _block_best(
    items: list[_Item], best: list[_Best], parts: np.ndarray, held: np.ndarray, ids: pa.Array
) -> None:
    """Adds the documents of one block. ``parts``: a term's part of each document's score
    before weights; ``held``: bitmaps of documents, one for each term."""
    top = parts.max(axis=1).astype(np.int64)
    n_docs = parts.shape[1]
    for item, so_far in zip(items, best):
        bounds = item.weights * top[item.terms]
        if bounds.sum() < so_far.bar:
            continue
        bits = np.unpackbits(held[item.terms], axis=1, count=n_docs)
        masks = np.packbits(bits, axis=0)
        masks = np.ascontiguousarray(masks.T)
        keys = masks.view(np.dtype((np.void, masks.shape[1]))).ravel()
        _, where, group = np.unique(keys, return_index=True, return_inverse=True)
        limits = bounds @ bits[:, where]
        order = np.argsort(-limits, kind="stable")
        members = np.argsort(group, kind="stable")
        ends = np.append(np.searchsorted(group[members], np.arange(len(where))), n_docs)
        waiting: list[np.ndarray] = []
        size = 0
        for place, g in enumerate(order.tolist()):
            if limits[g] < so_far.bar:
                break
            waiting.append(members[ends[g] : ends[g + 1]])
            size += len(waiting[-1])
            if size >= GROUP or place + 1 == len(order):
                _evaluate(item, so_far, parts, np.concatenate(waiting), ids)
                waiting, size = [], 0
        if waiting:
            _evaluate(item, so_far, parts, np.concatenate(waiting), ids)


def _evaluate(
    item: _Item, best: _Best, parts: np.ndarray, docs: np.ndarray, ids: pa.Array
) -> None:
    scores = item.weights @ parts[np.ix_(item.terms, docs)].astype(np.int64)
    fit = scores >= best.bar
    if fit.any():
        best.add(scores[fit], ids.take(pa.array(docs[fit])).to_pylist())


def _ranked(items: list[_Item], n_terms: int, n_docs: int, n_all: int, k: int):
    step = max(64, CELLS // max(1, n_terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in items]
        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field("id").type
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                terms, times = part.column("terms"), part.column("times")
                n = part.column("n").to_numpy()
                m = (100 - LENGTH_PERCENT) + (LENGTH_PERCENT * n * n_docs) // n_all
                doc = np.repeat(
                    np.arange(part.num_rows), terms.value_lengths().to_numpy()
                )
                term, tf = terms.flatten().to_numpy(), times.flatten().to_numpy()
                parts = np.zeros((n_terms, part.num_rows), np.int32)
                parts[term, doc] = (UNIT * tf) // (1000 * tf + 8 * m[doc])
                held = np.packbits(parts > 0, axis=1)
                _block_best(items, best, parts, held, part.column("id"))
        for item, so_far in zip(items, best):
            if so_far.ids:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item.number] * len(so_far.ids), pa.int64()),
                        pa.array(so_far.ids, kind),
                        pa.array(so_far.scores),
                    ],
                    ["number", "id", "score"],
                )

    return run


def _chunk(
    rows: list, docs: DataFrame, id_column: str, text_column: str, k: int
) -> DataFrame | None:
    """(number, id, score): candidates for the items of one chunk, from every task."""
    spark = docs.sparkSession
    known: dict[bytes, int] = {}
    for row in rows:
        for term in row["terms"]:
            known.setdefault(bytes(term), len(known))
    if not known:
        return None
    kind = dict(docs.dtypes)[id_column]
    postings = written(
        docs.select(col(id_column).alias("id"), col(text_column).alias("text")).mapInArrow(
            _postings(known), f"id {kind}, n bigint, terms array<int>, times array<bigint>"
        ),
        "postings",
    )
    n_docs, n_all = postings.agg(
        F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))
    ).first()
    if not n_docs:
        return None
    holding = dict(
        postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    )
    items = []
    for row in rows:
        at = np.array([known[bytes(t)] for t in row["terms"]], np.int64)
        weights = [
            times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding.get(t, 0) + 1)))
            for t, times in zip(at.tolist(), row["times"])
        ]
        items.append(_Item(row["number"], at, np.array(weights, np.int64)))
    items = [i for i in items if len(i.terms)]
    return postings.mapInArrow(
        _ranked(items, len(known), n_docs, n_all, k), f"number bigint, id {kind}, score bigint"
    )


def ranked(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    k: int = 10,
) -> DataFrame:
    """(item, rank, id, score): the ``k`` documents with the highest scores above 0 for each
    row of ``items``; equal scores by ascending id, NULL last.

    N documents hold a term, L is their length in terms together, n the length of one. With
    m = 25 + (75 * n * N) div L a document's score is the sum, over the terms of the item
    and their repeats, of floor(1000 * ln((2 * N + 2) / (2 * df + 1))) times
    (10^9 * tf) div (1000 * tf + 8 * m); all but the logarithm in 64-bit integers.

    NULL and empty texts have no terms: such a document is never found, such an item finds
    nothing. Repeated documents are found once for each row; repeated items, and items that
    share an id, get ranks of their own, one row of ``items`` at a time. Texts of any length
    are counted whole. Without rows on either side there are none; other columns, whatever
    their names, are not read.

    ``items`` with more than CHUNK_TERMS different terms, about, are taken in several
    chunks, with two passes over the documents each.
    """
    spark = docs.sparkSession
    kind, id_kind = dict(items.dtypes)[item_column], dict(docs.dtypes)[id_column]
    texts = items.select(col(item_column).alias("item"), col(item_text_column).alias("text"))
    asked = written(
        texts.mapInArrow(
            _terms, f"item {kind}, terms array<binary>, times array<bigint>"
        ).withColumn("number", F.monotonically_increasing_id()),
        "items",
    )
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_chunks = -(-total // CHUNK_TERMS)
    chunk = F.pmod(F.xxhash64("number"), F.lit(n_chunks)) if n_chunks > 1 else F.lit(0)
    found = None
    for c in range(n_chunks):
        rows = asked.where(chunk == c).select("number", "terms", "times").collect()
        part = _chunk(rows, docs, id_column, text_column, k)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame(
            [], f"`{item_column}` {kind}, rank int, `{id_column}` {id_kind}, score bigint"
        )
    order = Window.partitionBy("number").orderBy(
        F.desc("score"), F.asc_nulls_last("id")
    )
    rank = unused(found, "rank")
    best = found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)
    return best.join(asked.select("number", "item"), "number").select(
        F.col("item").alias(item_column),
        F.col(rank).alias("rank"),
        F.col("id").alias(id_column),
        "score",
    )
