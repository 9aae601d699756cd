"""Quality of documents from a linear-chain conditional random field over their lines.

Every line with a word is good or bad. How far a line speaks for good hangs on features of
its own and of the lines before and after it; how labels follow one another is learned too.
Forward and backward products over the chain give each line's probability of being good,
and a document's quality is their mean, weighted by the lines' lengths.

Lines are described by how they are written (shares of kinds of characters, marks, repeated
words and windows, lengths), each feature cut into a few classes at fixed steps. Words
themselves, ids, languages and sources are not used.

Documents are labelled, lines are not: in training, a line takes the label of its document.
The likelihood and its gradient are sums over the training lines, taken by Spark in each
step; the driver sees one vector of fixed size for each of a fixed number of groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.llm.words import Words, blocks, mix, words_of
from plumbline.sources.shared import written

# Labelled documents that the field is fitted to at most; those with the lowest hashes.
TRAINING_DOCS = 16_384
# Groups whose sums are added in order, so that a fit is the same on any cluster.
GROUPS = 8
STEPS = 40
MEMORY = 8
PENALTY = 1e-3
# Words of a window that may occur again in the text.
WINDOW = 5
DECIMALS = 6

# Upper ends of the classes of each feature, as shares of its base.
_SHARES = (0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.6, 0.9)
_EDGES: dict[str, tuple[float, ...]] = {
    "symbols": _SHARES,  # of characters
    "marks": _SHARES,
    "separators": _SHARES,
    "upper": _SHARES,  # of ASCII letters
    "digits": _SHARES,
    "beyond_ascii": _SHARES,
    "tripled": _SHARES,
    "ends": (0.0, 0.03, 0.06, 0.1, 0.15, 0.25, 0.5, 0.9),  # terminal marks a word
    "commas": (0.0, 0.03, 0.06, 0.1, 0.15, 0.25, 0.5, 0.9),
    "links": (0.0, 0.02, 0.1, 0.3),
    "word_length": (1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 8.0, 10.0, 15.0, 30.0),
    "n_words": (1.0, 3.0, 6.0, 10.0, 20.0, 40.0, 80.0, 160.0, 640.0),
    "same_word": (0.0, 0.01, 0.05, 0.1, 0.2, 0.4, 0.7),  # as the word before
    "again": (0.0, 0.05, 0.1, 0.2, 0.4, 0.7, 0.95),  # in a window that occurs again
    "last": (0.5, 1.5, 2.5, 3.5, 4.5),  # kind of the last character
    "opening": (0.5, 1.5, 2.5, 3.5, 4.5),  # kind of the first character
}
FEATURES = tuple(_EDGES)
_SIZES = np.array([len(e) + 1 for e in _EDGES.values()])
_OFFSETS = np.concatenate([[0], np.cumsum(_SIZES)])
# One class more for a neighbour that isn't there.
WIDTH = int(_OFFSETS[-1]) + 1
N_WEIGHTS = 3 * WIDTH + 4


def _chars(members: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members.encode())] = True
    return table


_IS = {
    "symbols": _chars("#$%&*<>=_~^\\{}[]@+/"),
    "marks": _chars("!?"),
    "separators": _chars("|;"),
    "digits": _chars("0123456789"),
    "ends": _chars(".!?:"),
    "commas": _chars(","),
}
_UPPER = _chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _chars("abcdefghijklmnopqrstuvwxyz")
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False
# Kinds of a line's first and last characters.
_KIND = np.zeros(256)
_KIND[_LETTER] = 1
_KIND[_UPPER] = 2
_KIND[_IS["digits"]] = 3
_KIND[_IS["ends"]] = 4
_KIND[_IS["symbols"] | _IS["separators"]] = 5
_KIND[0x80:] = 1


@dataclass(frozen=True)
class Lines:
    """The lines with words of a block of texts, in order."""

    classes: np.ndarray  # a row of feature classes for each line
    lengths: np.ndarray  # code points
    owner: np.ndarray  # number of the line's text


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


def _again(words: Words, owner: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Which words stand in a window that an earlier or later one of the text equals."""
    n = len(one)
    covered = np.zeros(n + 1, np.int64)
    first = np.arange(max(0, n - WINDOW + 1))
    first = first[owner[first] == owner[first + WINDOW - 1]]
    keys = mix(owner[first].astype(np.uint64))
    for k in range(WINDOW):
        keys = mix(keys + one[first + k])
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    repeated = np.zeros(len(first), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    np.add.at(covered, first[repeated], 1)
    np.add.at(covered, first[repeated] + WINDOW, -1)
    return np.cumsum(covered[:n]) > 0


def lines_of(texts: list[bytes]) -> Lines:
    words = words_of(texts)
    data = words.data
    if not len(words.starts):
        none = np.empty(0, np.int64)
        return Lines(np.empty((0, len(FEATURES)), np.int16), none, none)
    text_of = np.repeat(np.arange(len(texts)), words.counts)
    # Line feeds, and the ends of texts, close lines.
    closes = data == 10
    closes[words.edges[1:] - 1] = True
    ends = np.flatnonzero(closes)
    line_of = np.searchsorted(ends, words.starts)
    held, first = np.unique(line_of, return_index=True)
    last = np.append(first[1:], len(line_of)) - 1
    starts, ends = words.starts[first], words.ends[last]
    n_words = last - first + 1
    chars = np.maximum(1, _sums(_LEAD[data], starts, ends))
    letters = np.maximum(1, _sums(_LETTER[data], starts, ends))
    values = {k: _sums(v[data], starts, ends) / chars for k, v in _IS.items()}
    for k in ("ends", "commas"):
        values[k] = values[k] * chars / n_words
    values["upper"] = _sums(_UPPER[data], starts, ends) / letters
    values["beyond_ascii"] = _sums(data >= 0xC0, starts, ends) / chars
    tripled = np.zeros(len(data), bool)
    tripled[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    values["tripled"] = _sums(tripled, starts, ends) / chars
    link = np.zeros(len(data), bool)
    link[2:] = (data[2:] == 47) & (data[1:-1] == 47) & (data[:-2] == 58)
    values["links"] = _sums(link | (data == 64), starts, ends) / n_words
    in_words = _sums(_LEAD[data], words.starts, words.ends)
    total = np.concatenate([[0], np.cumsum(in_words)])
    values["word_length"] = (total[last + 1] - total[first]) / n_words
    values["n_words"] = n_words
    one = words.hashes()
    same = np.zeros(len(one), bool)
    same[1:] = (one[1:] == one[:-1]) & (text_of[1:] == text_of[:-1])
    values["same_word"] = _sums(same, first, last + 1) / n_words
    values["again"] = _sums(_again(words, text_of, one), first, last + 1) / n_words
    values["last"], values["opening"] = _KIND[data[ends - 1]], _KIND[data[starts]]
    classes = np.stack(
        [
            np.searchsorted(_EDGES[k], values[k], "left").astype(np.int16) + _OFFSETS[i]
            for i, k in enumerate(FEATURES)
        ],
        axis=1,
    ).astype(np.int16)
    lengths = _sums(_LEAD[data], starts, ends)
    return Lines(classes.reshape(-1, len(FEATURES)), lengths, text_of[first])


def _neighbours(lines: Lines) -> list[np.ndarray]:
    """Features of each line, of the one before and of the one after it."""
    missing = np.full((1, len(FEATURES)), WIDTH - 1, np.int16)
    new = np.append(True, lines.owner[1:] != lines.owner[:-1])
    before = np.concatenate([missing, lines.classes[:-1]])
    after = np.concatenate([lines.classes[1:], missing])
    before[new] = WIDTH - 1
    after[np.append(new[1:], True)] = WIDTH - 1
    return [lines.classes, before, after]


def _products(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products m[0] @ ... @ m[t] for each t, scaled to a largest entry of 1, and the logs
    of the scales. Works in steps of halves, so a long chain needs no loop over its lines."""
    scale = m.max(axis=(1, 2))
    m, logs = m / scale[:, None, None], np.log(scale)
    n = len(m)
    if n == 1:
        return m, logs
    half, half_logs = _products(m[0 : n - 1 : 2] @ m[1:n:2])
    half_logs = half_logs + np.cumsum(logs[0 : n - 1 : 2] + logs[1:n:2])
    out, out_logs = np.empty_like(m), np.empty(n)
    out[0], out_logs[0] = m[0], logs[0]
    out[1::2], out_logs[1::2] = half, half_logs
    rest = len(out[2::2])
    out[2::2] = half[:rest] @ m[2::2]
    out_logs[2::2] = half_logs[:rest] + logs[2::2]
    top = out.max(axis=(1, 2))
    return out / top[:, None, None], out_logs + np.log(top)


@dataclass(frozen=True)
class _Chain:
    """Probabilities of the labels of all lines of a block; 1 is good."""

    good: np.ndarray
    steps: np.ndarray  # sums over the block of P(label before, label)
    log_z: float
    potentials: np.ndarray
    parts: list[np.ndarray]
    new: np.ndarray


def _chain(lines: Lines, weights: np.ndarray) -> _Chain:
    """Forward and backward over the lines of all texts of a block at once."""
    parts = _neighbours(lines)
    speaks = np.zeros(len(lines.owner))
    for k, part in enumerate(parts):
        speaks += weights[k * WIDTH : (k + 1) * WIDTH][part].sum(axis=1)
    speaks = np.clip(speaks, -200, 200)
    follow = weights[-4:].reshape(2, 2)
    new = np.append(True, lines.owner[1:] != lines.owner[:-1])
    # The first line of a text follows any label alike, which parts it from the text before.
    potentials = np.where(new[:, None, None], 0.0, follow[None])
    potentials = potentials + np.stack([np.zeros_like(speaks), speaks], axis=1)[:, None, :]
    m = np.exp(potentials)
    ahead, logs = _products(m)
    forward = ahead.sum(axis=1)
    forward /= forward.sum(axis=1, keepdims=True)
    after = np.ones_like(m)
    after[:-1] = np.where(new[1:, None, None], 1.0, m[1:])
    behind, _ = _products(after[::-1].transpose(0, 2, 1))
    backward = behind[::-1].sum(axis=1)
    backward /= backward.sum(axis=1, keepdims=True)
    both = forward * backward
    good = both[:, 1] / both.sum(axis=1)
    at = np.flatnonzero(~new)
    pairs = forward[at - 1][:, :, None] * m[at] * backward[at][:, None, :]
    pairs /= pairs.sum(axis=(1, 2), keepdims=True)
    log_z = float(logs[-1] + np.log(ahead[-1].sum()) - np.log(2))
    return _Chain(good, pairs.sum(axis=0), log_z, potentials, parts, new)


def loss(lines: Lines, labels: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of the labels (0 or 1) of the lines, and its gradient."""
    if not len(labels):
        return 0.0, np.zeros(N_WEIGHTS)
    chain = _chain(lines, weights)
    before = np.append(0, labels[:-1])
    path = chain.potentials[np.arange(len(labels)), before, labels].sum()
    slope = np.zeros(N_WEIGHTS)
    wrong = chain.good - labels
    for k, part in enumerate(chain.parts):
        for column in part.T:
            slope[k * WIDTH : (k + 1) * WIDTH] += np.bincount(column, wrong, WIDTH)
    at = ~chain.new
    seen = np.bincount(before[at] * 2 + labels[at], minlength=4)
    slope[-4:] = chain.steps.ravel() - seen
    return chain.log_z - float(path), slope


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature classes of the lines of labelled texts."""
    for batch in batches:
        for first, last, texts in blocks(batch.column(3)):
            lines = lines_of(texts)
            ends = np.searchsorted(lines.owner, np.arange(last - first + 1)) * len(FEATURES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).slice(first, last - first) for k in range(3)]
                + [
                    pa.ListArray.from_arrays(
                        pa.array(ends.astype(np.int32)), pa.array(lines.classes.ravel())
                    )
                ],
                ["part", "place", "label", "classes"],
            )


def _slopes(weights: np.ndarray):
    """Loss and gradient of each group; a group's rows arrive together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            parts = batch.column("part").to_numpy()
            for part in np.unique(parts).tolist():
                rows = batch.filter(pa.array(parts == part))
                held = rows.column("classes")
                counts = held.value_lengths().to_numpy() // len(FEATURES)
                owner = np.repeat(np.arange(len(counts)), counts)
                classes = held.flatten().to_numpy().reshape(-1, len(FEATURES))
                labels = rows.column("label").to_numpy()[owner].astype(np.int64)
                value, slope = loss(Lines(classes, counts, owner), labels, weights)
                both = np.append(slope, [value, len(labels)])
                sums[part] = sums.get(part, 0) + both
        for part, both in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([both.tolist()])], ["part", "sums"]
            )

    return run


class _Descent:
    """Limited-memory quasi-Newton steps with halved step lengths."""

    def __init__(self, size: int):
        self.weights = np.zeros(size)
        self.value, self.slope = np.inf, np.zeros(size)
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []

    def direction(self) -> np.ndarray:
        way, shares = self.slope.copy(), []
        for s, y in reversed(self.steps):
            shares.append((s @ way) / (s @ y))
            way -= shares[-1] * y
        if self.steps:
            s, y = self.steps[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), share in zip(self.steps, reversed(shares)):
            way += (share - (y @ way) / (s @ y)) * s
        return -way

    def move(self, weights: np.ndarray, value: float, slope: np.ndarray) -> None:
        s, y = weights - self.weights, slope - self.slope
        if np.isfinite(self.value) and s @ y > 1e-12:
            self.steps = [*self.steps[1 - MEMORY :], (s, y)]
        self.weights, self.value, self.slope = weights, value, slope


def fit(
    docs: DataFrame,
    marks: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    max_docs: int = TRAINING_DOCS,
    steps: int = STEPS,
) -> np.ndarray:
    """Weights of the field, from ``marks`` (id, label), labels being 0 or 1.

    Takes the ``max_docs`` marks whose ids hash lowest, with the whole texts of their
    documents; rows equal in id and text count once. The marks go to the scan of the
    documents, so no text leaves its task. Without rows all weights are 0, so every line is
    good with probability one half.
    """
    marks = marks.select("id", "label", F.xxhash64("id").alias("place"))
    chosen = marks.distinct().orderBy("place", "id", "label").limit(max_docs)
    texts = docs.select(col(id_column).alias("id"), col(text_column).alias("text"))
    part = F.pmod("place", F.lit(GROUPS)).cast("bigint").alias("part")
    described = written(
        texts.where(F.col("text").isNotNull())
        .join(F.broadcast(chosen), "id")
        .select(part, "place", "label", "text")
        .mapInArrow(
            _described, "part bigint, place bigint, label int, classes array<smallint>"
        )
        .distinct()
        .repartition(GROUPS, "part")
        .sortWithinPartitions("part", "place", "label", "classes"),
        "lines",
    )

    def loss_at(weights: np.ndarray) -> tuple[float, np.ndarray]:
        sums = described.mapInArrow(_slopes(weights), "part bigint, sums array<double>").collect()
        total = sum(
            (np.array(r["sums"]) for r in sorted(sums, key=lambda r: r["part"])),
            np.zeros(N_WEIGHTS + 2),
        )
        n = max(1.0, total[-1])
        value = total[-2] / n + PENALTY / 2 * float(weights @ weights)
        return value, total[:-2] / n + PENALTY * weights

    search = _Descent(N_WEIGHTS)
    search.move(search.weights, *loss_at(search.weights))
    for _ in range(steps):
        way = search.direction()
        drop = float(way @ search.slope)
        if drop > -1e-7:
            break
        length = 1.0 if search.steps else 1 / max(1.0, float(np.abs(search.slope).sum()))
        for _ in range(12):
            weights = search.weights + length * way
            value, slope = loss_at(weights)
            if value <= search.value + 1e-4 * length * drop:
                break
            length /= 2
        else:
            break
        search.move(weights, value, slope)
    return search.weights


def _scores(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A text without words is one line without any feature.
        blank = float(1 / (1 + np.exp(-np.clip(3 * len(FEATURES) * weights[WIDTH - 1], -30, 30))))
        for batch in batches:
            for first, last, texts in blocks(batch.column(1)):
                lines = lines_of(texts)
                good = _chain(lines, weights).good if len(lines.owner) else np.empty(0)
                n = last - first
                length = np.bincount(lines.owner, lines.lengths, n)
                sums = np.bincount(lines.owner, lines.lengths * good, n)
                score = np.where(length > 0, sums / np.maximum(length, 1), blank)
                ends = np.searchsorted(lines.owner, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        pa.array(np.round(score, DECIMALS)),
                        pa.ListArray.from_arrays(
                            pa.array(ends), pa.array(np.round(good, DECIMALS))
                        ),
                    ],
                    ["id", "score", "good"],
                )

    return run


def scored(
    docs: DataFrame, weights: np.ndarray, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, score, good) of each row: quality from 0 to 1, and for each line with a word its
    probability of being good; a line is labelled good from one half on.

    One projection of the scan; whole texts of any length. A NULL or empty text, or one
    without words, has no lines and the score of a line without features. Repeated rows get
    equal scores, rows without id stay, no rows give no rows. Other columns are not read.
    """
    return docs.select(col(id_column).alias("id"), col(text_column).alias("text")).mapInArrow(
        _scores(weights), f"id {dict(docs.dtypes)[id_column]}, score double, good array<double>"
    ).withColumnRenamed("id", id_column)


def held_out(id_column: Column, remainder: int = 2) -> Column:
    """Rows that training must not see: a quarter, by the CRC-32 of the id as text. A row
    without id is held out too."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == remainder, F.lit(True))


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    max_docs: int = TRAINING_DOCS,
) -> DataFrame:
    """(id, score, good) of all documents, by a field fitted to labelled ones that are not
    held out. Documents labelled both ways, or several times, count once for each label."""
    marks = labels.select(
        col(id_column).alias("id"), col(label_column).cast("int").alias("label")
    ).where(F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    weights = fit(docs, marks, id_column, text_column, max_docs)
    return scored(docs, weights, id_column, text_column)
