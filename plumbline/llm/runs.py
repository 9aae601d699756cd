"""Periodic runs of words: stretches in which every word repeats the one a period before.

The words of a block of texts become one sequence of numbers, a separate mark around each
text. Recompression turns it into a run-length grammar: equal neighbours become one symbol
with a count, then symbols are split into left and right ones and every left one followed
by a right one becomes a pair, and so on until no symbol occurs twice. How parts are cut
hangs on their content alone, so the longest common extension of two places follows from
one comparison for each level on the way up and one on the way down.

A run of period q and exponent e keeps word x equal to word x + q over (e - 1) * q places,
so one of the places 0, (e - 1) * q, 2 * (e - 1) * q, ... lies in it: n / q candidates for
each period, n log n in all. Extensions to both sides give the run itself.

Memory is about 100 bytes for each word of a block; a block has about 1 MB of text, or one
longer text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.llm.words import Words, blocks, mix, words_of

MIN_EXPONENT = 4
MIN_LENGTH = 6
# Candidates, and words of an output text, handled at once.
CANDIDATES = 1 << 18
PIECE_WORDS = 1 << 16


@dataclass(frozen=True)
class _Level:
    """A sequence of symbols and how it is cut into the symbols of the next level."""

    symbols: np.ndarray
    parent: np.ndarray  # place in the next level
    first: np.ndarray  # first place of each symbol of the next level, and the end
    right: np.ndarray | None  # which places hold right symbols; None: cut into equal ones


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, int]:
    values, numbers = np.unique(keys, return_inverse=True)
    return numbers.astype(np.int64), len(values)


def _level(symbols: np.ndarray, starts: np.ndarray, right: np.ndarray | None) -> _Level:
    """``starts`` tells which places begin a symbol of the next level."""
    first = np.append(np.flatnonzero(starts), len(symbols)).astype(np.int32)
    return _Level(symbols, (np.cumsum(starts) - 1).astype(np.int32), first, right)


class Grammar:
    """Run-length grammar of a sequence whose first and last symbols occur nowhere else."""

    def __init__(self, symbols: np.ndarray):
        self.levels: list[_Level] = []
        symbols, kinds = _numbered(symbols)
        salt = 0
        while kinds < len(symbols):
            starts = np.append(True, symbols[1:] != symbols[:-1])
            if not starts.all():
                self.levels.append(_level(symbols, starts, None))
                first = self.levels[-1].first
                counts = np.diff(first)
                symbols, kinds = _numbered(
                    symbols[first[:-1]] * (int(counts.max()) + 1) + counts
                )
            salt += 1
            right = self._sides(symbols, kinds, salt)
            starts = np.append(True, ~(right[1:] & ~right[:-1]))
            if starts.all():
                continue
            self.levels.append(_level(symbols, starts, right))
            heads = self.levels[-1].first[:-1]
            paired = np.diff(self.levels[-1].first) == 2
            second = np.where(paired, symbols[np.minimum(heads + 1, len(symbols) - 1)] + 1, 0)
            symbols, kinds = _numbered(symbols[heads] * (kinds + 1) + second)
        self.top = symbols

    @staticmethod
    def _sides(symbols: np.ndarray, kinds: int, salt: int) -> np.ndarray:
        """Which places hold right symbols; the way round that makes more pairs."""
        coin = mix(np.arange(kinds, dtype=np.uint64) + np.uint64(salt << 40)) & np.uint64(1)
        right = (coin == 1)[symbols]
        up = np.count_nonzero(right[1:] & ~right[:-1])
        down = np.count_nonzero(~right[1:] & right[:-1])
        return right if up >= down else ~right

    def _symbols(self, level: int) -> np.ndarray:
        return self.levels[level].symbols if level < len(self.levels) else self.top

    def extension(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """How many symbols from places ``a`` and ``b`` on are equal; ``step`` 1 looks
        forward, -1 backward, the places included. No place may be asked with itself."""
        at = np.stack([a, b]).astype(np.int64)
        ended = np.full(len(a), -1, np.int64)
        live = np.arange(len(a))
        for k, level in enumerate(self.levels):
            x = at[:, live]
            same = level.symbols[x[0]] == level.symbols[x[1]]
            ended[live[~same]] = k
            live, x = live[same], x[:, same]
            if not len(live):
                break
            if level.right is None:
                heads = level.parent[x]
                left = level.first[heads + 1] - x if step > 0 else x - level.first[heads] + 1
                x = x + step * left.min(axis=0)
                even = left[0] == left[1]
                at[:, live] = x
                ended[live[~even]] = k
                live, x = live[even], x[:, even]
            else:
                # Inside a pair, or next to one: one more symbol leads to a border.
                x = x + step * (level.right[x[0]] == (step > 0))
            at[:, live] = level.parent[x]
        ended[live[ended[live] < 0]] = len(self.levels)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            below = np.flatnonzero(ended > k)
            if not len(below):
                continue
            whole = at[:, below]
            x = level.first[whole] if step > 0 else level.first[whole + 1] - 1
            x = x.astype(np.int64)
            same = level.symbols[x[0]] == level.symbols[x[1]]
            if level.right is None:
                common = (level.first[whole + 1] - level.first[whole]).min(axis=0)
            else:
                common = 1
            at[:, below] = x + step * same * common
        return (at[0] - a) * step


def _candidates(
    counts: np.ndarray, offsets: np.ndarray, step: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods): every ``step * period`` words of each text, for all periods that
    its length allows."""
    periods = counts // (step + 1)
    owner = np.repeat(np.arange(len(counts)), periods)
    before = np.cumsum(periods) - periods
    period = np.arange(len(owner)) - np.repeat(before, periods) + 1
    sizes = -(-(counts[owner] - period) // (step * period))
    ends = np.cumsum(sizes)
    first = 0
    while first < len(owner):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + CANDIDATES, "right")))
        n = sizes[first:last]
        q = np.repeat(period[first:last], n)
        turn = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(offsets[owner[first:last]], n) + turn * step * q, q
        first = last


def runs_of(
    sequences: list[np.ndarray],
    min_exponent: int = MIN_EXPONENT,
    min_length: int = MIN_LENGTH,
) -> list[np.ndarray]:
    """Rows (start, length, period) by start and period, for each sequence of numbers.

    A run is as long as its smallest period allows on both sides, has at least
    ``min_length`` members and ``min_exponent`` periods.
    """
    step = min_exponent - 1
    if step < 1:
        raise ValueError("runs need an exponent of 2 or more")
    counts = np.array([len(s) for s in sequences], np.int64)
    offsets = np.cumsum(counts + 1) - counts
    marks = np.append(offsets - 1, offsets[-1] + counts[-1]) if len(counts) else np.zeros(1, int)
    symbols = np.zeros(int(marks[-1]) + 1, np.int64)
    for k, s in enumerate(sequences):
        symbols[offsets[k] : offsets[k] + counts[k]] = s
    symbols[marks] = int(symbols.max()) + 1 + np.arange(len(marks))
    grammar = Grammar(symbols)
    found = [np.empty((0, 3), np.int64)]
    for place, period in _candidates(counts, offsets, step):
        hit = symbols[place] == symbols[place + period]
        place, period = place[hit], period[hit]
        ahead = grammar.extension(place, place + period, 1)
        # The place itself is equal, so it counts on both sides.
        back = grammar.extension(place, place + period, -1) - 1
        length = period + ahead + back
        long = length >= np.maximum(min_length, min_exponent * period)
        rows = np.stack([place - back, length, period], axis=1)[long]
        found.append(np.unique(rows, axis=0))
    rows = np.concatenate(found)
    rows = rows[np.lexsort(rows.T[::-1])]
    # A multiple of the smallest period gives the same stretch.
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], offsets)
    parts = np.split(rows, cuts[1:]) if len(counts) else []
    return [p - np.array([[o, 0, 0]]) for p, o in zip(parts, offsets)]


def _numbers(words: Words, data: bytes) -> np.ndarray:
    """A number for each word, equal for equal words."""
    known: dict[bytes, int] = {}
    out = np.empty(len(words.starts), np.int64)
    for k in range(0, len(out), PIECE_WORDS):
        spans = zip(
            words.starts[k : k + PIECE_WORDS].tolist(), words.ends[k : k + PIECE_WORDS].tolist()
        )
        out[k : k + PIECE_WORDS] = [known.setdefault(data[a:b], len(known)) for a, b in spans]
    return out


def _collapsed(words: Words, data: bytes, first: int, last: int, runs: np.ndarray) -> bytes:
    """The words of one text outside what runs repeat, joined by spaces."""
    kept = np.zeros(last - first + 1, np.int64)
    np.add.at(kept, runs[:, 0] + runs[:, 2], 1)
    np.add.at(kept, runs[:, 0] + runs[:, 1], -1)
    at = first + np.flatnonzero(np.cumsum(kept[:-1]) == 0)
    parts = []
    for k in range(0, len(at), PIECE_WORDS):
        piece = at[k : k + PIECE_WORDS]
        spans = zip(words.starts[piece].tolist(), words.ends[piece].tolist())
        parts.append(b" ".join([data[a:b] for a, b in spans]))
    return b" ".join(parts)


_RUNS = pa.list_(
    pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
)


def _found(min_exponent: int, min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in blocks(batch.column(1)):
                words = words_of(texts)
                data = words.data.tobytes()
                bounds = words.bounds.tolist()
                numbers = _numbers(words, data)
                parts = [numbers[a:b] for a, b in zip(bounds, bounds[1:])]
                runs = runs_of(parts, min_exponent, min_length)
                sizes = np.cumsum([0] + [len(r) for r in runs]).astype(np.int32)
                fields = np.concatenate(runs).T if len(runs) else np.empty((3, 0), np.int64)
                rows = pa.StructArray.from_arrays(
                    [pa.array(np.ascontiguousarray(f)) for f in fields],
                    fields=list(_RUNS.value_type),
                )
                left = [
                    _collapsed(words, data, a, b, r)
                    for a, b, r in zip(bounds, bounds[1:], runs)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(words.counts),
                        pa.ListArray.from_arrays(pa.array(sizes), rows, type=_RUNS),
                        pa.array(left, pa.binary()).cast(pa.string()),
                    ],
                    ["id", "n_words", "runs", "collapsed"],
                )

    return run


def periodic_runs(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_exponent: int = MIN_EXPONENT,
    min_length: int = MIN_LENGTH,
) -> DataFrame:
    """(id, n_words, runs, collapsed) of each row.

    ``runs`` has (start, length, period), in words, of every maximal stretch of at least
    ``min_exponent`` of its smallest periods and ``min_length`` words, by start and period.
    ``collapsed`` is the text without the words that a run repeats, joined by one space.

    One projection of the scan: rows are independent, and repeated rows give equal results.
    A NULL or empty text has no words, no runs and an empty ``collapsed``. A text of any
    length is handled whole, in one task. Rows without id stay. No rows give no rows; other
    columns, whatever their names, are not read.
    """
    return docs.select(col(id_column).alias("id"), col(text_column).alias("text")).mapInArrow(
        _found(min_exponent, min_length),
        f"id {dict(docs.dtypes)[id_column]}, n_words bigint, "
        "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string",
    ).withColumnRenamed("id", id_column)


def looped(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text): a tenth of the texts, chosen by id, end in a loop.

    With h the CRC-32 of the id as text and g = h div 10, texts with h % 10 = 0 repeat the
    p words from word a = g % n on to their end, p = 1 + (n - a) div (3 + g % 8). Rows
    without id, and texts without words, stay as they are.
    """
    h = F.crc32(col(id_column).cast("string"))
    words = F.filter(F.split(col(text_column), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    rows = docs.select(
        col(id_column).alias("id"),
        col(text_column).alias("text"),
        F.when(h % 10 == 0, words).alias("words"),
        F.floor(h / 10).alias("g"),
    )
    n = F.size("words").cast("bigint")
    rows = rows.select("*", F.when(n > 0, F.col("g") % n).alias("a"), n.alias("n"))
    rows = rows.select(
        "*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).alias("p")
    )
    at = lambda i: F.when(i < F.col("a"), i).otherwise(
        F.col("a") + (i - F.col("a")) % F.col("p")
    )
    looped_text = F.array_join(
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1),
            lambda i: F.get(F.col("words"), at(i).cast("int")),
        ),
        " ",
    )
    return rows.select(
        F.col("id").alias(id_column),
        F.when(F.col("a").isNotNull(), looped_text).otherwise(F.col("text")).alias(text_column),
    )
