"""Quality of documents: counts over whole texts, and line-first cleaning.

Every line is judged by rules on punctuation, navigation and boilerplate. Failed lines
are removed; a document that loses too much of its text that way is rejected.
"""

from __future__ import annotations

import re
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.llm.names import unused
from plumbline.llm.words import Words, blocks, mix, words_of

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
# A document that loses more than this share of its characters in lines is rejected.
MAX_LOST_PERCENT = 50

SYMBOLS = "#*$%&|<>"
# A line may hold one such character for every four words, or marks for every three. The
# words of boilerplate phrases may be a quarter of it.
LINE_SYMBOLS = r"[#*$%&<>=~^_{}\\]"
LINE_MARKS = r"[!?]"
SEPARATORS = r"[|»›·•→]"
CLOSED = r"[.!?…。:;,\"')\]»”][\x20\x09-\x0D]*$"
MENU_WORDS = 3
BOILERPLATE = (
    "all rights reserved",
    "accept (all )?cookies",
    "we use cookies",
    "cookie (policy|settings)",
    "privacy policy",
    "terms (of use|of service|and conditions)",
    "enable javascript",
    "sign up for our newsletter",
    "subscribe to our",
    "click here to",
    "skip to (main )?content",
    "lorem ipsum",
    "share (this )?on (facebook|twitter)",
)

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(LINE_SYMBOLS)
_MARK = re.compile(LINE_MARKS)
_SEPARATOR = re.compile(SEPARATORS)
_CLOSED = re.compile(CLOSED)
_BOILERPLATE = re.compile("|".join(BOILERPLATE), re.IGNORECASE | re.ASCII)

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True


def line_fails(line: str, words: list[str]) -> bool:
    """Do the rules reject a line that has words?"""
    n_words = len(words)
    symbols, marks = len(_SYMBOL.findall(line)), len(_MARK.findall(line))
    if symbols * 4 > n_words or (marks >= 3 and marks * 3 > n_words):
        return True  # punctuation
    separators = len(_SEPARATOR.findall(line))
    if separators >= 2 and separators * 4 > n_words:
        return True  # navigation: a bar of links
    if n_words <= MENU_WORDS and not _CLOSED.search(line):
        return True  # navigation: an entry of a menu
    if sum(map(eq, words, words[1:])) * 4 > n_words:
        return True  # boilerplate: words said over and over
    said = sum(len(x.group().split()) for x in _BOILERPLATE.finditer(line))
    return said * 4 > n_words  # boilerplate: phrases


def cleaned(text: str | None) -> tuple[int, int, int, str | None]:
    """(lines equal to an earlier one, characters in lines, characters lost, the text
    without failed lines or None if it has none). Lines without words stay and count
    as nothing."""
    repeated = total = lost = 0
    seen, keep = set(), []
    for line in (text or "").split("\n"):
        words = _WORD.findall(line)
        if not words:
            keep.append(line)
            continue
        repeated += line in seen
        seen.add(line)
        total += len(line)
        if line_fails(line, words):
            lost += len(line)
        else:
            keep.append(line)
    return repeated, total, lost, "\n".join(keep) if lost else None


def _per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def _repeated_words(words: Words) -> np.ndarray:
    """Words of each text inside a window of WINDOW words that occurs again in it."""
    n = len(words.starts)
    owner = np.repeat(np.arange(len(words.counts)), words.counts)
    covered = np.zeros(n + 1, np.int64)
    if n >= WINDOW:
        one = words.hashes()
        first = np.arange(n - WINDOW + 1)
        first = first[owner[first] == owner[first + WINDOW - 1]]
        runs = one[first]
        for k in range(1, WINDOW):
            runs = mix(runs * np.uint64(0xD6E8FEB86659FD93) + one[first + k])
        # The same words in another text are another run.
        runs = mix(runs + owner[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(runs, kind="stable")
        same = runs[order[1:]] == runs[order[:-1]]
        again = np.zeros(len(runs), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        np.add.at(covered, first[again], 1)
        np.add.at(covered, first[again] + WINDOW, -1)
    return _per_text(np.cumsum(covered[:n]) > 0, words.bounds)


_COUNTS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, line_chars bigint, lost_chars bigint, cleaned string"
)


def _counts(texts: list[bytes]) -> list[pa.Array]:
    words = words_of(texts)
    lead = (words.data & 0xC0) != 0x80
    spaces = (words.data == 32) | ((words.data >= 9) & (words.data <= 13))
    lines = [cleaned(t.decode("utf-8", "surrogatepass")) for t in texts]
    return [
        pa.array(words.counts),
        pa.array(_per_text(lead & ~spaces, words.edges)),
        pa.array(_per_text(_IS_SYMBOL[words.data], words.edges)),
        pa.array([x[0] for x in lines], pa.int64()),
        pa.array(_repeated_words(words)),
        pa.array([x[1] for x in lines], pa.int64()),
        pa.array([x[2] for x in lines], pa.int64()),
        pa.array([x[3] for x in lines], pa.string()),
    ]


def counts_of(texts: pa.Array) -> pa.Array:
    """The counts of each text, and the text without its failed lines."""
    names = [c.split()[0] for c in _COUNTS.split(", ")]
    kinds = [pa.int64()] * (len(names) - 1) + [pa.string()]
    parts = [_counts(data) for _, _, data in blocks(texts)]
    columns = [
        pa.concat_arrays([p[k] for p in parts]) if parts else pa.array([], kinds[k])
        for k in range(len(names))
    ]
    return pa.StructArray.from_arrays(columns, names)


def judged(
    docs: DataFrame,
    text_column: str = "text",
    name: str = "quality",
    max_lost_percent: int = MAX_LOST_PERCENT,
) -> DataFrame:
    """The rows with a struct column ``name``: counts of the whole text, ``base_failed``,
    ``kept`` and ``cleaned``, the text without its failed lines (NULL if none failed).

    NULL counts as an empty text, which has too few words and fails. Repeated rows are
    judged alike; no rows give no rows; other columns stay as they are. ``name`` must not
    be a column already (see ``names.unused``).
    """
    raw = unused(docs, "counts")
    c = F.col(raw)
    failed = (c["n_words"] < MIN_WORDS) | (
        c["n_repeat_words"] * 100 > c["n_words"] * MAX_REPEAT_PERCENT
    )
    lost = c["lost_chars"] * 100 > c["line_chars"] * max_lost_percent
    fields = [x.split()[0] for x in _COUNTS.split(", ")]
    # Not to be run again where its result is filtered.
    counts = F.arrow_udf(counts_of, _COUNTS).asNondeterministic()
    return docs.withColumn(raw, counts(col(text_column))).select(
        *[col(x) for x in docs.columns],
        F.struct(
            *[c[x].alias(x) for x in fields],
            failed.alias("base_failed"),
            (~failed & ~lost).alias("kept"),
        ).alias(name),
    )


def keep_good(
    docs: DataFrame,
    text_column: str = "text",
    chars_column: str = "n_chars",
    max_lost_percent: int = MAX_LOST_PERCENT,
) -> DataFrame:
    """The documents that pass, with the columns they came with and without their failed
    lines; a column of text lengths follows the text."""
    name = unused(docs, "quality")
    rows = judged(docs, text_column, name, max_lost_percent)
    text = F.coalesce(F.col(name)["cleaned"], col(text_column))
    new = {text_column: text}
    if chars_column in docs.columns:
        kind = dict(docs.dtypes)[chars_column]
        changed = F.col(name)["cleaned"].isNotNull()
        new[chars_column] = F.when(changed, F.length(text).cast(kind)).otherwise(col(chars_column))
    return rows.where(F.col(name)["kept"]).select(
        *[new[c].alias(c) if c in new else col(c) for c in docs.columns]
    )
