"""URL filters: a trie over reversed host labels and path segments.

The rules are small (their size is checked), so their trie goes to every task; a url is
judged by one walk down its host labels and, from each, down its path segments.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col

DEFAULT = "allow"
# Rules up to which the trie is broadcast (about 1 kB each).
MAX_RULES = 1_000_000


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str = ""  # starts with a slash, or empty for every path

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


@dataclass
class _Path:
    below: dict[str, _Path] = field(default_factory=dict)  # whole segments
    rules: dict[str, Rule] = field(default_factory=dict)  # by the beginning of a segment


@dataclass
class _Host:
    below: dict[str, _Host] = field(default_factory=dict)
    every: Rule | None = None  # whatever the path
    paths: _Path | None = None


def _stronger(old: Rule | None, new: Rule) -> Rule:
    """Of an allow and a block for the same place, the block."""
    return old if old is not None and old.verdict == "block" else new


def build_trie(rules: Iterable[Rule]) -> _Host:
    root = _Host()
    for rule in rules:
        if rule.verdict not in ("allow", "block"):
            raise ValueError(f"neither allow nor block: {rule.verdict}")
        if rule.path and not rule.path.startswith("/"):
            raise ValueError(f"a path starts with a slash: {rule.path}")
        node = root
        for label in reversed(rule.host.split(".")):
            node = node.below.setdefault(label, _Host())
        if not rule.path:
            node.every = _stronger(node.every, rule)
            continue
        at = node.paths = node.paths or _Path()
        *whole, begun = rule.path[1:].split("/")
        for segment in whole:
            at = at.below.setdefault(segment, _Path())
        at.rules[begun] = _stronger(at.rules.get(begun), rule)
    return root


def _in_path(node: _Path, segments: list[str]) -> Rule | None:
    """The longest rule whose path the segments begin with."""
    best = None
    for segment in segments:
        # Longest beginning of this segment that a rule names.
        for n in range(len(segment), -1, -1) if node.rules else ():
            if segment[:n] in node.rules:
                best = node.rules[segment[:n]]
                break
        node = node.below.get(segment)
        if node is None:
            break
    return best


def longest_match(root: _Host, host: str, path: str) -> Rule | None:
    """The rule of the deepest host, there of the longest path, that fits."""
    best, node = None, root
    segments = path[1:].split("/") if path.startswith("/") else None
    for label in reversed(host.split(".")):
        node = node.below.get(label)
        if node is None:
            break
        best = node.every or best
        if node.paths is not None and segments is not None:
            best = _in_path(node.paths, segments) or best
    return best


def parts(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path of a url; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [k for k in map(rest.find, "/?#") if k >= 0]
    cut = min(ends, default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    ends = [k for k in map(rest.find, "?#") if k >= 0]
    lower = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}
    return host.translate(lower), rest[: min(ends, default=len(rest))]


def judged(
    pages: DataFrame,
    rules: Iterable[Rule] = RULES,
    default: str = DEFAULT,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict) of each row.

    A rule fits its host and all subdomains, if the path starts with its own. The rule with
    the most host labels wins, then the one with the longest path, and a block over an allow
    of the same place. Without a fitting rule ``rule`` is NULL and the verdict is the
    default, as for a url that is NULL, empty or without ``://``. A NULL id stays NULL,
    repeated rows are judged alike, no rows give none; other columns are not read.
    """
    rules = list(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules are too many to send to every task")
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        root = trie.value
        for urls in batches:
            rows = []
            for url in urls:
                host, path = parts(url)
                rule = longest_match(root, host, path) if host else None
                rows.append(
                    (host, path, rule and rule.text, rule.verdict if rule else default)
                )
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    kind = "host string, path string, rule string, verdict string"
    found = F.pandas_udf(judge, kind)(col(url_column).cast("string"))
    return pages.select(col(id_column).alias("_id"), found.alias("_f")).select(
        F.col("_id").alias(id_column), "_f.host", "_f.path", "_f.rule", "_f.verdict"
    )
