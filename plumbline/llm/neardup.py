"""Near-duplicate documents by b-bit MinHash.

Each text becomes its set of word shingles, the set its minima under many hash
functions. Minima in bands give candidates; four low bits of every minimum, packed into
64-bit words, give an estimate of the similarity by bit counts; full sets confirm.

Only distinct sets are compared. Inside a bucket of a band, members meet the smallest
member first. Members that this leaves unconnected meet the others of their bucket in
blocks of bounded size, where bit counts rule out nearly all pairs that are not links
before any row is made of them. Every pair of a bucket is connected or ruled out in the
end, so nothing is lost beside what no band brings together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.llm.links import components
from plumbline.llm.names import unused
from plumbline.llm.words import blocks, mix, shingle_sets
from plumbline.sources.shared import counted, written

# Two sets of similarity 0.8 share none of 40 bands of 5 minima once in eight million.
BANDS, BAND_ROWS = 40, 5
MINIMA = BANDS * BAND_ROWS
LOW_BITS = 4
PER_WORD = 64 // LOW_BITS
N_WORDS = -(-MINIMA // PER_WORD)

# Share of linked documents: 100 * intersection >= PERCENT * union.
PERCENT = 80
# Pairs of bitmaps compared at once.
PAIRS = 1 << 14
# An estimate this many standard deviations too low rules a pair out.
DEVIATIONS = 6
# Bucket members per block.
BLOCK = 256
# Bits of a set's bitmap for each of its shingles, rounded up to a power of two.
BITMAP_BITS = 8

# Classes of equal sets with more rows than this, and than one in so many of all rows, go
# to the rows by broadcast: MOST_LARGE of them at most from LEAST_LARGE * MOST_LARGE rows on,
# and fewer below.
LEAST_LARGE, MOST_LARGE = 256, 10_000

_random = np.random.default_rng(20)
_SCALE = _random.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _random.integers(0, 1 << 32, MINIMA, dtype=np.uint32)


def _minima(hashes: np.ndarray) -> np.ndarray:
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(high), 1024):
        values = _SCALE[:, None] * high[None, k : k + 1024]
        values += _SHIFT[:, None]
        np.minimum(low, values.min(axis=1), out=low)
    return low


def _bands(minima: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band; the number of the band is part of it."""
    parts = minima.reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :]
    for k in range(BAND_ROWS):
        key = mix(key ^ (parts[:, :, k] + np.uint64(k << 32)))
    return key.view(np.int64)


def _packed(minima: np.ndarray) -> np.ndarray:
    """The low bits of all minima of a row in N_WORDS 64-bit words."""
    # The low bits of a product hang on the low bits of its factors alone.
    low = (minima ^ (minima >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    low = (low ^ (low >> np.uint32(12))) & np.uint32((1 << LOW_BITS) - 1)
    padded = np.zeros((len(minima), N_WORDS * PER_WORD), np.uint64)
    padded[:, :MINIMA] = low
    shifts = np.arange(PER_WORD, dtype=np.uint64) * np.uint64(LOW_BITS)
    words = np.bitwise_or.reduce(padded.reshape(len(minima), N_WORDS, PER_WORD) << shifts, axis=2)
    return words.view(np.int64)


def _lists(values: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(ends, np.ascontiguousarray(values).ravel())


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, last, texts in blocks(batch.column(1), lower=True):
                sets = shingle_sets(texts, width)
                minima = np.array([_minima(s) for s in sets], np.uint32).reshape(-1, MINIMA)
                keys = [
                    hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                    for s in sets
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, last - first),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(keys, pa.binary()),
                        _lists(_bands(minima)),
                        _lists(_packed(minima)),
                    ],
                    ["id", "n", "set_key", "bands", "low"],
                )

    return run


def _bitmap(hashes: np.ndarray) -> bytes:
    """A bit for each shingle, by its low bits. Where two bitmaps differ the sets do, so
    their distance in bits never exceeds the number of shingles only one set has."""
    n_bits = max(64, 1 << (BITMAP_BITS * len(hashes) - 1).bit_length())
    flags = np.zeros(n_bits, np.uint8)
    flags[(hashes & np.uint64(n_bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, last, texts in blocks(batch.column(1), lower=True):
                sets = shingle_sets(texts, width)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, last - first),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.ListArray.from_arrays(
                            np.cumsum([0] + [len(s) for s in sets]).astype(np.int32),
                            np.concatenate(sets).view(np.int64),
                        ),
                        pa.array([_bitmap(s) if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["id", "n", "held", "bitmap"],
                )

    return run


def signatures(docs: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """(id, n, set_key, bands, low) of each document: size and digest of its shingle set,
    band keys, packed low bits."""
    return docs.select(col(id_column).cast("bigint").alias("id"), col(text_column)).mapInArrow(
        _signatures(width),
        "id bigint, n bigint, set_key binary, bands array<bigint>, low array<bigint>",
    )


def _unequal(a: Column, b: Column) -> Column:
    """How many minima of two packed signatures differ in their low bits."""
    total = F.lit(0)
    ones = F.lit(0x1111111111111111)
    for k in range(N_WORDS):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(ones))
    return total


def estimate(unequal):
    """Similarity of two sets from the number of minima that differ in their low bits,
    corrected for unequal minima whose low bits agree."""
    chance = 2.0**-LOW_BITS
    return (1 - unequal / MINIMA - chance) / (1 - chance)


def _most_unequal(percent: int) -> int:
    """Unequal minima beyond which a pair of the wanted similarity is out of the question."""
    chance = 2.0**-LOW_BITS
    differ = (1 - percent / 100) * (1 - chance)
    return math.floor(MINIMA * differ + DEVIATIONS * math.sqrt(MINIMA * differ * (1 - differ)))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) confirmed on full sets; a row at a time, whatever the sets' sizes."""
    both = F.size(F.array_intersect("held_a", "held_b"))
    either = F.size("held_a") + F.size("held_b") - both
    return (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("held").alias("held_a")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("held").alias("held_b")), "b")
        .where((both > 0) & (both.cast("bigint") * 100 >= either.cast("bigint") * percent))
        .select("a", "b")
        .distinct()
    )


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix of unequal minima between two blocks of packed signatures."""
    total = np.zeros((len(a), len(b)), np.int32)
    ones = np.uint64(0x1111111111111111)
    for k in range(N_WORDS):
        x = a[:, k][:, None] ^ b[:, k][None, :]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        total += np.bitwise_count(x & ones)
    return total


def _folded(bitmaps: np.ndarray, n_words: int) -> np.ndarray:
    """Bitmaps of fewer bits: the low bits of a hash stay the same."""
    return np.bitwise_or.reduce(bitmaps.reshape(len(bitmaps), -1, n_words), axis=1)


def _ruled_out(rows: dict, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows (a, b) have bitmaps too different for linked sets.

    Linked sets x and y differ in (|x| + |y|) * (100 - percent) / (100 + percent)
    shingles at most.
    """
    out = np.zeros(len(a), bool)
    words = np.array([len(x) // 8 for x in rows["bitmap"]])
    most = (rows["n"][a] + rows["n"][b]) * (100 - percent)
    for one in np.unique(words[a]):
        for other in np.unique(words[b]):
            at = np.flatnonzero((words[a] == one) & (words[b] == other))
            if not len(at):
                continue
            held = {}
            for side, size in ((a, one), (b, other)):
                used = np.unique(side[at])
                raw = b"".join(rows["bitmap"][k] for k in used)
                bitmaps = np.frombuffer(raw, np.uint64).reshape(len(used), size)
                held[id(side)] = used, _folded(bitmaps, min(one, other))
            for k in range(0, len(at), PAIRS):
                part = at[k : k + PAIRS]
                x, y = (
                    held[id(side)][1][np.searchsorted(held[id(side)][0], side[part])]
                    for side in (a, b)
                )
                differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                out[part] = differ * (100 + percent) > most[part]
    return out


def _partners(percent: int):
    """For each loose member of a block, the members of other components that may be
    linked with it.

    Rows arrive sorted by block; a block has a bounded number of rows and may cross
    batches.
    """
    most = _most_unequal(percent)

    def found(rows: dict) -> tuple[np.ndarray, np.ndarray]:
        loose = np.flatnonzero(rows["loose"])
        others = np.flatnonzero(~rows["loose"])
        fit = _differ(rows["low"][loose], rows["low"][others]) <= most
        fit &= rows["root"][loose][:, None] != rows["root"][others][None, :]
        n, m = rows["n"][loose][:, None], rows["n"][others][None, :]
        fit &= np.minimum(n, m) * 100 >= percent * np.maximum(n, m)
        x, y = np.nonzero(fit)
        a, b = loose[x], others[y]
        keep = ~_ruled_out(rows, a, b, percent)
        return rows["id"][a[keep]], rows["id"][b[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            a, b = found(rows)
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"]
                )

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of one block after the other, as arrays."""
    held, block = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {
            c: batch.column(c).to_numpy(zero_copy_only=False)
            for c in ("band", "i", "j", "id", "root", "loose", "n", "bitmap")
        }
        rows["low"] = batch.column("low").flatten().to_numpy().view(np.uint64).reshape(-1, N_WORDS)
        keys = np.stack([rows[c] for c in ("band", "i", "j")], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for first, last in zip(edges, edges[1:]):
            key = tuple(keys[first])
            if held and key != block:
                yield {c: np.concatenate([h[c] for h in held]) for c in rows}
                held = []
            block = key
            held.append({c: v[first:last] for c, v in rows.items()})
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}


def _block(count: str) -> Column:
    """Block of a member among as many as the bucket needs."""
    return F.pmod(F.xxhash64("id"), F.ceil(F.col(count) / BLOCK)).cast("bigint")


def _all_blocks(count: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col(count) / BLOCK) - 1))


def _loose_pairs(
    met: DataFrame, labels: DataFrame, details: DataFrame, percent: int
) -> DataFrame:
    """Pairs (a, b) of a bucket that may be linked: of a member outside the bucket's largest
    label, and one with another label."""
    named = met.join(labels, "id", "left").select(
        "band", "id", F.coalesce("label", "id").alias("root")
    )
    sizes = named.groupBy("band", "root").agg(F.count("*").alias("size"))
    largest = (
        sizes.groupBy("band")
        .agg(
            F.max_by("root", F.struct("size", "root")).alias("main"),
            F.sum("size").alias("members"),
            (F.sum("size") - F.max("size")).alias("loose_members"),
        )
        .where(F.col("loose_members") > 0)
    )
    rows = named.join(largest, "band").join(details, "id")
    kept = ["id", "root", "n", "low", "bitmap"]
    loose = rows.where(F.col("root") != F.col("main")).select(
        "band", _block("loose_members").alias("i"), _all_blocks("members").alias("j"),
        *kept, F.lit(True).alias("loose"),
    )
    others = rows.select(
        "band", _all_blocks("loose_members").alias("i"), _block("members").alias("j"),
        *kept, F.lit(False).alias("loose"),
    )
    return (
        loose.unionByName(others)
        .repartition("band", "i", "j")
        .sortWithinPartitions("band", "i", "j")
        .mapInArrow(_partners(percent), "a bigint, b bigint")
        .distinct()
    )


def _labels(links: DataFrame) -> DataFrame:
    """(id, label): the smallest node a node is linked to, or what that one is linked to."""
    first = links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("label"))
    above = first.select(F.col("id").alias("label"), F.col("label").alias("above"))
    return first.join(above, "label", "left").select("id", F.coalesce("above", "label").alias("label"))


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = 5,
    percent: int = PERCENT,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row.

    Documents are linked if 100 * intersection >= percent * union of their sets of
    ``width``-word shingles; a component's id is its smallest document id, and that
    document is kept. Text without words, or NULL, is an empty set and linked with
    nothing. Rows that share an id count as one document, with a result row each. A row
    without id can't be named by others: it is kept, with NULL as its component. No rows
    give no rows; other columns are not read.
    """
    source = docs.select(
        col(id_column).cast("bigint").alias("id"), col(text_column).alias("text")
    )
    signed, n_rows = counted(signatures(source, "id", "text", width), "signatures")
    full = signed.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = written(
        full.groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("members")),
        "classes",
    )
    # Rows of one id with different texts.
    ids = full.groupBy("id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y"))
    twice = full.join(ids.where(F.col("x") != F.col("y")).select("id"), "id", "left_semi")
    twice = twice.select("id", "set_key").distinct().join(classes, "set_key").select("id", "rep")
    same = twice.groupBy("id").agg(F.min("rep").alias("a")).join(twice, "id").select(
        "a", F.col("rep").alias("b")
    )

    reps = full.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    bands = reps.select("id", F.explode("bands").alias("band"))
    hubs = bands.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last"))
    hubs = hubs.where(F.col("hub") < F.col("last")).drop("last")
    met = written(bands.join(hubs, "band"), "buckets")
    # Full sets, only of documents that share a bucket.
    ids = met.select("id").distinct()
    sets = written(
        source.join(ids, "id", "left_semi").mapInArrow(
            _sets(width), "id bigint, n bigint, held array<bigint>, bitmap binary"
        ),
        "sets",
    )
    low = signed.select("id", "n", "low")
    linked = written(_verified(_to_hub(met, low, percent), sets, percent), "links")
    details = sets.select("id", "n", "bitmap").join(low, ["id", "n"])
    loose = _verified(_loose_pairs(met, _labels(linked), details, percent), sets, percent)
    roots = components(linked.unionByName(loose).unionByName(same))

    rooted = written(
        classes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select(
            "set_key", "members", F.coalesce("root", "rep").alias("component_id")
        ),
        "rooted",
    )
    rows = full.select("id", "n", "set_key")
    # Large classes are 10,000 at most; the others can't fill a task.
    large = F.col("members") > max(LEAST_LARGE, n_rows // MOST_LARGE)
    frequent = F.broadcast(rooted.where(large).drop("members"))
    named = (
        rows.join(frequent, "set_key")
        .unionByName(
            rows.join(frequent.select("set_key"), "set_key", "left_anti").join(
                rooted.where(~large).drop("members"), "set_key"
            )
        )
        .drop("set_key")
    )
    alone = signed.where((F.col("n") == 0) | F.col("id").isNull()).select(
        "id", "n", F.col("id").alias("component_id")
    )
    return named.unionByName(alone).select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def _to_hub(met: DataFrame, low: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket's smallest member and another one, as far as sizes and
    packed signatures allow the wanted similarity."""
    pairs = met.where(F.col("id") != F.col("hub")).select(
        F.col("hub").alias("a"), F.col("id").alias("b")
    )
    sides = [
        low.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("low").alias(f"low_{c}"))
        for c in ("a", "b")
    ]
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return (
        pairs.distinct()
        .join(sides[0], "a")
        .join(sides[1], "b")
        .where(
            (small * 100 >= large * percent)
            & (_unequal(F.col("low_a"), F.col("low_b")) <= _most_unequal(percent))
        )
        .select("a", "b")
        .distinct()
    )


def one_of_each(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = 5,
    percent: int = PERCENT,
) -> DataFrame:
    """The documents without near duplicates of a kept one, with the columns they came with.

    Of each group the document with the smallest id stays, NULL last; of equal ids the one
    that comes first by text. Rows that share an id, or have none, are told apart: each
    stays unless it is a near duplicate itself. Of rows equal in id and text one stays,
    also where the text is empty.
    """
    ids = docs.groupBy(col(id_column).alias("id")).count()
    twice = ids.where((F.col("count") > 1) | F.col("id").isNull()).limit(1).count()
    key = unused(docs, "row_number")
    if not twice:
        groups = near_duplicates(docs, id_column, text_column, width, percent)
        gone = groups.where(~F.col("kept")).select(col(id_column).alias(key))
        return docs.join(gone, col(id_column).cast("bigint") == F.col(key), "left_anti")
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    groups = near_duplicates(rows, key, text_column, width, percent)
    component = unused(rows, "component")
    groups = groups.select(
        F.col(key).alias("number"),
        F.when(F.col("n_shingles") > 0, F.col("component_id")).alias(component),
    )
    named = rows.join(groups, F.col(key) == F.col("number")).drop("number")
    of_all = F.xxhash64(*[col(c) for c in docs.columns])
    text = text_first(text_column)
    order = F.struct(col(id_column).isNull(), col(id_column), text, of_all, F.col(key))
    full = named.where(F.col(component).isNotNull()).groupBy(component)
    bare = named.where(F.col(component).isNull()).groupBy(col(id_column), text)
    kept = full.agg(F.min_by(key, order).alias("number")).select("number")
    blank = bare.agg(F.min_by(key, F.struct(of_all, F.col(key))).alias("number")).select("number")
    return rows.join(
        kept.unionByName(blank), F.col(key) == F.col("number"), "left_semi"
    ).drop(key)


def text_first(text_column: str) -> Column:
    """Order of rows by text; NULL counts as empty."""
    return F.coalesce(col(text_column), F.lit(""))
