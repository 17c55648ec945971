"""Near-duplicate groups by SimHash fingerprints, found through a byte-position inverted index with count filtering.

A fingerprint of 64 bits has eight byte positions. Two fingerprints that differ in at most four bits share at least four
positional bytes. The index posts a fingerprint under triples of its positional bytes; twenty of the 56 triples suffice
so that every set of four positions holds one of them whole. Within a posting list the shared positional bytes of a pair
are tallied, pairs under the guaranteed minimum of four are passed over, and the rest is verified bit by bit.

Equal fingerprints are one entry of the index. A posting list longer than a block is cut in blocks and every pair of
blocks is a task of its own. A block yields a spanning forest of its links instead of all pairs, which keeps every
component and stays linear in the block.

Null texts count as empty, empty texts have fingerprint zero and link like any other; repeated rows and equal ids keep
one row each; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import arrow_batches, components, slices, texts, written

SHINGLE = 4
SEED = 42
MAX_BITS = 4
MIN_SHARED = 8 - MAX_BITS
BLOCK = 2048
PIECE = 65536


def covering_triples() -> list[tuple[int, int, int]]:
    """Triples of the eight positions such that any four positions hold one: whole groups, or two of a group and one of the next."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [g for g in groups if len(g) == 3]
    for i, g in enumerate(groups):
        out += [tuple(sorted((*pair, x))) for pair in combinations(g, 2) for x in groups[(i + 1) % 3]]
    return sorted(out)


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """Bit is one where over half of the shingle hashes have it."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(first)
    for at in range(0, n, PIECE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at:at + PIECE], last[at:at + PIECE])], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


FP_SCHEMA = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        fps = np.array([fingerprint(t) for t in texts(b.column("text"))], np.uint64).view(np.int64)
        yield from arrow_batches({"doc_id": b.column("doc_id"), "fp": fps}, FP_SCHEMA)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def _forest(fps: np.ndarray) -> tuple[list[int], list[int]]:
    """Spanning forest of the links among the fingerprints, as index pairs."""
    left = np.arange(len(fps))
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            x = fps[left] ^ fps[u]
            shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= MIN_SHARED
            hit = shared & (np.bitwise_count(x) <= MAX_BITS)
            if hit.any():
                got = left[hit]
                a += [u] * len(got)
                b += got.tolist()
                queue += got.tolist()
                left = left[~hit]
    return a, b


def _short_lists(run: np.ndarray, fps: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """All links within lists of at most `longest` entries, list by list side by side."""
    a, b = [], []
    for d in range(1, longest):
        i = np.flatnonzero(run[:-d] == run[d:])
        if not len(i):
            break
        x = fps[i] ^ fps[i + d]
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= MIN_SHARED
        i = i[shared & (np.bitwise_count(x) <= MAX_BITS)]
        a.append(fps[i])
        b.append(fps[i + d])
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


LINK_SCHEMA = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by list; a list that a batch cuts off is carried to the next one."""

    def links_of(key, cell, fps) -> Iterator[pa.RecordBatch]:
        if not len(fps):
            return
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])))
        run = np.cumsum(new)
        size = np.bincount(run)[run]
        short = size <= 16
        u, v = _short_lists(run[short], fps[short], 16)
        us, vs = [u], [v]
        for r in np.unique(run[~short]):
            own = fps[run == r]
            a, b = _forest(own)
            us.append(own[a])
            vs.append(own[b])
        out = {"u": np.concatenate(us).view(np.int64), "v": np.concatenate(vs).view(np.int64)}
        if len(out["u"]):
            yield from arrow_batches(out, LINK_SCHEMA)

    kept = None
    for b in batches:
        if not b.num_rows:
            continue
        now = [b.column("key").to_numpy(), b.column("cell").to_numpy(), b.column("fp").to_numpy().view(np.uint64)]
        if kept is not None:
            now = [np.concatenate((x, y)) for x, y in zip(kept, now)]
        same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
        cut = len(same) - (int(np.argmin(same[::-1])) if not same.all() else len(same))
        yield from links_of(*[x[:cut] for x in now])
        kept = [x[cut:] for x in now]
    if kept is not None:
        yield from links_of(*kept)


def links(distinct_fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(u, v) links between distinct fingerprints `fp`: of every component a spanning set at least."""
    byte = lambda p: F.shiftright("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = []
    for n, (p, q, r) in enumerate(covering_triples()):
        keys.append(F.lit(n << 24) + byte(p) * 65536 + byte(q) * 256 + byte(r))
    posted = distinct_fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    listed = posted.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1")
    blocks = F.ceil(F.col("n") / block)
    own = F.pmod(F.xxhash64("fp"), blocks)
    other = F.explode(F.when(blocks > 1, F.sequence(F.lit(0).cast("bigint"), blocks - 1)).otherwise(F.array(F.lit(0).cast("bigint"))))
    cells = listed.select("fp", "key", blocks.alias("blocks"), own.alias("own"), other.alias("other"))
    cells = cells.filter("blocks = 1 or own <> other").select(
        "fp", "key", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("cell"))
    dealt = cells.repartition("key", "cell").sortWithinPartitions("key", "cell", "fp")
    return dealt.mapInArrow(_links, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the component)."""
    fps = written(fingerprints(docs), "fingerprints")
    own = fps.groupBy("fp").agg(F.min("doc_id").alias("doc"))
    roots = components(links(own.select("fp")))
    found = own.join(roots, own.fp == roots.node).select("fp", "doc", "root")
    least = found.groupBy("root").agg(F.min("doc").alias("least"))
    moved = found.join(least, "root").select("fp", F.col("least").alias("component_id"))
    # as a table, so that the join below reads both sides from plain shuffles and a very common fingerprint can be split
    groups = written(own.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "doc").alias("component_id")), "groups")
    return fps.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without all but the smallest id of each group; of repeated rows with that id one stays. Rows without
    an id can't be named as copies and stay."""
    first = near_duplicates(docs).filter("doc_id = component_id").select(F.col("doc_id").alias("keep")).distinct()
    rows = docs.select(F.struct("*").alias("d"))
    kept = rows.join(first, F.col("d.doc_id") == F.col("keep"), "left_semi")
    own = F.struct("d.text")
    again = F.lag(own).over(Window.partitionBy("d.doc_id").orderBy("d.text")).eqNullSafe(own)
    return kept.select("d", again.alias("again")).filter("not again").select("d.*").unionByName(docs.filter(docs.doc_id.isNull()))
