"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles.  Two
fingerprints that differ in at most ``radius`` bits have a word in common among the words
within ``radius / 2`` bits of either: every distinct fingerprint emits that ball, the balls
meet on equal variants, and colliding fingerprints are verified and linked.

The shuffle does not carry the ball of 2081 variants.  A variant's cell is the XOR of its
``width``-bit slices, which is linear, so the cells that a ball touches are known without its
variants: the fingerprint goes once to each such cell and the cell makes the variants that
belong to it.  The number of cells grows with the number of fingerprints, so a cell holds a
bounded number of variants; a cell that is fuller is worked off in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.llm.common import connected_components, fresh_name, row_key, small_batches
from farpoint.session import materialize

BITS = 64
#: Variants that one cell is meant to hold, and the most that a task holds at once.
CELL_VARIANTS = 3_000_000
SLICE_VARIANTS = 8_000_000


def fingerprint(data: bytes | None, words: int = 4, seed: int = 42) -> int:
    """Unsigned fingerprint of one UTF-8 text; no words: zero."""
    parts = data.lower().split() if data else []  # bytes: A-Z and ASCII white space alone
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    joined = b" ".join(parts)
    stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], stops[:-words] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts, stops[words - 1 :].tolist())), np.uint64, len(starts)
    )
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", words: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` without ``text`` and with its fingerprint as a signed long column ``out``."""
    kept = [c for c in docs.columns if c != text]
    schema = docs.select(*[f"`{c}`" for c in kept]).withColumn(out, F.lit(0).cast("long")).schema

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept)).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), words, seed) for t in texts), np.uint64, len(texts))
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fps.view(np.int64))], names=[*kept, out])

    return small_batches(docs).select(*[f"`{c}`" for c in kept], f"`{text}`").mapInArrow(mapped, schema)


def hex_digits(fp: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# --- balls -------------------------------------------------------------------


def ball_masks(half: int) -> np.ndarray:
    """Every word of at most ``half`` set bits."""
    masks = [sum(1 << i for i in bits) for n in range(half + 1) for bits in combinations(range(BITS), n)]
    return np.array(masks, np.uint64)


def _fold(values: np.ndarray, width: int) -> np.ndarray:
    folded = np.zeros(len(values), np.uint64)
    for at in range(0, BITS, width):
        folded ^= values >> np.uint64(at)
    return (folded & np.uint64((1 << width) - 1)).astype(np.int64)


def _slice_of(values: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Another linear hash, of ``bits`` bits, that does not follow from the cell."""
    out = np.zeros(len(values), np.int64)
    for i in range(BITS):
        out ^= ((values >> np.uint64(i)) & np.uint64(1)).astype(np.int64) << ((i // width) % bits)
    return out


def _fold_column(fp: str, width: int) -> Column:
    folded = F.col(fp)
    for at in range(width, BITS, width):
        folded = folded.bitwiseXOR(F.shiftrightunsigned(F.col(fp), at))
    return folded.bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _meetings(fps: np.ndarray, variants_of: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Pairs ``(i, j)`` of rows of ``fps`` that follow each other among those sharing a variant."""
    sizes = np.array([len(rows) * len(masks) for rows, masks in variants_of], np.int64)
    if not len(sizes) or sizes.sum() < 2:
        return np.empty((0, 2), np.int64)
    variants = np.concatenate([(fps[rows][:, None] ^ masks[None, :]).ravel() for rows, masks in variants_of])
    ordered = np.sort(variants)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(shared):
        return np.empty((0, 2), np.int64)
    marks = np.zeros(1 << 22, bool)  # most variants are seen to be alone without a search
    mixed = np.uint64(0x9E3779B97F4A7C15)
    marks[(shared * mixed) >> np.uint64(42)] = True
    at = np.flatnonzero(marks[(variants * mixed) >> np.uint64(42)])
    values = variants[at]
    place = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
    hit = shared[place] == values
    at, values = at[hit], values[hit]
    ends = np.cumsum(sizes)
    part = np.searchsorted(ends, at, side="right")
    rows = np.empty(len(at), np.int64)
    for p in np.unique(part):
        here = part == p
        members, masks = variants_of[p]
        rows[here] = members[(at[here] - (ends[p] - sizes[p])) // len(masks)]
    order = np.lexsort((rows, values))
    rows, values = rows[order], values[order]
    same = values[1:] == values[:-1]
    pairs = np.stack([rows[:-1][same], rows[1:][same]], axis=1)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    codes = np.unique(pairs.min(axis=1) * len(fps) + pairs.max(axis=1))
    return np.stack([codes // len(fps), codes % len(fps)], axis=1)


def _forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """Pairs that link the same rows with one link a row: ``(row, least row reachable)``."""
    label = np.arange(n)
    while len(pairs):
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        before = label.copy()
        for side in (0, 1):
            np.minimum.at(label, label[pairs[:, side]], low)
            np.minimum.at(label, pairs[:, side], low)
        label = label[label]
        if np.array_equal(before, label) and np.array_equal(label[pairs[:, 0]], label[pairs[:, 1]]):
            break
    moved = np.flatnonzero(label != np.arange(n))
    return np.stack([moved, label[moved]], axis=1)


def cell_links(fps: np.ndarray, cell: int, width: int, radius: int, most: int = SLICE_VARIANTS) -> np.ndarray:
    """Links among the distinct ``fps`` whose balls share a variant of ``cell``, thinned to a forest."""
    masks = ball_masks(radius // 2)
    homes, mask_cells = _fold(fps, width), _fold(masks, width)
    per_cell = np.bincount(mask_cells, minlength=1 << width)
    total = int(per_cell[homes ^ cell].sum())
    bits = max(0, int(np.ceil(np.log2(max(1, total / most)))))
    slices, mask_slices = (_slice_of(fps, width, bits), _slice_of(masks, width, bits)) if bits else (0 * homes, 0 * mask_cells)
    fp_keys, mask_keys = (homes << bits) | slices, (mask_cells << bits) | mask_slices
    by_key, by_mask = np.argsort(fp_keys, kind="stable"), np.argsort(mask_keys, kind="stable")
    sorted_keys, wanted = fp_keys[by_key], np.unique(mask_keys)
    found = [np.empty((0, 2), np.int64)]
    for part in range(1 << bits):
        target = (cell << bits) | part
        variants_of = []
        for key in wanted:
            a, b = np.searchsorted(sorted_keys, [target ^ key, (target ^ key) + 1])
            if b > a:
                c, d = np.searchsorted(mask_keys, [key, key + 1], sorter=by_mask)
                variants_of.append((by_key[a:b], masks[by_mask[c:d]]))
        found.append(_meetings(fps, variants_of))
    pairs = np.concatenate(found)
    apart = np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]])
    return _forest(pairs[apart <= radius], len(fps))


def links(nodes: DataFrame, radius: int = 4, cell_variants: int = CELL_VARIANTS) -> DataFrame:
    """``(a, b)`` fingerprints that join what lies within ``radius`` bits; ``nodes (fp)`` are distinct.

    The links are enough for components, not all pairs: of those that share a variant, which lie
    within ``radius`` of one another, each is linked to the next, and each cell thins its links.
    """
    if radius < 0 or radius % 2:
        raise ValueError("radius must be even: only then are any two that share a variant within it")
    ball = len(ball_masks(radius // 2))
    width = max(3, min(24, int(np.ceil(np.log2(max(1, nodes.count() * ball / cell_variants))))))
    touched = np.unique(_fold(ball_masks(radius // 2), width)).tolist()
    home = _fold_column("fp", width)
    cells = F.explode(F.array(*[home.bitwiseXOR(F.lit(c).cast("long")) for c in touched]))

    small_batches(nodes, 20_000)

    def linked(key: tuple, group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy().view(np.uint64)
        found = cell_links(fps, key[0].as_py(), width, radius)
        ends = fps.view(np.int64)
        return pa.table({"a": ends[found[:, 0]], "b": ends[found[:, 1]]})

    return nodes.select("fp", cells.alias("cell")).groupBy("cell").applyInArrow(linked, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4, words: int = 4) -> DataFrame:
    """One row per row of ``docs``: its key, ``fp``, the ``label`` of its component and ``component_id``.

    ``component_id`` is the least key reachable over links of at most ``radius`` differing bits.
    Null and wordless texts have fingerprint zero and are linked like any other.  Rows without a
    key take part; a component of such rows alone has a null id.  Repeated rows give repeated rows.
    """
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    marked = materialize(with_fingerprints(texts, words=words), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    joined = connected_components(links(nodes.select("fp"), radius)).select(F.col("node").alias("fp"), "label")
    members = nodes.join(joined, "fp", "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    least = members.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return marked.join(members.join(least, "label").select("fp", "label", "component_id"), "fp").select(
        F.col("doc_id").alias(key), "fp", "label", "component_id"
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4, words: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the least key.

    Among rows that share that key the least row hash stays, and one of rows that are equal in
    all columns.  Columns are those of ``docs``.
    """
    mark, rank, same = (fresh_name(docs, c) for c in ("row_hash", "row_rank", "row_label"))
    hashed = docs.withColumn(mark, row_key(docs))
    rows = hashed.select(F.struct(F.col(key).alias("k"), F.col(mark).alias("h")).alias("doc_id"), F.col(text).alias("text"))
    first = near_duplicates(rows, radius=radius, words=words).groupBy("label").agg(
        F.min(F.struct(F.col("doc_id.k").isNull(), "doc_id.k", "doc_id.h")).alias("first")
    )
    kept = first.select(F.col("first.h").alias(mark)).distinct()
    stays = hashed.join(kept, mark)
    return stays.dropDuplicates([mark]).select(*[f"`{c}`" for c in docs.columns])
