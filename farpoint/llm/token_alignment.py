"""Alignment of two tokenizers by sparse products of token-byte incidence matrices.

Row i of a tokenizer's incidence matrix marks the bytes that its token i covers.  With A and B
such matrices over the same bytes, entry (i, j) of A.B' is the number of bytes that token i of
one and token j of the other share: the overlap links.  Offsets where tokens of both end cut the
tokens into groups; the product of the two token-group matrices links what shares a group.  The
matrices are plain compressed rows (CSR), and products go row by row after Gustavson: row i of a
product is the sum of those rows of the second matrix that row i of the first names.

Where a space follows another character, tokens of both always end: texts fall into units there,
a word with the space before it, that are encoded and aligned alone.  Texts are worked on in
blocks of bounded size, each distinct unit of a block once; how often a text links two ids is one
more product, of text-unit counts and unit-pair links.

How often a pair of ids is linked is counted over the corpus.  A block stores the distinct pairs of each text as places in the block's own list of
pairs, and only these lists meet the corpus-wide counts: a pair that occurs in every text is one
row a block there, not one a text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from farpoint.llm.common import text_or_empty
from farpoint.session import materialize

#: Where the public vocabularies lie on the driver; the files are sent to the tasks.
VOCABULARIES = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a block, and in one product.  A longer text makes a block of its own.
BLOCK_BYTES = 8 << 20
SLICE_BYTES = 1 << 20
#: Multiplications of a product that are held at once.
_PRODUCTS = 1 << 22
#: Where texts fall into units: after anything but white space, before a space that isn't the last character.
_APART = re.compile(r"(?<=\S)(?= .)", re.DOTALL)


# --- matrices ------------------------------------------------------------------


@dataclass(frozen=True)
class Csr:
    """Compressed rows: row i has ``data[k]`` in column ``indices[k]`` for k from ``indptr[i]`` to ``indptr[i + 1]``."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def row_of_entry(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.indptr))

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        ends = np.cumsum(np.bincount(self.indices, minlength=self.columns))
        return Csr(np.concatenate(([0], ends)), self.row_of_entry()[order], self.data[order], self.rows)


def byte_incidence(lengths: np.ndarray) -> Csr:
    """Tokens by bytes, for tokens of ``lengths`` bytes that follow one another."""
    ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    return Csr(ends, np.arange(ends[-1]), np.ones(ends[-1], np.int32), int(ends[-1]))


def group_incidence(groups: np.ndarray, count: int) -> Csr:
    """Tokens by groups; every token lies in one group."""
    return Csr(np.arange(len(groups) + 1), groups, np.ones(len(groups), np.int32), count)


def product_sizes(a: Csr, b: Csr) -> np.ndarray:
    """Multiplications that each row of ``a.b`` takes; its entries, where no column comes up twice."""
    sizes = np.concatenate(([0], np.cumsum(np.diff(b.indptr)[a.indices])))
    return np.diff(sizes[a.indptr])


def row_products(a: Csr, b: Csr, most: int = _PRODUCTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Gustavson's product ``a.b`` as ``(rows, columns, values)`` in order, in runs of rows of ``most`` multiplications."""
    done = np.concatenate(([0], np.cumsum(product_sizes(a, b))))
    start = 0
    while start < a.rows:
        stop = max(start + 1, int(np.searchsorted(done, done[start] + most, side="right")) - 1)
        entries = slice(int(a.indptr[start]), int(a.indptr[stop]))
        named = a.indices[entries]
        sizes = b.indptr[named + 1] - b.indptr[named]
        before = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        at = np.repeat(b.indptr[named] - before, sizes) + np.arange(total)
        row = np.repeat(np.arange(start, stop), np.diff(done[start : stop + 1]))
        key = row * b.columns + b.indices[at]
        value = np.repeat(a.data[entries], sizes) * b.data[at]
        if total and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if total else np.empty(0, np.int64)
        key = key[heads]
        yield key // max(1, b.columns), key % max(1, b.columns), np.add.reduceat(value, heads) if total else value
        start = stop


# --- tokenizers ----------------------------------------------------------------


class _Side:
    """One tokenizer: ids of spaced texts, the bytes of its tokens, and the written ids.

    ``apart``: no token goes on from another character to a space.
    """

    def __init__(self, token_bytes: list[bytes], apart: bool):
        self.token_bytes = token_bytes
        self.apart = apart
        self.lengths = np.array([len(t) for t in token_bytes], np.int64)
        self.size = len(token_bytes)
        self.digits = np.array([len(str(i)) for i in range(self.size)], np.int64)
        self.written = {c: np.array([f"{i}{c}" for i in range(self.size)], "S") for c in ",|;"}

    def spelled(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


class ByteLevel(_Side):
    """Byte-level BPE of a JSON file; strings of special tokens are ordinary text."""

    def __init__(self, file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(file.decode())
        self.model.encode_special_tokens = True
        # the alphabet of byte-level files: printable Latin-1 stands for itself, other bytes follow from 256
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in plain]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        spelled = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in letters for c in token)
            spelled[i] = bytes(letters[c] for c in token) if known else token.encode()
        settings = json.loads(file)
        # the byte-level pattern cuts before a space that follows another character
        cut = {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}
        apart = settings["normalizer"] is None and cut.items() <= (settings["pre_tokenizer"] or {}).items()
        super().__init__(spelled, apart)

    def ids(self, spaced: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(spaced, add_special_tokens=False)]


class Pieces(_Side):
    """A sentencepiece model, which puts a space before the text itself."""

    def __init__(self, file: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=file)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        spelled = [
            bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode()
            for i, name in enumerate(names)
        ]
        super().__init__(spelled, not any(re.search("[^▁]▁", name) for name in names))

    def ids(self, spaced: list[str]) -> list[list[int]]:
        return self.model.encode([text[1:] for text in spaced], num_threads=1)


@lru_cache(2)
def _sides(byte_level: bytes, pieces: bytes) -> tuple[_Side, _Side]:
    return ByteLevel(byte_level), Pieces(pieces)


@dataclass
class Files:
    """The two vocabulary files, some megabytes, broadcast to the tasks."""

    shared: object

    @classmethod
    def sent(cls, docs: DataFrame, folder: str = VOCABULARIES, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> Files:
        def content(name: str) -> bytes:
            with open(os.path.join(folder, name), "rb") as file:
                return file.read()

        return cls(docs.sparkSession.sparkContext.broadcast((content(byte_level), content(pieces))))

    def sides(self) -> tuple[_Side, _Side]:
        return _sides(*self.shared.value)


# --- one slice of units ----------------------------------------------------------


@dataclass
class Aligned:
    """Tokens of several spaced texts, or units of texts, over one byte axis."""

    exact: np.ndarray  # by text: both tokenizers spell it byte for byte; else it has no tokens
    ids: tuple[np.ndarray, np.ndarray]
    per: tuple[np.ndarray, np.ndarray]  # tokens of each text
    bytes: tuple[Csr, Csr]
    groups: tuple[Csr, Csr]
    ends: np.ndarray  # of the groups
    first: np.ndarray  # group of each text, and the number of all

    def text_of(self, side: int) -> np.ndarray:
        return np.repeat(np.arange(len(self.per[side])), self.per[side])

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return row_products(self.bytes[0], self.bytes[1].transposed())

    def shared_groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return row_products(self.groups[0], self.groups[1].transposed())

    def written(self, a: _Side, b: _Side) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every text."""
        before = [g.transposed().indptr for g in self.groups]
        groups = [g.indices for g in self.groups]
        places = [np.arange(len(groups[0])) + before[1][groups[0]], np.arange(len(groups[1])) + before[0][groups[1] + 1]]
        total = len(groups[0]) + len(groups[1])
        pieces = np.empty(total, f"S{max(s.digits[-1] for s in (a, b)) + 1}")
        sizes = np.empty(total, np.int64)
        for side, (tokens, end) in enumerate(((a, "|"), (b, ";"))):
            ids = self.ids[side]
            last = self.ends[groups[side]] == self.bytes[side].indptr[1:]
            pieces[places[side]] = np.where(last, tokens.written[end][ids], tokens.written[","][ids])
            sizes[places[side]] = tokens.digits[ids] + 1
        flat = pieces.tobytes().replace(b"\0", b"")
        stops = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(self.per[0] + self.per[1])].tolist()
        return [flat[start : max(start, stop - 1)] for start, stop in zip([0, *stops], stops)]


def aligned(spaced: list[str], a: _Side, b: _Side) -> Aligned:
    """Tokens of texts that start with the space that is put before them."""
    kept: tuple[list, list] = ([], [])
    exact = np.zeros(len(spaced), bool)
    for at, (text, ids_a, ids_b) in enumerate(zip(spaced, a.ids(spaced), b.ids(spaced))):
        whole = text.encode()
        exact[at] = a.spelled(ids_a) == whole and b.spelled(ids_b) == whole
        for side, ids in zip(kept, (ids_a, ids_b)):
            side.append(np.array(ids if exact[at] else [], np.int64))
    ids = tuple(np.concatenate([*side, np.empty(0, np.int64)]) for side in kept)
    per = tuple(np.array([len(i) for i in side], np.int64) for side in kept)
    rows = tuple(byte_incidence(side.lengths[i]) for side, i in zip((a, b), ids))
    ends = np.intersect1d(rows[0].indptr[1:], rows[1].indptr[1:], assume_unique=True)
    groups = tuple(group_incidence(np.searchsorted(ends, r.indptr[1:]), len(ends)) for r in rows)
    first = np.searchsorted(ends, rows[0].indptr[np.concatenate(([0], np.cumsum(per[0])))], side="right")
    return Aligned(exact, ids, per, rows, groups, ends, first)


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours that together hold at most ``most``, or one that holds more."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if sizes:
        yield start, len(sizes)


def _sums_by_text(values: np.ndarray, per: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(per)
    return total[ends] - total[ends - per]


# --- blocks ----------------------------------------------------------------------


def _packed(values: np.ndarray) -> bytes:
    """Non-negative numbers below 2^32, by byte planes and compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * count, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


_MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_group_links")
_BLOCK = [
    ("block", T.LongType(), pa.int64()),
    *[(name, T.LongType(), pa.int64()) for name in _MEASURES],
    ("groups_sha256", T.StringType(), pa.string()),
    ("distinct", T.LongType(), pa.int64()),  # pairs of the text
    ("places", T.BinaryType(), pa.binary()),  # their places in the block's list, as steps
    ("links", T.BinaryType(), pa.binary()),  # how often each is linked
    ("pairs", T.ArrayType(T.LongType()), pa.list_(pa.int64())),  # the block's list, in its first row alone
    ("counts", T.ArrayType(T.LongType()), pa.list_(pa.int64())),
]


def _distinct(values: list[str]) -> tuple[list[str], np.ndarray]:
    """Distinct values and the place of each value among them."""
    places: dict[str, int] = {}
    of = np.fromiter((places.setdefault(v, len(places)) for v in values), np.int64, len(values))
    return list(places), of


def _unit_links(units: list[str], a: _Side, b: _Side) -> tuple[np.ndarray, np.ndarray, list[bytes], Csr, np.ndarray]:
    """Of every unit whether it is exact, its measures and written groups; unit-pair links and the pairs."""
    exact, measures, written, rows, pairs = [], [], [], [], []
    for start, stop in _runs([len(u.encode()) for u in units], SLICE_BYTES):
        part = aligned(units[start:stop], a, b)
        owner, total = part.text_of(0), np.zeros(stop - start, np.int64)
        for i, j, _ in part.overlaps():
            rows.append(start + owner[i])
            pairs.append(part.ids[0][i] * b.size + part.ids[1][j])
            total += np.bincount(owner[i], minlength=stop - start)
        shared = _sums_by_text(product_sizes(part.groups[0], part.groups[1].transposed()), part.per[0])
        exact.append(part.exact)
        measures.append(np.stack([*part.per, np.diff(part.first), total, shared]))
        written += part.written(a, b)
    none = np.empty(0, np.int64)
    listed, place = np.unique(np.concatenate([*pairs, none]), return_inverse=True)
    ends = np.cumsum(np.bincount(np.concatenate([*rows, none]), minlength=len(units)))
    links = Csr(np.concatenate(([0], ends)), place, np.ones(len(place), np.int64), len(listed))
    empty = np.empty((len(_MEASURES), 0), np.int64)
    return np.concatenate([*exact, none.astype(bool)]), np.concatenate([*measures, empty], axis=1), written, links, listed


def _block_columns(number: int, texts: list[str], a: _Side, b: _Side) -> list[pa.Array]:
    """The columns ``_BLOCK`` of the texts of one block; equal texts and equal units are worked on once."""
    distinct, of_row = _distinct(texts)
    times = np.bincount(of_row, minlength=len(distinct))
    cut = _APART.split if a.apart and b.apart else lambda spaced: [spaced]
    per_text = [cut(" " + text) if text else [] for text in distinct]
    sizes = np.array([len(u) for u in per_text], np.int64)
    units, unit = _distinct([u for found in per_text for u in found])
    owner = np.repeat(np.arange(len(distinct)), sizes)
    exact, measured, written, links, listed = _unit_links(units, a, b)

    broken = np.bincount(owner, ~exact[unit], minlength=len(distinct)) > 0  # one such unit leaves the text without tokens
    unit, owner = unit[~broken[owner]], owner[~broken[owner]]
    sizes[broken] = 0
    measures = np.stack([np.bincount(owner, m[unit], minlength=len(distinct)) for m in measured]).astype(np.int64)
    stops = np.cumsum(sizes).tolist()
    names = unit.tolist()
    digests = [
        hashlib.sha256(b";".join([written[u] for u in names[stop - size : stop]])).hexdigest() if size else ""
        for size, stop in zip(sizes.tolist(), stops)
    ]

    often = np.bincount(unit, times[owner], minlength=len(units))
    counts = np.bincount(links.indices, often[links.row_of_entry()], minlength=len(listed)).astype(np.int64)
    order = np.argsort(-counts, kind="stable")  # common pairs first, so that a text's places lie close
    order = order[counts[order] > 0]
    rank = np.zeros(len(listed), np.int64)
    rank[order] = np.arange(len(order))
    links = Csr(links.indptr, rank[links.indices], links.data, max(1, len(order)))
    code, uses = np.unique(owner * max(1, len(units)) + unit, return_counts=True)
    ends = np.cumsum(np.bincount(code // max(1, len(units)), minlength=len(distinct)))
    in_text = Csr(np.concatenate(([0], ends)), code % max(1, len(units)), uses, len(units))
    found = list(row_products(in_text, links))
    rows, places, linked = (np.concatenate([np.empty(0, np.int64), *[f[i] for f in found]]) for i in range(3))
    kinds = np.bincount(rows, minlength=len(distinct))
    stored = [
        (_packed(np.diff(places[stop - size : stop], prepend=0)), _packed(linked[stop - size : stop]))
        for size, stop in zip(kinds.tolist(), np.cumsum(kinds).tolist())
    ]
    n = len(texts)
    columns = [
        np.full(n, number),
        *measures[:, of_row],
        [digests[i] for i in of_row],
        kinds[of_row],
        [stored[i][0] for i in of_row],
        [stored[i][1] for i in of_row],
        [listed[order], *[None] * (n - 1)],
        [counts[order], *[None] * (n - 1)],
    ]
    return [pa.array(c, kind) for c, (_, _, kind) in zip(columns, _BLOCK)]


def blocks(docs: DataFrame, files: Files, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without ``text`` and with the columns ``_BLOCK``."""
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([*docs.select(*kept).schema.fields, *[T.StructField(n, t) for n, t, _ in _BLOCK]])
    names = schema.names

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = files.sides()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [t or "" for t in batch.column(len(kept)).to_pylist()]
            for start, stop in _runs([len(t.encode()) for t in texts], block_bytes):
                part = batch.slice(start, stop - start)
                made = _block_columns(number, texts[start:stop], a, b)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(kept))], *made], names=names)
                number += 1

    return docs.select(*kept, text_or_empty(text).alias(text)).mapInArrow(mapped, schema)


def pair_counts(stored: DataFrame, second_ids: int) -> DataFrame:
    """``(pair, count, best)`` over the corpus; ``best``: no other pair of the same second id has more links."""
    lists = stored.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    counted = lists.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("count"))
    # a second id has at most as many pairs as the first tokenizer has ids
    second = Window.partitionBy(F.col("pair") % second_ids)
    return counted.withColumn("best", F.col("count") == F.max("count").over(second))


def alignments(
    docs: DataFrame, key: str = "doc_id", text: str = "text", files: Files | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per row of ``docs``: its key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``,
    ``groups_sha256`` and ``n_group_links`` (pairs of tokens that share a group).

    Null and empty texts, and texts that one of the tokenizers doesn't spell byte for byte, have
    no tokens: zeros and an empty digest.  Repeated rows give repeated rows, a null key is kept,
    and an empty table gives an empty table.  Other columns of ``docs`` play no part.
    """
    files = files or Files.sent(docs)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    stored = materialize(blocks(rows, files, block_bytes=block_bytes), "alignments")
    counted = materialize(pair_counts(stored, files.sides()[1].size), "pairs")
    lists = stored.where("pairs is not null").select(F.col("block").alias("list"), F.posexplode("pairs").alias("place", "pair"))
    known = lists.join(counted, "pair").select("list", "place", "count", "best")
    measured = stored.drop("pairs", "counts")
    schema = T.StructType([*measured.drop("block", "distinct", "places", "links").schema.fields,
                           T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def summed(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        size = pairs.num_rows
        count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        place = pairs.column("place").to_numpy()
        count[place], best[place] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy().astype(np.int64)
        found = []
        for n, steps, links in zip(*(rows.column(c).to_pylist() for c in ("distinct", "places", "links"))):
            at, linked = np.cumsum(_unpacked(steps, n)), _unpacked(links, n)
            found.append((int(best[at] @ linked), int(count[at] @ linked)))
        kept = rows.select([f.name for f in schema.fields[:-2]])
        kept = kept.append_column("n_best", pa.array([f[0] for f in found], pa.int64()))
        return kept.append_column("count_sum", pa.array([f[1] for f in found], pa.int64()))

    done = measured.groupBy("block").cogroup(known.groupBy("list")).applyInArrow(summed, schema)
    return done.select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links"
    )


_LINK = T.StructType([T.StructField(n, T.LongType()) for n in ("at_a", "at_b", "id_a", "id_b", "shared")])


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", by: str = "bytes", files: Files | None = None) -> DataFrame:
    """The links themselves: key, places and ids of two linked tokens, and ``shared``.

    ``by="bytes"``: tokens that overlap, with the number of bytes they share.  ``by="group"``: tokens
    between the same two common ends, with ``shared`` 1.  Texts without tokens have no rows.
    """
    if by not in ("bytes", "group"):
        raise ValueError(f"links by {by}")
    files = files or Files.sent(docs)
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    schema = T.StructType([rows.schema["key"], *_LINK.fields])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = files.sides()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in _runs([len(t.encode()) for t in texts], SLICE_BYTES):
                part = aligned([" " + t if t else "" for t in texts[start:stop]], a, b)
                owner = part.text_of(0)
                first = [np.cumsum(p) - p for p in part.per]
                for i, j, shared in part.overlaps() if by == "bytes" else part.shared_groups():
                    mine = owner[i]
                    numbers = (i - first[0][mine], j - first[1][mine], part.ids[0][i], part.ids[1][j], shared)
                    keys = batch.column(0).take(pa.array(start + mine))
                    yield pa.RecordBatch.from_arrays(
                        [keys, *[pa.array(v.astype(np.int64)) for v in numbers]], names=schema.names
                    )

    return rows.mapInArrow(mapped, schema).withColumnRenamed("key", key)
