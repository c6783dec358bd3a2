"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet on seeds, runs of ``seed_tokens`` tokens with equal
Karp-Rabin hashes.  For every pair with a seed, matching runs are grown from the rolling hashes
and verified; the longest one that overlaps no marked token is marked in both texts, again and
again, and a run that meets marked tokens is cut to what is free.  The tiles may lie in any
order, so a reordered passage is covered like a plain copy.  An item leaks into a document
where its tiles cover at least ``threshold`` of its tokens.  An item shorter than a seed is looked
up by the hash of the whole of it, and leaks where it stands whole.

Documents are never shuffled, and are read once for every 256 MB of benchmark.  The benchmark is
cut into slices of a checked size, which are sent packed to all tasks; a task holds the index of
one slice, and meets a bounded block of documents with each slice in turn.
"""

from __future__ import annotations

import heapq
import pickle
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from farpoint.llm.common import small_batches

SEED_TOKENS = 5
THRESHOLD = 0.5
#: UTF-8 bytes of benchmark text that a task holds at once.
SLICE_BYTES = 8 << 20
#: UTF-8 bytes of benchmark text that one scan of the documents meets; a worker holds them packed.
SCAN_BYTES = 256 << 20
#: Bytes of documents that a task holds while the slices of a scan pass by.
HELD_BYTES = 64 << 20

_TOKEN = re.compile(r"\w+")
# Scripts without spaces: South-East Asian ones, kana, bopomofo, Han.  Each of their letters is a token, with its marks.
_UNSPACED = (
    "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u1b00-\u1b7f\u3005-\u3007\u3021-\u3029\u3031-\u3035\u3038-\u30ff"
    "\u3100-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua980-\ua9ff\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f\U00016fe0-\U0003ffff"
)
_MARKS = "".join(c for c in map(chr, range(0x0E00, 0xAAE0)) if unicodedata.category(c) in ("Mn", "Mc") and re.match(f"[{_UNSPACED}]", c))
_LETTER = re.compile(rf"(?:(?=[{_UNSPACED}])\w)[{_MARKS}]*|[^\W{_UNSPACED}]+")
_MAY_BE_UNSPACED = re.compile("[\u0e00-\U0003ffff]")
_BASE = 0x9E3779B97F4A7C15
_PAIRS = "doc_id {key}, item_id {item}, tokens long, covered long, coverage double, tiles long, longest long"


def tokens_of(text: str) -> list[str]:
    """Runs of letters, digits and underscores in lower case; in scripts without spaces, letter by letter."""
    return (_LETTER if _MAY_BE_UNSPACED.search(text) else _TOKEN).findall(text.lower())


class SeedIndex:
    """The seeds of some benchmark items, and whole the items that are shorter than a seed.

    Seeds with equal hashes form a group.  The hashes are drawn anew until seeds of one group are
    equal, so within the index a group stands for its tokens.
    """

    def __init__(self, items: list[tuple], seed_tokens: int = SEED_TOKENS) -> None:
        self.k = seed_tokens
        self.vocabulary: dict[str, int] = {}
        self.items, self.tokens = [], []
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens_of(text or "")], np.int64)
            if len(ids):
                self.items.append(item_id)
                self.tokens.append(ids)
        seed = 20
        while not self._hashed(seed):
            seed += 1

    def _hashed(self, seed: int) -> bool:
        """Hash all runs; false if two that differ have one hash."""
        mixed = np.random.default_rng(seed).integers(1, 1 << 62, 1 << 16, dtype=np.uint64)
        self._mixed = mixed | np.uint64(1)
        by_length: dict[int, list[int]] = {}
        for number, ids in enumerate(self.tokens):
            by_length.setdefault(min(len(ids), self.k), []).append(number)
        long = by_length.pop(self.k, [])
        runs = [self._rolling(self.tokens[n], self.k) for n in long]
        owners = np.repeat(np.array(long, np.int64), [len(r) for r in runs])
        places = np.concatenate([np.arange(len(r)) for r in runs]) if runs else np.empty(0, np.int64)
        hashes = np.concatenate(runs) if runs else np.empty(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, groups = np.unique(hashes, return_inverse=True)
        #: Where the entries of each group begin, and the item and place of each entry.
        self.bounds = np.searchsorted(groups[order], np.arange(len(self.hashes) + 1))
        self.owners, self.places, self.groups = owners[order], places[order], groups[order]
        # the groups of the seeds one token before and after; -2 where there is none
        inner = owners[1:] == owners[:-1]
        none = np.full(min(1, len(groups)), -2)
        self.before = np.concatenate((none, np.where(inner, groups[:-1], -2)))[order]
        self.after = np.concatenate((np.where(inner, groups[1:], -2), none))[order]
        if not self._same_tokens(self.groups, self.owners, self.places, self.k):
            return False
        #: By length: the hashes of the short items in order, and the items.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, numbers in by_length.items():
            found = np.concatenate([self._rolling(self.tokens[n], k) for n in numbers])
            order = np.argsort(found, kind="stable")
            found, numbers = found[order], np.array(numbers)[order]
            if not self._same_tokens(found, numbers, np.zeros(len(found), np.int64), k):
                return False
            self.short[k] = found, numbers
        return True

    def _same_tokens(self, groups: np.ndarray, owners: np.ndarray, places: np.ndarray, k: int) -> bool:
        if not len(groups):
            return True
        flat = np.concatenate(self.tokens)
        at = np.concatenate(([0], np.cumsum([len(t) for t in self.tokens])))[owners] + places
        alike = groups[1:] == groups[:-1]
        return not any((flat[at[1:] + j] != flat[at[:-1] + j])[alike].any() for j in range(k))

    def _rolling(self, ids: np.ndarray, k: int) -> np.ndarray:
        """Karp-Rabin hash, modulo 2 ** 64, of every run of ``k`` ids."""
        spread = self._mixed[ids & 0xFFFF] * (ids.astype(np.uint64) + np.uint64(0x51ED27))
        n = len(ids) - k + 1
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * np.uint64(_BASE) + spread[j : j + n]
        return out

    def _ids(self, text: str) -> np.ndarray:
        """The tokens of a text; those of no item are 0."""
        known = self.vocabulary.get
        return np.array([known(t, 0) for t in tokens_of(text)], np.int64)

    def _ranks(self, ids: np.ndarray, k: int, hashes: np.ndarray) -> np.ndarray:
        """For every run of ``k`` tokens of a text where its hash stands in ``hashes``, or -1."""
        ranks = np.full(max(0, len(ids) - k + 1), -1)
        if not len(ranks) or not len(hashes):
            return ranks
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        starts = np.flatnonzero(unknown[k:] == unknown[:-k])
        wanted = self._rolling(ids, k)[starts]
        rank = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        ranks[starts] = np.where(hashes[rank] == wanted, rank, -1)
        return ranks

    def found(self, text: str, threshold: float = 0.0) -> list[tuple[int, list[tuple[int, int, int]], int]]:
        """``pairs``, and the short items that stand whole in the text, each where it first does."""
        ids = self._ids(text)
        found = self._pairs(ids, threshold)
        for k, (hashes, numbers) in self.short.items():
            ranks = self._ranks(ids, k, hashes)
            for rank in np.unique(ranks[ranks >= 0]).tolist():
                stop = np.searchsorted(hashes, hashes[rank], "right")
                token = self.tokens[numbers[rank]]
                for start in np.flatnonzero(ranks == rank).tolist():
                    if np.array_equal(ids[start : start + k], token):
                        found += [(n, [(start, 0, k)], k) for n in numbers[rank:stop].tolist()]
                        break
        return found

    def pairs(self, text: str) -> list[tuple[int, list[tuple[int, int, int]], int]]:
        """``(item, tiles, tokens of the item)`` of every item that shares a seed with the text."""
        return self._pairs(self._ids(text))

    def _pairs(self, ids: np.ndarray, threshold: float = 0.0) -> list[tuple[int, list[tuple[int, int, int]], int]]:
        """Tiles of the items whose shared seeds span at least ``threshold`` of their tokens; others can't reach it.

        Items that share the same seeds at the same distances have the same tiles, which are made
        once: a line that very many items hold costs each of them one look.
        """
        ranks = self._ranks(ids, self.k, self.hashes)
        groups = np.unique(ranks[ranks >= 0])
        if not len(groups):
            return []
        entry, _ = _spread(self.bounds[groups], self.bounds[groups + 1])
        entry = entry[np.lexsort((self.places[entry], self.owners[entry]))]
        owner, place = self.owners[entry], self.places[entry]
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        last = np.concatenate((first[1:], [len(owner)]))
        reach = np.full(len(owner), self.k)
        reach[:-1] = np.where(owner[1:] == owner[:-1], np.minimum(self.k, place[1:] - place[:-1]), self.k)
        spanned = np.add.reduceat(reach, first)
        before, after = _Neighbours(ranks, -1), _Neighbours(ranks, 1)
        found, made = [], {}
        for a, b, most in zip(first.tolist(), last.tolist(), spanned.tolist()):
            number = int(owner[a])
            item, base = self.tokens[number], int(place[a])
            if most < threshold * len(item):
                continue
            here = entry[a:b]
            pattern = (place[a:b] - base).tobytes(), self.groups[here].tobytes()
            tiles = made.get(pattern)
            if tiles is None:
                heads = before.unlike(self.groups[here], self.before[here], place[a:b])
                tails = after.unlike(self.groups[here], self.after[here], place[a:b])
                runs = heads[0], heads[1], tails[0] - heads[0] + self.k
                tiles = made[pattern] = [(i, j - base, n) for i, j, n in greedy_tiles(ids, item, *runs, self.k)]
            if tiles:
                found.append((number, [(i, j + base, n) for i, j, n in tiles], len(item)))
        return found


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges ``first <= n < last``, and the range that each is of."""
    count = last - first
    ends = np.cumsum(count)
    which = np.repeat(np.arange(len(count)), count)
    return np.arange(len(which)) - (ends - count)[which] + first[which], which


class _Neighbours:
    """A text's seeds by their group and the group of the seed next to them."""

    def __init__(self, ranks: np.ndarray, step: int) -> None:
        padded = np.concatenate(([-1], ranks, [-1]))
        beside = padded[1 + step : len(padded) - 1 + step]
        at = np.flatnonzero(ranks >= 0)
        self.many = int(ranks.max(initial=0)) + 2
        code = ranks[at] * self.many + beside[at] + 1
        order = np.argsort(code, kind="stable")
        self.at, self.code = at[order], code[order]

    def unlike(self, groups: np.ndarray, beside: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(at, place)``, by diagonal, where the text's seed is the item's but the one next to it is not.

        These are the ends of the runs that text and item share; what lies within a run is never listed.
        """
        low, high = groups * self.many, (groups + 1) * self.many
        same = np.where((beside >= 0) & (beside < self.many - 1), low + beside + 1, low)
        a, b = np.searchsorted(self.code, low), np.searchsorted(self.code, high)
        c = np.where(same == low, a, np.searchsorted(self.code, same))
        d = np.where(same == low, a, np.searchsorted(self.code, same, "right"))
        found, which = _spread(np.concatenate((a, d)), np.concatenate((c, b)))
        at, place = self.at[found], np.concatenate((places, places))[which]
        order = np.lexsort((at, at - place))
        return at[order], place[order]


def greedy_tiles(
    doc: np.ndarray, item: np.ndarray, at: np.ndarray, place: np.ndarray, lengths: np.ndarray, least: int
) -> list[tuple[int, int, int]]:
    """``(start in doc, start in item, length)`` of the tiles, longest first.

    ``at``, ``place`` and ``lengths`` are the runs whose hashes are equal; their tokens are compared
    before they are marked.  Of tiles of one length the one that comes first in the item, then in
    the document, is marked first.  It ends when fewer than ``least`` tokens of the item that any run
    covers are free.
    """
    order = np.lexsort((at, place, -lengths))
    at, place, lengths = at[order], place[order], lengths[order]
    steps = np.bincount(place, minlength=len(item) + 1) - np.bincount(place + lengths, minlength=len(item) + 1)
    in_doc, in_item = np.zeros(len(doc), bool), np.cumsum(steps)[:-1] == 0
    free = len(item) - int(np.count_nonzero(in_item))
    queue, tiles, i_next = [], [], 0
    while free >= least and (queue or i_next < len(at)):
        run = (-int(lengths[i_next]), int(place[i_next]), int(at[i_next])) if i_next < len(at) else None
        if run is None or (queue and queue[0] < run):
            run = heapq.heappop(queue)
        else:
            i_next += 1
        n, j, i = -run[0], run[1], run[2]
        taken = in_doc[i : i + n] | in_item[j : j + n] | (doc[i : i + n] != item[j : j + n])
        if not taken.any():
            in_doc[i : i + n] = True
            in_item[j : j + n] = True
            free -= n
            tiles.append((i, j, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= least:
                heapq.heappush(queue, (a - b, j + a, i + a))
    return tiles


def _scans(benchmark: DataFrame, item: str, text: str, slice_bytes: int, scan_bytes: int) -> Iterator[list[bytes]]:
    """The benchmark in slices of about ``slice_bytes`` of text, packed; one list for each scan of the documents."""
    size = benchmark.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    parts = benchmark.select(item, text).coalesce(max(1, -(-size // slice_bytes)))
    held, inside, packed = [], 0, []
    for row in parts.toLocalIterator():  # a part, about a slice, at a time
        more = len((row[1] or "").encode("utf-8", "surrogatepass"))
        if held and inside + more > slice_bytes:
            packed.append(zlib.compress(pickle.dumps(held)))
            held, inside = [], 0
            if len(packed) * slice_bytes >= scan_bytes:
                yield packed
                packed = []
        held.append(tuple(row))
        inside += more
    yield [*packed, zlib.compress(pickle.dumps(held))]


def _indexes(shared, seed_tokens: int) -> Iterator[SeedIndex]:
    """The index of each broadcast slice in turn; the last one made stays with the worker."""
    name, packed = shared.value
    for n, part in enumerate(packed):
        if (name, n) not in _BUILT:
            _BUILT.clear()
            _BUILT[name, n] = SeedIndex(pickle.loads(zlib.decompress(part)), seed_tokens)
        yield _BUILT[name, n]


_BUILT: dict[tuple[str, int], SeedIndex] = {}


def _held(batches: Iterator[pa.RecordBatch], alone: bool) -> Iterator[pa.RecordBatch]:
    """``batches``; where several slices are to meet each, joined to ``HELD_BYTES`` so that indexes are made seldom."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if alone or size >= HELD_BYTES:
            yield pa.concat_batches(waiting)
            waiting, size = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


def leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seed_tokens: int = SEED_TOKENS,
    key: str = "doc_id", text: str = "text", item: str = "item_id", slice_bytes: int = SLICE_BYTES,
    scan_bytes: int = SCAN_BYTES,
) -> DataFrame:
    """One row for every document and item that leaks into it.

    Gives ``doc_id``, ``item_id``, the item's ``tokens``, how many are ``covered``, the
    ``coverage``, the number of ``tiles`` and the ``longest`` one.  Tokens are runs of letters,
    digits and underscores in lower case; in scripts without spaces, such as Chinese, Japanese and
    Thai, every letter is one.  Null and empty texts leak nothing; items of fewer tokens than a
    seed leak where they stand whole.  Repeated rows give repeated rows.
    """
    types = dict(docs.select(F.col(key).alias("k")).dtypes) | dict(benchmark.select(F.col(item).alias("i")).dtypes)
    schema = StructType.fromDDL(_PAIRS.format(key=types["k"], item=types["i"]))
    arrow = to_arrow_schema(schema)
    rows, found = small_batches(docs).select(key, text), None
    for packed in _scans(benchmark, item, text, slice_bytes, scan_bytes):
        shared, alone = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, packed)), len(packed) == 1

        def matched(batches: Iterator[pa.RecordBatch], shared=shared, alone=alone) -> Iterator[pa.RecordBatch]:
            for batch in _held(batches, alone):
                for index in _indexes(shared, seed_tokens):
                    out = []
                    for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        for number, tiles, tokens in index.found(body or "", threshold):
                            covered = sum(t[2] for t in tiles)
                            if covered >= threshold * tokens:
                                out.append((doc_id, index.items[number], tokens, covered, covered / tokens, len(tiles), tiles[0][2]))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

        part = rows.mapInArrow(matched, schema)
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seed_tokens: int = SEED_TOKENS,
    text: str = "text", item: str = "item_id", slice_bytes: int = SLICE_BYTES, scan_bytes: int = SCAN_BYTES,
) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, with all their columns."""
    at, kept = docs.columns.index(text), small_batches(docs)
    for packed in _scans(benchmark, item, "text", slice_bytes, scan_bytes):
        shared, alone = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, packed)), len(packed) == 1

        def clean(batches: Iterator[pa.RecordBatch], shared=shared, alone=alone) -> Iterator[pa.RecordBatch]:
            for batch in _held(batches, alone):
                for index in _indexes(shared, seed_tokens):
                    stays = [
                        all(sum(t[2] for t in tiles) < threshold * tokens for _, tiles, tokens in index.found(body or "", threshold))
                        for body in batch.column(at).to_pylist()
                    ]
                    batch = batch.filter(pa.array(stays, pa.bool_()))
                yield batch

        kept = kept.mapInArrow(clean, docs.schema)
    return kept
