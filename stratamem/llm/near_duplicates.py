"""Groups of nearly equal texts by an LSH forest.

A text is its set of words (maximal runs of letters or digits, lower-cased). Two texts are
linked if the Jaccard similarity of the sets reaches the threshold; groups are the closed
classes of the links.

Each tree of the forest orders a text's words by a hash of its own and keeps the leading four
as a signature; all signatures of a tree are sorted. Depth adapts by region: a text's region
is the longest run of signatures around it that share the first word and has at most
``REGION`` entries, else the first two, three or four words, and everything in the region is
a candidate. Where even four words leave a fuller region, the nearest ``window`` entries are
candidates and the exact search below takes the rest.
In most trees the hash is weighted, so that rare words tend to come first and texts that only
share common words stay apart; in the others all words weigh the same, so that copies made of
words that are common (a group may be a large part of all texts) meet whatever is added.
Candidates are thinned by a bound that loses nothing (the parity bitmaps of two sets differ
in at most as many bits as the sets differ in words) and then checked exactly. Words found in
only one set are left out of the signatures: no other text can share them.

What the forest leaves in different classes is compared without a cap: two sets that reach
the threshold share one of their first words in any common order, rare words first here, so
all texts with such a word are compared with all others of another class that have it (again
by parity bitmap, then exactly). Its cost grows with the square of a word's texts.

Exact copies are one node, named by the hash of the word set, and never reach the pair stages
twice. Word sets are stored once, bucketed by node, so no later join shuffles them again.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from stratamem.operators.components import connected_components
from stratamem.session import materialize, materialize_bucketed

WORD = re.compile(r"[^\W_]+")
#: Buckets of the document-frequency table: its size, and so the broadcast, never grows.
DF_BUCKETS = 1 << 15
#: Share of documents at which a word's weight has fallen to a half.
HALF_WEIGHT_SHARE = 0.005
LEVELS = 4
#: Trees in which all words weigh the same, of every eight.
EVEN_OF_8 = 3
#: Most entries of a region that is compared whole.
REGION = 64
#: Entries of a tree aimed at in one range, and sets that the ranges' bounds are drawn from
#: (bounds decide which task sorts an entry, not what is found).
RANGE, RANGE_SAMPLE = 40_000, 20_000
#: Texts with one leading word beyond which they are compared block by block.
BLOCK = 1 << 16
#: Members from which a class is set against the others as a whole.
LARGE_CLASS = 64
_U = np.uint64
_LABEL = _U(0x7FFF)
_LAST = _U(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words * np.uint32(2654435761)) >> np.uint32(17)


def words_of(text: str) -> set[str]:
    return {w.lower() for w in WORD.findall(text)}


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[str, int] = {}
    for batch in batches:
        ids, nodes, rows = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = set()
            for w in WORD.findall(text):
                v = cache.get(w)
                if v is None:
                    v = cache[w] = zlib.crc32(w.lower().encode()) - (1 << 31)
                own.add(v)
            if own:
                a = np.fromiter(own, np.int32, len(own))
                a.sort()
                ids.append(key)
                nodes.append(xxhash.xxh3_64_intdigest(a.tobytes()) - (1 << 63))
                rows.append(a)
        if len(cache) > 1_000_000:
            cache.clear()
        offsets = np.zeros(len(rows) + 1, np.int32)
        if rows:
            np.cumsum([len(a) for a in rows], out=offsets[1:])
        values = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, batch.schema.field(0).type), pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
            names=["rec_id", "node", "words"],
        )


def word_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(rec_id, node, words)`` of every text with at least one word; words are sorted 32-bit hashes."""
    src = df.select(F.col(id_col).alias("rec_id"), F.col(text_col).alias("text")).where("rec_id is not null and text is not null")
    kind = src.schema["rec_id"].dataType.simpleString()
    return src.mapInArrow(_word_sets, f"rec_id {kind}, node bigint, words array<int>")


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint32), offsets - offsets[0]


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DF_BUCKETS, np.int64), 0
    for batch in batches:
        words, offsets = _flat(batch.column(0))
        total += np.bincount(_bucket(words), minlength=DF_BUCKETS)
        n += len(offsets) - 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(total[at], n), pa.int64())], names=["bucket", "n"]
    )


def _document_shares(sets: DataFrame) -> tuple[np.ndarray, int]:
    """Share of texts per word bucket, over all texts, and their number."""
    rows = sets.select("words").mapInArrow(_bucket_counts, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = {r["bucket"]: r["n"] for r in rows}
    n_sets = counts.pop(-1, 0)
    out = np.zeros(DF_BUCKETS)
    for k, v in counts.items():
        out[k] = v
    return out / max(1, n_sets), n_sets


def _bitmaps(words: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmap of 112 bits of each set; the upper 16 bits of the second half hold the size."""
    at = _mix(words.astype(_U)) % _U(112)
    bit = _U(1) << (at % _U(64))
    low = np.bitwise_xor.reduceat(np.where(at < 64, bit, _U(0)), starts)
    high = np.bitwise_xor.reduceat(np.where(at >= 64, bit, _U(0)), starts)
    return low, high | np.minimum(lens, 65535).astype(_U) << _U(48)


def _forest_keys(words: np.ndarray, starts: np.ndarray, lens: np.ndarray, single: np.ndarray, weights: np.ndarray, trees: int) -> np.ndarray:
    """Per tree and set the tree's number and the labels of the set's leading words; 0 labels where words run out."""
    out = np.zeros((trees, len(lens)), _U)
    by_length = np.argsort(lens, kind="stable")
    at = 0
    while at < len(by_length):
        upto = at + 1
        while upto < len(by_length) and upto - at < 4096 and (upto + 1 - at) * lens[by_length[upto]] < 2_000_000:
            upto += 1
        rows, wide = by_length[at:upto], int(lens[by_length[upto - 1]])
        at = upto
        span = np.arange(wide)
        place = np.minimum(starts[rows][:, None] + span, len(words) - 1)
        own = words[place]
        shut = (span >= lens[rows][:, None]) | single[place]
        able = (~shut).sum(axis=1)
        weight = weights[_bucket(own)]
        top = min(LEVELS, wide)
        for t in range(trees):
            h = _mix(own.astype(_U) + _U(0x9E3779B97F4A7C15 * (t + 1) & (2**64 - 1)))
            if t % 8 >= EVEN_OF_8:  # an exponential of rate weight: positive floats order as their bits do
                u = ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
                h = (-np.log(u) / weight).view(_U) & ~_LABEL | h & _LABEL
            h[shut] = _LAST
            lead = np.sort(np.partition(h, top - 1, axis=1)[:, :top], axis=1) & _LABEL
            key = np.full(len(rows), t, _U)
            for d in range(LEVELS):
                key = key << _U(15) | (np.where(d < able, lead[:, d], _U(0)) if d < top else _U(0))
            out[t, rows] = key
    return out


def _entries(batch: pa.RecordBatch, weights: np.ndarray, trees: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys by tree, bitmaps and nodes of a batch's sets (node, words, single) that share a word with another set."""
    node = batch.column(0).to_numpy()
    words, offsets = _flat(batch.column(1))
    single, single_offsets = _flat(batch.column(2))
    lens, starts = np.diff(offsets), offsets[:-1].astype(np.int64)
    low, high = _bitmaps(words, starts, lens)
    own = np.zeros(len(words), bool)
    if len(single):
        row = np.repeat(np.arange(len(node)), lens).astype(_U) << _U(32)
        of = np.repeat(np.arange(len(node)), np.diff(single_offsets)).astype(_U) << _U(32)
        own = np.isin(row | words, of | single)
    keys = _forest_keys(words, starts, lens, own, weights, trees)
    some = np.add.reduceat(~own, starts) > 0
    return keys[:, some], low[some], high[some], node[some]


class _Ranges:
    """Which range of its tree's order an entry falls into."""

    def __init__(self, keys: np.ndarray, low: np.ndarray, per_tree: int):
        self.bounds = []
        low = low.view(np.int64)  # as the entries are sorted
        for own in keys:
            order = np.lexsort((low, own))
            cut = order[np.arange(1, per_tree) * len(order) // per_tree] if len(order) else order
            self.bounds.append((own[cut], low[cut]))
        self.per_tree = per_tree

    def of(self, tree: int, key: np.ndarray, low: np.ndarray) -> np.ndarray:
        bound_key, bound_low = self.bounds[tree]
        low = low.view(np.int64)
        first, last = np.searchsorted(bound_key, key, "left"), np.searchsorted(bound_key, key, "right")
        at = first.copy()
        once = np.flatnonzero(last - first == 1)
        at[once] += low[once] >= bound_low[first[once]]
        often = np.flatnonzero(last - first > 1)
        for k in np.unique(key[often]):  # a key of very many entries is cut by their bitmaps
            own = often[key[often] == k]
            at[own] += np.searchsorted(bound_low[first[own[0]] : last[own[0]]], low[own], "right")
        return tree * self.per_tree + at


def _signatures(weights: np.ndarray, trees: int, ranges: _Ranges):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, low, high, node = _entries(batch, weights, trees)
            at = [ranges.of(t, key, low).astype(np.int32) for t, key in enumerate(keys)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(at)),
                    pa.array(np.concatenate(keys).view(np.int64)),
                    pa.array(np.tile(low.view(np.int64), trees)),
                    pa.array(np.tile(high.view(np.int64), trees)),
                    pa.array(np.tile(node, trees)),
                ],
                names=["range", "key", "low", "high", "node"],
            )

    return run


def _depths(key: np.ndarray) -> np.ndarray:
    """The fewest leading words for which an entry's region is at most REGION; one more than LEVELS if none is."""
    depth = np.full(len(key), LEVELS + 1, np.uint8)
    for d in range(LEVELS, 0, -1):
        lead = key >> _U(15 * (LEVELS - d))
        edge = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]]))
        size = np.diff(np.append(edge, len(key)))
        depth[np.repeat(size, size) <= REGION] = d
    return depth


def _pairs_within(now: np.ndarray, slack: float, window: int, part: np.ndarray | None = None) -> np.ndarray:
    """Candidate pairs of sorted entries (of different parts, if given), smaller node first.

    Two entries are candidates if one is in the other's region, or if they share the first
    word and are at most ``window`` places apart.
    """
    key, low, high, node = now
    n = (high >> _U(48)).astype(np.int64)
    open_ended = n >= 65535
    depth = _depths(key)
    found = [np.zeros((2, 0), np.int64)]
    for step in range(1, min(max(window, REGION), len(key) - 1) + 1):
        common = key[step:] ^ key[:-step]
        level = np.minimum(depth[step:], depth[:-step])
        if step <= window:
            level = np.ones_like(level)
        at = np.flatnonzero((level <= LEVELS) & (common >> (_U(15) * np.maximum(0, LEVELS - level.astype(np.int64)).astype(_U)) == 0))
        if not len(at):
            if step > window:
                break  # no region reaches so far
            continue
        to = at + step
        apart = np.bitwise_count(low[to] ^ low[at]).astype(np.int64)
        apart += np.bitwise_count((high[to] ^ high[at]) << _U(16))
        near = (apart <= slack * (n[to] + n[at]) + 1e-9) | open_ended[to] | open_ended[at]
        near &= node[to] != node[at]
        if part is not None:
            near &= part[to] != part[at]
        ends = np.stack([node[at[near]], node[to[near]]]).view(np.int64)
        found.append(np.stack([ends.min(axis=0), ends.max(axis=0)]))
    return np.unique(np.concatenate(found, axis=1), axis=1)


_ENTRIES = ["part", "a", "b", "c", "d"]


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows that agree in the first ``by`` columns, in sorted input, each whole and as record batches."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        lead = np.stack([batch.column(i).to_numpy() for i in range(by)])
        edge = [0, *(np.flatnonzero((lead[:, 1:] != lead[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        if waiting and any(waiting[-1].column(i)[-1].as_py() != int(lead[i, 0]) for i in range(by)):
            yield waiting
            waiting = []
        for a, b in zip(edge, edge[1:]):
            if waiting and a:
                yield waiting
                waiting = []
            waiting.append(batch.slice(a, b - a))
    if waiting:
        yield waiting


def _neighbours(threshold: float, window: int):
    """Pairs ``(-1, a, b, 0, 0)``, and the first and last entries of each range under its number."""
    slack = (1 - threshold) / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _groups(batches, 1):
            now = np.concatenate([np.stack([p.column(i).to_numpy().view(_U) for i in range(1, 5)]) for p in parts], axis=1)
            same = (now[:, 1:] == now[:, :-1]).all(axis=0)  # a run of one set is one entry
            now = now[:, np.append(True, ~same)]
            pairs = _pairs_within(now, slack, window)
            none = np.zeros(pairs.shape[1], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(none.astype(np.int32) - 1), pa.array(pairs[0]), pa.array(pairs[1]), pa.array(none), pa.array(none)], names=_ENTRIES)
            reach = max(window, REGION)
            ends = np.unique(np.concatenate([now[:, :reach], now[:, -reach:]], axis=1), axis=1).view(np.int64)
            part = np.full(ends.shape[1], parts[0].column(0)[0].as_py(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(x) for x in ends)], names=_ENTRIES)

    return run


def _across(threshold: float, window: int):
    """Pairs of neighbours on two sides of a cut, from the ranges' first and last entries."""
    slack = (1 - threshold) / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.stack([c.to_numpy().astype(np.int64) for c in batch.columns]) for batch in batches]
        if rows:
            part, *entry = np.concatenate(rows, axis=1)
            order = np.lexsort((*entry[::-1], part))
            pairs = _pairs_within(np.stack([x[order] for x in entry]).view(_U), slack, max(window, REGION), part[order])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return run


def _blobs(sorted_values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The values between each two bounds as bytes."""
    width = sorted_values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(sorted_values))])


_CELLS = "word int, cell bigint, side int, low binary, high binary, node binary, part binary"


def _prefixes(shares: np.ndarray, threshold: float, n_sets: int):
    """Entries of the words that may be the first shared one of two alike sets, rare words first.

    Sets and classes are told by 32 bits of their names here; the names are looked up again
    for the pairs that come out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, part = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            words, offsets = _flat(batch.column(1))
            lens, starts = np.diff(offsets), offsets[:-1].astype(np.int64)
            low, high = _bitmaps(words, starts, lens)
            row = np.repeat(np.arange(len(node)), lens)
            rank = np.argsort(np.argsort(shares, kind="stable"), kind="stable").astype(_U)[_bucket(words)]
            ordered = words[np.lexsort((rank << _U(32) | words, row))]
            first = lens - np.ceil(threshold * lens - 1e-9).astype(np.int64) + 1
            place = np.arange(len(words)) - starts[row]
            lead = place < first[row]
            word, of = ordered[lead], row[lead]
            # where the smaller of two alike sets has its first shared word
            early = (place <= lens[row] - np.ceil(2 * threshold / (1 + threshold) * lens[row] - 1e-9))[lead]
            blocks = np.maximum(1, -(-np.round(shares[_bucket(word)] * n_sets).astype(np.int64) // BLOCK))
            at = (_mix(node[of].view(_U)) % blocks.astype(_U)).astype(np.int64)
            # a block meets itself and every other once: cell (i, j), i <= j, holds the blocks i and j
            total = int(blocks.sum())
            other = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            for k in range(0, total, 400_000):
                span = np.searchsorted(np.cumsum(blocks), np.arange(k, min(k + 400_000, total)), "right")
                here, there = at[span], other[k : k + 400_000]
                cell, side = np.minimum(here, there) << 24 | np.maximum(here, there), (here > there).astype(np.int32)
                w, x, soon = word[span], of[span], early[span]
                grouped = part[x] != node[x]
                order = np.lexsort((grouped, side, cell, w))
                w, cell, side, x = w[order], cell[order], side[order], x[order]
                marked = high[x] & _U(2**48 - 1) | np.minimum(lens[x], 32767).astype(_U) << _U(48) | soon[order].astype(_U) << _U(63)
                edge = np.flatnonzero((w[1:] != w[:-1]) | (cell[1:] != cell[:-1]) | (side[1:] != side[:-1])) + 1
                bounds = np.concatenate([[0], edge, [len(w)]])
                own, its = (node[x] >> 32).astype(np.int32), (part[x] >> 32).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w[bounds[:-1]].view(np.int32)), pa.array(cell[bounds[:-1]]), pa.array(side[bounds[:-1]]), *(_blobs(v, bounds) for v in (low[x], marked, own, own ^ its))],
                    names=["word", "cell", "side", "low", "high", "node", "part"],
                )

    return run


#: Pairs whose bitmaps are compared at once.
AT_ONCE = 1 << 16


class _Entries:
    """Entries of one cell side by size: bitmaps, short names, sizes, and who may be the smaller of a pair."""

    def __init__(self, low, high, node, part, n, loose, early):
        self.low, self.high, self.node, self.part, self.n, self.loose, self.early = low, high, node, part, n, loose, early

    def __len__(self) -> int:
        return len(self.n)

    def __getitem__(self, at) -> "_Entries":
        return _Entries(*(v[at] for v in (self.low, self.high, self.node, self.part, self.n, self.loose, self.early)))


_room: dict[str, np.ndarray] = {}


def _buffer(name: str, kind: type, shape: tuple[int, int]) -> np.ndarray:
    size = shape[0] * shape[1]
    if name not in _room or len(_room[name]) < size:
        _room[name] = np.empty(max(size, 2 * AT_ONCE), kind)
    return _room[name][:size].reshape(shape)


def _compare(rows: _Entries, others: _Entries | None, slack: float, threshold: float) -> Iterator[np.ndarray]:
    """Pairs of entries (of one list, or of two) in different classes that the bitmaps do not tell apart.

    Within one list the smaller set of a pair must have the word among its first few, which
    its entry tells: that leaves fewer rows.
    """
    to = rows if others is None else others
    mine = np.flatnonzero(rows.early) if others is None else np.arange(len(rows))
    n = rows.n[mine]
    begin = np.searchsorted(to.n, n if others is None else np.ceil(threshold * n - 1e-9), "left")
    end = np.where(n >= 32767 * threshold, len(to), np.searchsorted(to.n, np.floor(n / threshold + 1e-9), "right"))
    step = max(1, min(AT_ONCE // max(1, len(to)), max(64, len(mine) // 6)))
    for i in range(0, len(mine), step):
        own = mine[i : i + step]
        a, b = int(begin[i : i + step].min()), int(end[i : i + step].max())
        if a >= b:
            continue
        wide = -(-(b - a) // 8) * 8  # whole eights of columns, so that hits are found eight at a time
        a = max(0, min(a, len(to) - wide))
        b = min(len(to), a + wide)
        shape = (len(own), b - a)
        differ = np.bitwise_xor(rows.low[own, None], to.low[a:b], out=_buffer("differ", _U, shape))
        count = np.bitwise_count(differ, out=_buffer("count", np.uint8, shape))
        # both halves before hits are looked at one by one: of texts made of common words a quarter agree in the first
        differ = np.bitwise_xor(rows.high[own, None], to.high[a:b], out=differ)
        count += np.bitwise_count(differ, out=_buffer("second", np.uint8, shape))
        most = np.add(rows.loose[own, None], to.loose[a:b], out=_buffer("most", np.uint8, shape))
        near = np.less_equal(count, most, out=_buffer("near", bool, shape)).ravel()
        if len(near) % 8:
            at = np.flatnonzero(near)
        else:
            at = (np.flatnonzero(near.view(_U))[:, None] * 8 + np.arange(8)).ravel()
            at = at[near[at]]
        x, y = own[at // (b - a)], at % (b - a) + a
        keep = (count.ravel()[at] <= slack * (rows.n[x] + to.n[y]) + 1e-9) | (rows.n[x] >= 32767) | (to.n[y] >= 32767)
        x, y = x[keep], y[keep]
        keep = rows.part[x] != to.part[y]
        if keep.any():
            yield np.stack([rows.node[x[keep]], to.node[y[keep]]])


def _cell_pairs(first: _Entries, second: _Entries | None, slack: float, threshold: float) -> Iterator[np.ndarray]:
    """Pairs of one cell: within its only block, or between its two. Large classes meet the others as a whole, never themselves."""
    if second is not None:
        yield from _compare(first, second, slack, threshold)
        return
    if (first.part != first.node).sum() >= LARGE_CLASS:
        names, counts = np.unique(first.part, return_counts=True)
        for name in names[counts >= LARGE_CLASS]:
            mine = first.part == name
            own, first = first[mine], first[~mine]
            yield from _compare(own, first, slack, threshold)
    yield from _compare(first, None, slack, threshold)


def _unpacked(column: pa.BinaryArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].tobytes() if data is not None else b""
    return np.frombuffer(values, kind), np.diff(offsets) // np.dtype(kind).itemsize


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Sorted input in parts that cut no (word, cell) in two."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        word, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = int(np.argmax((word == word[-1]) & (cell == cell[-1])))
        if waiting and (waiting[-1].column(0)[-1].as_py(), waiting[-1].column(1)[-1].as_py()) != (int(word[0]), int(cell[0])):
            yield waiting
            waiting = []
        if cut:
            yield [*waiting, batch.slice(0, cut)]
            waiting = []
        waiting.append(batch.slice(cut))
    if waiting:
        yield waiting


def _cells(threshold: float):
    slack = (1 - threshold) / (1 + threshold)

    def batch_of(found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for parts in _whole_cells(batches):
            word, cell, side = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in range(3))
            (low, each), (high, _), (node, _), (part, _) = (
                tuple(np.concatenate(v) for v in zip(*(_unpacked(p.column(i), kind) for p in parts))) for i, kind in ((3, _U), (4, _U), (5, np.int32), (6, np.int32))
            )
            new = np.concatenate([[True], (word[1:] != word[:-1]) | (cell[1:] != cell[:-1])])
            own, side = np.repeat(np.cumsum(new) - 1, each), np.repeat(side, each)
            n = (high >> _U(48) & _U(0x7FFF)).astype(np.int64)
            order = np.lexsort((n, side, own))
            own, side, n = own[order], side[order], n[order]
            loose = np.where(n >= 32767, 127, np.minimum(np.ceil(slack * n), 127)).astype(np.uint8)
            high = high[order]
            all_ = _Entries(low[order], high & _U(2**48 - 1), node[order], (part ^ node)[order], n, loose, high >> _U(63) == 1)
            start = np.searchsorted(own, np.arange(new.sum() + 1))
            middle = np.searchsorted(own * 2 + side, np.arange(new.sum()) * 2 + 1)
            for k, c in enumerate(cell[new].tolist()):
                s, m, e = int(start[k]), int(middle[k]), int(start[k + 1])
                if c >> 24 == c & 0xFFFFFF:
                    pairs_of = _cell_pairs(all_[s:e], None, slack, threshold) if e - s > 1 else ()
                else:
                    pairs_of = _cell_pairs(all_[s:m], all_[m:e], slack, threshold) if s < m < e else ()
                for pairs in pairs_of:
                    found.append(pairs)
                    size += pairs.shape[1]
                if size > 500_000:
                    yield batch_of(found)
                    found, size = [], 0
        if size:
            yield batch_of(found)

    return run


def _checked(pairs: DataFrame, one: DataFrame, threshold: float) -> DataFrame:
    with_a = pairs.join(one.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a")
    with_b = with_a.join(one.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b")
    both = F.size(F.array_intersect("wa", "wb"))
    return with_b.where(both >= threshold * (F.size("wa") + F.size("wb") - both) - 1e-9).select("a", "b")


def _single_words(one: DataFrame) -> DataFrame:
    """``(node, single)``: the words of a set that no other set has, counted exactly."""
    each = one.select("node", F.explode("words").alias("word"))
    seen = each.groupBy("word").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last")
    return seen.groupBy("node").agg(F.collect_set("word").alias("single"))


def distinct_sets(sets: DataFrame) -> DataFrame:
    """``(node, words)``, one row per word set, bucketed by node."""
    return materialize_bucketed(sets.groupBy("node").agg(F.first("words").alias("words")), "node", "wordsets")


def missing_links(one: DataFrame, classes: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``(a, b)``: links between sets of different ``classes`` (node, component), so that no two classes stay apart."""
    shares, n_sets = _document_shares(one)
    entries = one.join(classes, "node", "left").select("node", "words", F.coalesce("component", "node").alias("part")).mapInArrow(_prefixes(shares, threshold, n_sets), _CELLS)
    near = entries.repartition("word", "cell").sortWithinPartitions("word", "cell").mapInArrow(_cells(threshold), "a int, b int").distinct()
    name = one.select("node", F.shiftright("node", 32).cast("int").alias("short"))
    pairs = near.join(name.select(F.col("short").alias("a"), F.col("node").alias("x")), "a").join(name.select(F.col("short").alias("b"), F.col("node").alias("y")), "b")
    return _checked(materialize(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "pairs"), one, threshold)


def links(one: DataFrame, threshold: float = 0.6, trees: int = 8, window: int = 32) -> DataFrame:
    """``(a, b)``: checked links that the forest finds between different word sets, smaller node first."""
    if not 1 <= trees <= 16:
        raise ValueError("trees must be 1 to 16")
    shares, n_sets = _document_shares(one)
    weights = 1.0 / (1.0 + shares / HALF_WEIGHT_SHARE)
    none = F.array().cast("array<int>")
    drawn = one.where(F.pmod(F.xxhash64("node"), F.lit(2**31)) < int(min(1.0, RANGE_SAMPLE / max(1, n_sets)) * 2**31) + 1).select("node", "words", none.alias("single")).toArrow().sort_by("node").combine_chunks().to_batches()
    keys, low = np.zeros((trees, 0), _U), np.zeros(0, _U)
    if drawn:
        keys, low, _, _ = _entries(drawn[0], weights, trees)
    ranges = _Ranges(keys, low, max(1, min(-(-n_sets // RANGE), keys.shape[1] // 16)))
    marked = one.join(_single_words(one), "node", "left").select("node", "words", F.coalesce("single", none).alias("single"))
    signs = marked.mapInArrow(_signatures(weights, trees, ranges), "range int, key bigint, low bigint, high bigint, node bigint")
    ordered = signs.repartition("range").sortWithinPartitions("range", "key", "low", "high", "node")
    near = materialize(ordered.mapInArrow(_neighbours(threshold, window), "part int, a bigint, b bigint, c bigint, d bigint"), "pairs")
    cut = near.where("part >= 0").repartition(1).mapInArrow(_across(threshold, window), "a bigint, b bigint")  # a bounded number a range
    return _checked(near.where("part < 0").select("a", "b").union(cut).distinct(), one, threshold)


def _joined_classes(classes: DataFrame, more: DataFrame) -> DataFrame:
    """``classes`` (node, component) after further links, which are few: only they are followed, between classes."""
    of_a = classes.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    of_b = classes.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    between = more.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = connected_components(between, "a", "b").select(F.col("node").alias("old"), F.col("component").alias("new"))
    nodes = classes.unionByName(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node", "left_anti").withColumn("component", F.col("node")))
    return nodes.join(merged, nodes["component"] == merged["old"], "left").select("node", F.coalesce("new", "component").alias("component"))


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.6, trees: int = 8, window: int = 32) -> DataFrame:
    """One row per text with a word: ``(rec_id, node, group_id, n_links)``.

    ``group_id`` is the smallest node of the closed class (a text alike no other is its own
    class); ``n_links`` counts the different word sets its own set was found linked to, which
    in a class may be fewer than all. Null ids, null texts and texts without any word have no
    row; repeated rows stay repeated. Copies share a node. The classes are whole: links the
    trees miss between two classes are searched for exactly.
    """
    sets = materialize(word_sets(df, id_col, text_col), "wordsets")
    one = distinct_sets(sets)
    edges = materialize(links(one, threshold, trees, window), "links")
    classes = connected_components(edges, "a", "b")
    more = materialize(missing_links(one, classes, threshold), "links")
    if more.take(1):
        edges = edges.union(more)
        classes = _joined_classes(classes, more)
    classes = classes.withColumnRenamed("node", "of")
    degree = edges.select(F.col("a").alias("node")).union(edges.select("b")).groupBy("node").agg(F.count("*").alias("deg"))
    named = classes.join(degree.withColumnRenamed("node", "of"), "of", "left")
    return (
        sets.select("rec_id", "node")
        .join(named, F.col("node") == F.col("of"), "left")
        .select("rec_id", "node", F.coalesce("component", "node").alias("group_id"), F.coalesce("deg", F.lit(0)).cast("bigint").alias("n_links"))
    )


def grouped_pairs(groups: DataFrame) -> DataFrame:
    """``(cand_a, cand_b)``: every two different ids of one group, smaller first."""
    ids = groups.select("group_id", "rec_id").distinct()
    a, b = ids.select("group_id", F.col("rec_id").alias("cand_a")), ids.select("group_id", F.col("rec_id").alias("cand_b"))
    return a.join(b, "group_id").where("cand_a < cand_b").select("cand_a", "cand_b")
