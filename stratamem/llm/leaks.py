"""Evaluation passages inside a training corpus, by latent semantic retrieval.

Documents and held-out items are cut into overlapping passages of words. Passages are TF-IDF
vectors over the items' vocabulary; document frequencies are counted over all documents, and
a passage of which less than ``KNOWN`` of the words are in that vocabulary has no vector worth
comparing. A randomised SVD gives the latent space: the range finder's products with the
passages of the corpus are summed over all partitions, so only matrices of vocabulary times
rank reach the driver, and the items' vocabulary is the bound on that. Candidates are the
pairs of a document's and an item's passage whose latent vectors have a cosine over a bar;
nothing else finds candidates. Each is then checked by its words: the document holds the
asked number of consecutive item words, at most one damaged (kind ``verbatim``), or its
longest common subsequence with the item covers a large part of the item and the item's
answer stands there too (kind ``reworded``).

Items are taken in blocks of at most ``ITEM_BLOCK``, so what is broadcast has a bound.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratamem.llm.visual_forms import INVISIBLE, _SHAPE
from stratamem.session import materialize

WORD = re.compile(r"[^\W_]+")
_TIME = r"(?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?"
_CUE_LINE = re.compile(
    rf"^[ \t]*(?:\d+[ \t]*$|(?:\d+[ \t]+)?{_TIME}[ \t]*(?:-->|->|-|–)[ \t]*{_TIME}(?:[ \t]+\w+:\S+)*[ \t]*\|?|WEBVTT.*$|(?:NOTE|STYLE|REGION)\b.*$)", re.M
)
_MARKUP = re.compile(r"</?[^<>\n]{0,80}>|\{\\[^{}\n]{0,80}\}|&(?:nbsp|amp|lt|gt|quot|#\d+);")
_SOUND = re.compile(r"\[[^\[\]]{0,200}\]|\([^()]{0,200}\)|\*[^*\n]{1,200}\*|♪[^♪\n]{0,200}♪|[♪♫#]+")
#: Words of a passage and the step between passages.
PASSAGE, STEP = 16, 4
RANK = 96
#: Words of a passage that must be in the items' vocabulary.
KNOWN = 11
#: Cosine from which two passages are candidates. Measured against every pair, see the README.
COSINE = 0.25
#: Items searched for at once: the bound of the vocabulary, the latent space and the broadcast.
ITEM_BLOCK = 5_000
#: Share of an item's words that a reworded copy has in the item's order.
REWORDED = 0.6


def folded(text: str) -> str:
    """One form of a text for comparing words: shapes of letters made one, no accents, lower case."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", INVISIBLE.sub("", text)).translate(_SHAPE)
        text = "".join(c for c in text if not unicodedata.combining(c))
    return text.lower()


def _spoken(text: str) -> str:
    """The text without cue numbers, times, markup and sound notes."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text))
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return _SOUND.sub(" ", _MARKUP.sub("", _CUE_LINE.sub("", text)))


def spoken_words(text: str) -> list[str]:
    return WORD.findall(folded(_spoken(text)))


#: Words of the pieces between spaces, which repeat from text to text.
_folds: dict[str, tuple[str, ...]] = {}


def _words(text: str) -> list[str]:
    """The words of the folded text. Folding stops at spaces, so each piece is folded once."""
    if text.isascii():
        return WORD.findall(text.lower())
    if len(_folds) > 200_000:
        _folds.clear()
    out: list[str] = []
    for piece in text.split():
        own = _folds.get(piece)
        if own is None:
            own = tuple(WORD.findall(folded(piece)))
            if len(piece) <= 40:
                _folds[piece] = own
        out += own
    return out


def _readings(text: str) -> list[list[str]]:
    """The words of a subtitle text; where lines repeat the line before (roll-up captions), also without those."""
    plain = _spoken(text)
    out = [_words(plain)]
    lines, last, rolled = [], "", False
    for line in plain.replace(" / ", "\n").split("\n"):
        now = line.strip(" \t|-")
        if now and now == last:
            rolled = True
        elif now:
            lines.append(now)
            last = now
    if rolled:
        out.append(_words("\n".join(lines)))
    return out


# Shapes that character recognition confuses.
_CONFUSED = (("rn", "m"), ("vv", "w"), ("cl", "d"), ("0", "o"), ("1", "l"), ("i", "l"), ("5", "s"), ("t", "f"), ("c", "e"), ("8", "b"), ("6", "b"), ("9", "g"), ("h", "b"), ("u", "v"))


def _ocr(word: str) -> str:
    for a, b in _CONFUSED:
        word = word.replace(a, b)
    return word


def _distance(a: str, b: str, most: int) -> int:
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def damaged(seen: str, meant: str) -> bool:
    """Whether ``seen`` can be a damaged ``meant``."""
    if seen == meant or _ocr(seen) == _ocr(meant):
        return True
    most = max(1, len(meant) // 3)
    return _distance(seen, meant, most) <= most


def longest_passage(words: list[str], starts: list[int], item: list[str], where: dict[str, list[int]], least: int) -> int:
    """Most consecutive item words in ``words``, at most one damaged, near the given starts; 0 if under ``least``.

    A run of agreeing words is extended over one damaged word to the run behind it; a damaged
    word at an end counts. A word written as two, or two run together, also pass for one
    damage here, though the passages around must be long enough to become candidates.
    """
    best, upto = 0, -1
    for s in sorted(starts):
        for i in range(max(0, s - PASSAGE, upto), min(len(words), s + 2 * PASSAGE)):
            upto = i + 1
            for j in where.get(words[i], ()):
                if i and j and words[i - 1] == item[j - 1]:
                    continue
                n = _run(words, i, item, j)
                best = max(best, n)
                x, y = i + n, j + n
                if y < len(item) and x < len(words):
                    for dx, dy in ((1, 1), (2, 1), (1, 2)):
                        if x + dx <= len(words) and y + dy <= len(item):
                            m = n + dy + _run(words, x + dx, item, y + dy)
                            if m >= max(least, best + 1) and damaged("".join(words[x : x + dx]), "".join(item[y : y + dy])):
                                best = m
                if i and j and n + 1 >= max(least, best + 1) and damaged(words[i - 1], item[j - 1]):
                    best = n + 1
    return best if best >= least else 0


def _run(words: list[str], i: int, item: list[str], j: int) -> int:
    n = 0
    while i + n < len(words) and j + n < len(item) and words[i + n] == item[j + n]:
        n += 1
    return n


def common_subsequence(seen: list[str], where: dict[str, int]) -> int:
    """Length of the longest common subsequence with an item, whose words' places are bits in ``where``."""
    row = 0
    for w in seen:
        here = where.get(w, 0)
        x = row | here
        row = x & ~(x - (row << 1 | 1))
    return row.bit_count()


class _Vocabulary:
    """A block of items: their words and places, answers, and which words each has."""

    def __init__(self, items: list[tuple[int, list[str], list[str]]]):
        self.items = items
        self.index = {w: k for k, w in enumerate(sorted({w for _, words, _ in items for w in words}))}
        self.where, self.bits = [], []
        keys, pairs = [], []
        for k, (_, words, _) in enumerate(items):
            at: dict[str, list[int]] = {}
            for j, w in enumerate(words):
                at.setdefault(w, []).append(j)
            self.where.append(at)
            self.bits.append({w: sum(1 << j for j in places) for w, places in at.items()})
            keys += [k * len(self.index) + self.index[w] for w in at]
            pairs += [(k * len(self.index) + self.index[v]) * len(self.index) + self.index[w] for v, w in zip(words, words[1:])]
        self.answers: dict[str, list[int]] = {}
        for k, (_, _, answer) in enumerate(items):
            for w in set(answer):
                self.answers.setdefault(w, []).append(k)
        self.answer_size = np.array([len(set(answer)) for _, _, answer in items])
        # (item, word) and (item, word, next word) as bitmaps of hashed places, 16 for each: a few others pass, none is lost.
        self.has, self.follows = (np.zeros(1 << max(16, (16 * len(x)).bit_length()), bool) for x in (keys, pairs))
        rng = np.random.default_rng(7)
        self.of_item, self.of_word = (rng.integers(0, len(self.has), n, np.uint32) for n in (len(items), len(self.index) + 1))
        self.of_word[-1] = len(self.has)  # no known word: places in a second half without marks
        item, word = np.divmod(np.array(keys, np.int64), len(self.index))
        self.has = np.concatenate([self.has, np.zeros_like(self.has)])
        self.has[self.of_item[item] ^ self.of_word[word]] = True
        self.follows[self._place(np.array(pairs, np.int64), self.follows)] = True

    @staticmethod
    def _place(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
        return (keys * 2654435761 >> 7) & (len(table) - 1)

    def member(self, item: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which words of the passages at ``starts`` the items have; a rare other pair may pass."""
        seen = np.lib.stride_tricks.sliding_window_view(self.of_word[ids], PASSAGE)[starts]
        return self.has[np.bitwise_xor(seen, self.of_item[item][:, None], out=seen)]

    def answered(self, words: set[str]) -> np.ndarray:
        """Of which items all words of the answer are among these; of none whose answer has no word."""
        n = np.zeros(len(self.items), np.int64)
        for w in self.answers.keys() & words:
            n[self.answers[w]] += 1
        return (self.answer_size > 0) & (n == self.answer_size)

    def next_to(self, item: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether each word and the next follow each other in the items; a rare other pair may pass."""
        both = (ids[:, :-1] >= 0) & (ids[:, 1:] >= 0)
        return both & self.follows[self._place((item * len(self.index) + ids[:, :-1]) * len(self.index) + ids[:, 1:], self.follows)]

    def ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.get, words, repeat(-1)), np.int32, len(words))


def _starts(ids: np.ndarray) -> np.ndarray:
    """Starts of the passages, at every step, of which enough words are in the vocabulary; a short text is one passage."""
    known = np.concatenate([[0], np.cumsum(ids >= 0)])
    at = np.arange(0, max(1, len(ids) - PASSAGE + STEP), STEP)
    full = known[np.minimum(at + PASSAGE, len(ids))] - known[at]
    return at[full >= min(KNOWN, len(ids))] if len(ids) else at[:0]


def _compact(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words under the passages only, end to end with a passage of nothing behind, and the starts among them."""
    ids = np.concatenate([ids, np.full(PASSAGE, -1, np.int32)])
    keep = np.zeros(len(ids) + 1, np.int32)
    np.add.at(keep, starts, 1)
    np.add.at(keep, np.minimum(starts + PASSAGE, len(ids)), -1)
    keep = np.cumsum(keep[:-1]) > 0
    at = (np.cumsum(keep) - 1)[starts]
    return np.concatenate([ids[keep], np.full(PASSAGE, -1, np.int32)]), at


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Words handled at once; bounds a task's memory.
CHUNK = 20_000


def _chunks(ids_of: pa.ListArray, at_of: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows laid end to end: their word ids, their passage starts and whose they are."""
    ids, id_offsets = _flat(ids_of)
    at, at_offsets = _flat(at_of)
    row = np.repeat(np.arange(len(ids_of)), np.diff(at_offsets))
    at = at + id_offsets[:-1][row]
    k = 0
    while k < len(ids_of):
        upto = max(k + 1, int(np.searchsorted(id_offsets, id_offsets[k] + CHUNK, "right")) - 1)
        upto = min(upto, len(ids_of))
        s, e = at_offsets[k], at_offsets[upto]
        if e > s:
            yield ids[id_offsets[k] : id_offsets[upto]], at[s:e] - id_offsets[k], row[s:e]
        k = upto


def _passages_times(ids: np.ndarray, starts: np.ndarray, idf: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of the passages' TF-IDF vectors with ``right``, by sums over quarters of a passage, and their lengths squared."""
    rows = np.vstack([idf[:, None] * right, np.zeros((1, right.shape[1]))]).astype(np.float32)
    each = rows[ids]
    pairs = each[:-1] + each[1:]
    quarters = np.add(pairs[:-2], pairs[2:], out=each[:-3])
    sums = quarters[starts]
    for k in range(PASSAGE // 4, PASSAGE, PASSAGE // 4):
        sums += quarters[starts + k]
    own = np.append(idf, 0.0)[ids]
    size = np.concatenate([[0.0], np.cumsum(own * own)])
    return sums, np.maximum(size[starts + PASSAGE] - size[starts], 1e-9)


def _prepared(vocab):
    """Per reading of a document with a passage: its words, ids and passage starts; at the end of a partition: word counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocab.value
        total, docs, kind = np.zeros(len(own.index) + 1, np.int64), 0, None
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        names = ["doc_id", "words", "ids", "at", "place", "terms", "counts"]
        for batch in batches:
            kind = batch.schema.field(0).type
            rows: list[list] = [[], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs += 1
                for k, words in enumerate(_readings(text)):
                    ids = own.ids(words)
                    if not k:
                        total[np.unique(ids)] += 1  # words outside the vocabulary count in the last place
                    starts = _starts(ids)
                    if len(starts):
                        short, at = _compact(ids, starts)
                        for column, value in zip(rows, (key, " ".join(words), short, at, starts)):
                            column.append(value)
            n = len(rows[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], kind), pa.array(rows[1], pa.string()), *(pa.array(r, ints) for r in rows[2:]), pa.nulls(n, ints), pa.nulls(n, longs)], names=names
            )
        if docs:
            at = np.flatnonzero(total[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, kind), pa.nulls(1, pa.string()), *(pa.nulls(1, ints) for _ in range(3)), pa.array([[*at.tolist(), -1]], ints), pa.array([[*total[at].tolist(), docs]], longs)], names=names
            )

    return run


#: Terms in one block of a product's rows.
BLOCK = 512


def _product(idf: np.ndarray, right: np.ndarray):
    """Blocks of A'(A right) over this partition's passages A."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(right.shape)
        for batch in batches:
            for ids, starts, _ in _chunks(batch.column(0), batch.column(1)):
                _add_product(out, ids, starts, idf, right)
        yield _blocks(out)

    return run


def _add_product(out: np.ndarray, ids: np.ndarray, starts: np.ndarray, idf: np.ndarray, right: np.ndarray) -> None:
    y, squared = _passages_times(ids, starts, idf, right)
    y /= squared[:, None].astype(np.float32)
    cover = np.zeros((len(ids) + 1, right.shape[1]), np.float32)
    cover[starts] += y  # starts differ, and so do ends
    cover[starts + PASSAGE] -= y
    np.cumsum(cover, axis=0, out=cover)
    known = np.flatnonzero(ids >= 0)
    order = known[np.argsort(ids[known], kind="stable")]
    terms, first = np.unique(ids[order], return_index=True)
    if len(terms):
        out[terms] += idf[terms][:, None] * np.add.reduceat(cover[order], first, axis=0)


def _blocks(out: np.ndarray) -> pa.RecordBatch:
    parts = [out[k : k + BLOCK].tobytes() for k in range(0, len(out), BLOCK)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["block", "part"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a = np.frombuffer(part)
            sums[k] = sums[k] + a if k in sums else a
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([a.tobytes() for a in sums.values()], pa.binary())], names=["block", "part"])


def _gram_times(passages: DataFrame, idf: np.ndarray, right: np.ndarray, item_side: tuple[pa.ListArray, pa.ListArray]) -> np.ndarray:
    summed = passages.mapInArrow(_product(idf, right), "block int, part binary").repartition("block").mapInArrow(_summed, "block int, part binary")
    out = np.zeros(right.shape)
    for r in summed.collect():
        a = np.frombuffer(r["part"]).reshape(-1, right.shape[1])
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(a)] += a
    for ids, starts, _ in _chunks(*item_side):
        _add_product(out, ids, starts, idf, right)
    return out


def latent_space(passages: DataFrame, idf: np.ndarray, item_side: tuple[pa.ListArray, pa.ListArray], rank: int = RANK, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and values of the unit TF-IDF passages ``(ids, at)`` of corpus and items, by randomised SVD.

    A Gaussian test matrix, one power iteration and a Rayleigh-Ritz step; each of the two
    passes sums A'(A X) over the partitions.
    """
    n = len(idf)
    wide = min(n, rank + 16)
    q, _ = np.linalg.qr(_gram_times(passages, idf, np.random.default_rng(seed).standard_normal((n, wide)), item_side))
    z = _gram_times(passages, idf, q, item_side)
    small = q.T @ z
    vals, vecs = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(vals)[::-1][: min(rank, wide)]
    return q @ vecs[:, order], np.sqrt(np.maximum(vals[order], 0))


def _latent(ids: np.ndarray, starts: np.ndarray, idf: np.ndarray, space: np.ndarray) -> np.ndarray:
    y, _ = _passages_times(ids, starts, idf, space)
    return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), np.float32(1e-12))


def _near(near: np.ndarray, latent: np.ndarray, item_of: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a passage and an item, of which any passage has a cosine over the bar to it; block by block, by item."""
    width = len(near)
    near = np.concatenate([near, np.zeros((-width % 8, near.shape[1]), near.dtype)])  # whole eights of passages are marked at once
    marks = np.zeros((int(item_of[-1]) + 1, len(near)), bool)
    for b in range(0, len(latent), 4096):
        own = item_of[b : b + 4096]
        edge = np.flatnonzero(np.append(True, own[1:] != own[:-1]))  # an item's passages lie together
        for a in range(0, len(near), 1024):
            hit = (latent[b : b + 4096] @ near[a : a + 1024].T) >= cosine
            marks[own[edge], a : a + 1024] |= np.bitwise_or.reduceat(hit.view(np.uint64), edge, axis=0).view(bool)
    item, row = np.divmod(np.flatnonzero(marks), len(near))
    return row[row < width], item[row < width]


def _has_answer(seen: list[str], answer: list[str]) -> bool:
    return bool(answer) and set(answer) <= set(seen)


def _search(known, least: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, idf, space, latent, item_of = known.value
        span = np.arange(PASSAGE)
        shared = 2 * PASSAGE // 3
        for batch in batches:
            keys = batch.column(0).to_pylist()
            place, _ = _flat(batch.column(4))
            done = 0
            cands: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
            for ids, starts, rows in _chunks(batch.column(2), batch.column(3)):
                # a pair of a passage and an item once, however many of the item's passages are near
                r, item = _near(_latent(ids, starts, idf, space), latent, item_of, cosine)
                has = own.member(item, ids, starts[r])
                n = np.bitwise_count(has.view(np.uint64)).sum(axis=1, dtype=np.uint8)
                able = np.flatnonzero(n >= min(shared, least - 1))
                r, item, has, n = r[able], item[able], has[able], n[able]
                run_ = np.cumsum(has, axis=1, dtype=np.int8)
                run_[:, least:] -= run_[:, :-least].copy()
                strict = run_[:, least - 1 :].max(axis=1, initial=0) >= least - 1
                # one damaged word breaks two of a run's pairs; half of them is asked for, as an alignment follows
                seen = ids[starts[r[strict]][:, None] + span]
                strict[strict] = own.next_to(item[strict][:, None], seen).sum(axis=1) >= max(0, min(least - 3, least // 2))
                # a text without an item's answer cannot hold it reworded; its other passages count only beside a strict one
                first = rows[0]
                told = np.stack([own.answered(set(batch.column(1)[k].as_py().split(" "))) for k in range(first, rows[-1] + 1)])
                pair = rows[r] - first, item
                told[pair[0][strict], item[strict]] = True
                keep = np.flatnonzero(strict | (n >= shared) & told[pair])
                for k, i, s, exact in zip(rows[r[keep]].tolist(), item[keep].tolist(), place[done + r[keep]].tolist(), strict[keep].tolist()):
                    at = cands.setdefault((k, i), ([], []))
                    at[0 if exact else 1].append(s)
                done += len(starts)
            texts: dict[int, tuple[list[str], set[str]]] = {}
            out: list[tuple] = []
            for (k, i), (exact, near) in cands.items():
                if k not in texts:
                    words = batch.column(1)[k].as_py().split(" ")
                    texts[k] = words, set(words)
                (words, all_words), (name, item, answer) = texts[k], own.items[i]
                if not exact and not (answer and all_words.issuperset(answer) and sum(w in all_words for w in item) >= REWORDED * len(item)):
                    continue
                n = longest_passage(words, sorted(set(exact)), item, own.where[i], least) if exact else 0
                first, last = min(exact + near), max(exact + near) + PASSAGE
                around = words[max(0, first - len(item)) : last + len(item)] if last - first <= 2 * len(item) else words
                both = common_subsequence(around, own.bits[i])
                told = _has_answer(around, answer)
                if n:
                    out.append((keys[k], name, n, both, told, "verbatim"))
                elif both >= REWORDED * len(item) and told:
                    out.append((keys[k], name, 0, both, told, "reworded"))
            columns = list(zip(*out)) or [[]] * 6
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(v), kind) for v, kind in zip(columns, kinds)], names=["doc_id", "item_id", "n_words", "n_common", "has_answer", "kind"])

    return run


def _leaks_of(src: DataFrame, held: list[tuple[int, list[str], list[str]]], least: int, cosine: float) -> DataFrame:
    """Leaks of one block of items."""
    spark = src.sparkSession
    kind = src.schema["doc_id"].dataType.simpleString()
    own = _Vocabulary(held)
    vocab = spark.sparkContext.broadcast(own)
    ready = materialize(src.mapInArrow(_prepared(vocab), f"doc_id {kind}, words string, ids array<int>, at array<int>, place array<int>, terms array<int>, counts array<bigint>"), "passages")
    counted = ready.where("terms is not null").select(F.explode(F.arrays_zip("terms", "counts")).alias("c")).groupBy("c.terms").agg(F.sum("c.counts").alias("n")).collect()
    counts = {r["terms"]: r["n"] for r in counted}  # no more rows than the items have words
    n_docs = counts.pop(-1, 0)
    df = np.zeros(len(own.index))
    for k, n in counts.items():
        df[k] = n
    idf = np.log((1 + n_docs) / (1 + df)) + 0.05
    cut = [(own.ids(w), np.arange(0, max(1, len(w) - least + 1), STEP)) for _, w, _ in held]
    padded = [(np.concatenate([ids, np.full(2 * PASSAGE, -1, np.int32)]), at) for ids, at in cut]
    item_side = tuple(pa.array([x[j] for x in padded], pa.list_(pa.int32())) for j in (0, 1))
    passages = ready.where("doc_id is not null")
    space, _ = latent_space(passages.select("ids", "at"), idf, item_side)
    latent, item_of = [], []
    for ids, starts, rows in _chunks(*item_side):
        latent.append(_latent(ids, starts, idf, space))
        item_of.append(rows)
    known = spark.sparkContext.broadcast((own, idf, space, np.concatenate(latent), np.concatenate(item_of)))
    return passages.select("doc_id", "words", "ids", "at", "place").mapInArrow(_search(known, least, cosine), f"doc_id {kind}, item_id bigint, n_words int, n_common int, has_answer boolean, kind string")


def leaked_items(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "text", answer_col: str = "answer", least: int = 12, cosine: float = COSINE) -> DataFrame:
    """``(doc_id, item_id, n_words, n_common, has_answer, kind)``: documents in which a passage of an item occurs.

    Kind ``verbatim``: the document holds ``least`` consecutive words of the item, one may be
    damaged; ``n_words`` is the longest such run found. Kind ``reworded``: no such run, but the
    longest common subsequence with the item, ``n_common`` words, is at least ``REWORDED`` of
    the item, and all words of the item's answer stand there. ``items`` is the held-out set, a
    query set of fixed size; it is collected block by block. Items of fewer words than
    ``least`` or with a null id cannot leak; a null answer, or a table without that column,
    has no reworded leaks; ``least`` may be 2 to PASSAGE - STEP + 1. Documents with a null id
    or text take no part; a repeated id gives one row per item. Words of a document are read
    with and without the repeated lines of roll-up captions.
    """
    if not 2 <= least <= PASSAGE - STEP + 1:
        raise ValueError(f"least must be 2 to {PASSAGE - STEP + 1}")
    spark = documents.sparkSession
    answer = F.col(answer_col) if answer_col in items.columns else F.lit(None).cast("string")
    rows = items.select(F.col(item_col).cast("bigint").alias("i"), F.col(passage_col).alias("t"), answer.alias("a")).where("i is not null and t is not null").distinct()
    src = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    kind = src.schema["doc_id"].dataType.simpleString()
    blocks = max(1, -(-rows.count() // ITEM_BLOCK))
    found = spark.createDataFrame([], f"doc_id {kind}, item_id bigint, n_words int, n_common int, has_answer boolean, kind string")
    for k in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("i", "t", "a"), F.lit(blocks)) == k).orderBy("i", "t", "a").collect()
        held = [(r["i"], w, WORD.findall(folded(r["a"] or ""))) for r in block if len(w := WORD.findall(folded(r["t"]))) >= least]
        if held:
            found = found.unionByName(_leaks_of(src, held, least, cosine))
    best = F.max(F.struct("n_words", "n_common", "has_answer", "kind")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")
