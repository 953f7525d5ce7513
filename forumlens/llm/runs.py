"""Runs of repeated words, found on a grammar of the word ids.

A run is a stretch of words with smallest period q that is at least LEAST words and
FOLD periods long and that no neighbouring word extends. Texts of a slice are
written as one grammar by Re-Pair: frequent neighbours become nonterminals, again
and again, in rounds that replace every pair that is more frequent than the pairs
it overlaps. What is left of each text is paired into a balanced tree, so that
every text is one symbol.

A run crosses the boundary of the lowest symbol that holds it, and FOLD >= 4 puts
two periods of it on one side of that boundary. So each symbol X = Y Z is looked at
once, wherever it occurs: periods q with a square that ends or begins at its
boundary are found by comparing hashes of q words, then confirmed and extended word
by word within X. Runs of a symbol are moved to all its positions by walking the
derivation down from the texts, and of the intervals of one period those that lie
inside another are dropped: they are the same run, seen by a symbol that ends in it.

Words are compared as 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.llm.common import binary_texts, mixed, powers_of, slices, word_hashes, words_of

#: Words of a run at least, and periods of a run at least; the search needs FOLD >= 4.
LEAST, FOLD = 6, 4
#: A round that shortens the texts by less than one part in so many is the last one.
SHRINK = 50
#: Pairs of symbol and period that are looked at together.
TOGETHER = 1 << 18

SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string")


class Grammar:
    """Nonterminals in the order they were made: two symbols each, their length, and one place where they stand.

    Symbols below ``words`` are words, of length one. ``layers`` has the first
    symbol of each round; a symbol is made of symbols of earlier rounds.
    """

    def __init__(self, ids: np.ndarray):
        self.words = int(ids.max()) + 1 if len(ids) else 0
        first = np.zeros(self.words, np.int64)
        first[ids] = np.arange(len(ids))
        none = np.full(self.words, -1, np.int64)
        self.left, self.right, self.length, self.place = [none], [none], [np.ones(self.words, np.int64)], [first]
        self.layers, self.size = [0, self.words], self.words

    def add(self, left: np.ndarray, right: np.ndarray, length: np.ndarray, place: np.ndarray) -> int:
        """Take in a round of new symbols; returns the number of the first."""
        number = self.size
        for kept, new in ((self.left, left), (self.right, right), (self.length, length), (self.place, place)):
            kept.append(new)
        self.size += len(left)
        self.layers.append(self.size)
        return number

    def closed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate(part) for part in (self.left, self.right, self.length, self.place))


def _replaced(ids, doc, place, length, number, hit, symbol):
    """The sequence after the pairs at ``hit`` became the symbols ``number + symbol``."""
    ids, length = ids.copy(), length.copy()
    ids[hit] = number + symbol
    length[hit] += length[hit + 1]
    keep = np.ones(len(ids), bool)
    keep[hit + 1] = False
    return ids[keep], doc[keep], place[keep], length[keep]


def compress(ids: np.ndarray, doc: np.ndarray) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """A grammar of the words of all texts, and the symbol and the first word of each text that has words.

    ``doc`` numbers the text of each word; no symbol reaches over two texts.
    """
    grammar = Grammar(ids)
    place, length = np.arange(len(ids)), np.ones(len(ids), np.int64)
    while len(ids) > 1:
        inside = doc[1:] == doc[:-1]
        pairs = (ids[:-1] << 32) + ids[1:]
        pairs[~inside] = -1
        distinct, which, count = np.unique(pairs, return_inverse=True, return_counts=True)
        if distinct[0] == -1:
            count[0] = 0
        # The rank of a pair: by count, ties by the pair. Pairs that stand once have none.
        rank = np.empty(len(distinct), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(1, len(distinct) + 1)
        rank[count < 2] = 0
        ranks = np.concatenate([[0], rank[which], [0]])
        # Neighbours of equal rank are one pair of a repeated symbol: every second one of those is taken.
        begins = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        begins = np.concatenate([[0], begins])
        ends = np.append(begins[1:], len(ranks))
        own = ranks[begins]
        before, after = np.concatenate([[0], own[:-1]]), np.append(own[1:], 0)
        top = (own > before) & (own > after)
        sizes = (ends - begins)[top]
        inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        hit = (np.repeat(begins[top], sizes) + inner)[inner % 2 == 0] - 1
        made = np.unique(which[hit], return_index=True, return_inverse=True)
        if len(hit) * SHRINK < len(ids):
            break
        example = hit[made[1]]
        number = grammar.add(ids[example], ids[example + 1], length[example] + length[example + 1], place[example])
        ids, doc, place, length = _replaced(ids, doc, place, length, number, hit, made[2])
    # What is left of each text becomes a balanced tree.
    while True:
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
        if len(first) == len(ids):
            return grammar, ids, place
        sizes = np.diff(np.append(first, len(ids)))
        inner = np.arange(len(ids)) - np.repeat(first, sizes)
        hit = np.flatnonzero((inner % 2 == 0) & (inner + 1 < np.repeat(sizes, sizes)))
        number = grammar.add(ids[hit], ids[hit + 1], length[hit] + length[hit + 1], place[hit])
        ids, doc, place, length = _replaced(ids, doc, place, length, number, hit, np.arange(len(hit)))


def _squares(sums, powers, border, room, ending: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the border, period) of squares that begin or end at a border and have ``2 * period <= room``."""
    reach = room // 2
    todo = np.flatnonzero(reach > 0)
    upto = np.cumsum(reach[todo])
    at = 0
    while at < len(todo):
        # Borders with about TOGETHER periods; the periods of a long one in parts.
        done = upto[at - 1] if at else 0
        last = max(at + 1, int(np.searchsorted(upto, done + TOGETHER, "right")))
        some = todo[at:last]
        for low in range(0, int(reach[some].max()), TOGETHER):
            n = np.clip(reach[some] - low, 0, TOGETHER)
            who = np.repeat(some, n)
            q = low + 1 + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            begin = border[who] - 2 * q if ending else border[who]
            middle = sums[begin + q]
            found = (middle - sums[begin]) * powers[q] == sums[begin + 2 * q] - middle
            yield who[found], q[found]
        at = last


def _equal_by_hash(sums, powers, at, room, q, step: int) -> np.ndarray:
    """How many words from ``at`` (not itself when going back) equal those q behind them, up to ``room``."""
    low, high = np.zeros(len(at), np.int64), room.copy()
    while (low < high).any():
        n = (low + high + 1) // 2
        begin = at if step > 0 else at - n
        same = (sums[begin + n] - sums[begin]) * powers[q] == sums[begin + q + n] - sums[begin + q]
        low, high = np.where(same, n, low), np.where(same, high, n - 1)
    return low


def _equal_by_word(ids, at, room, q, step: int) -> np.ndarray:
    """The same by comparing the words; each step compares twice as many as the one before."""
    at = at if step > 0 else at - 1
    same, going = np.zeros(len(at), np.int64), np.flatnonzero(room > 0)
    width = 16
    while len(going):
        n = np.minimum(room[going] - same[going], width)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i = np.repeat(at[going] + step * same[going], n) + step * inner
        wrong = np.where(ids[i] == ids[i + np.repeat(q[going], n)], np.iinfo(np.int64).max, inner)
        until = np.minimum(np.minimum.reduceat(wrong, np.cumsum(n) - n), n)
        same[going] += until
        going = going[(until == n) & (same[going] < room[going])]
        width = min(2 * width, max(16, (1 << 20) // max(len(going), 1)))
    return same


def _extents(equal, low, high, square, q) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the longest stretch of period q, inside low..high, around the square that begins at ``square``."""
    return square - equal(square, square - low, q, -1), square + equal(square, high - q - square, q, 1) + q


def own_runs(grammar: Grammar, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, offset in it, length and period of the runs that cross the boundary of each symbol."""
    left, _, length, place = grammar.closed()
    symbols = np.flatnonzero((left >= 0) & (length >= LEAST))
    size, low = length[symbols], place[symbols]
    border, high = low + length[left[symbols]], low + size
    powers, values = powers_of(len(ids) + 1), mixed(ids.astype(np.uint64) + np.uint64(1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[:len(ids)])])

    def by_hash(*asked):
        return _equal_by_hash(sums, powers, *asked)

    def by_word(*asked):
        return _equal_by_word(ids, *asked)

    def stretches(who, square, q, equal):
        start, end = _extents(equal, low[who], high[who], square, q)
        # At least one word on either side of the boundary: else a part of the symbol has it.
        good = (end - start >= np.maximum(LEAST, FOLD * q)) & (start < border[who]) & (end > border[who])
        found = np.stack([who, start, end, q, square])[:, good]
        # Of equal stretches the smallest period counts; the others are multiples of it.
        found = found[:, np.lexsort((found[3], found[2], found[1], found[0]))]
        new = np.ones(found.shape[1], bool)
        new[1:] = (np.diff(found[:3]) != 0).any(0)
        return found[:, new]

    # A square begins or ends at the boundary; a run is four periods long.
    squares = [
        np.stack([who, border[who] - (2 * q if ending else 0), q])
        for ending, room in ((False, high - border), (True, border - low))
        for who, q in _squares(sums, powers, border, np.minimum(room, size // 2), ending)]
    squares = np.concatenate([*squares, np.zeros((3, 0), np.int64)], axis=1)
    found = stretches(*squares, by_hash)
    # The words themselves decide; where a hash was wrong, about all periods of the symbol.
    start, end = _extents(by_word, low[found[0]], high[found[0]], found[4], found[3])
    wrong = np.unique(found[0][(start != found[1]) | (end != found[2])])
    if len(wrong):
        again = squares[:, np.isin(squares[0], wrong)]
        found = np.concatenate([found[:, ~np.isin(found[0], wrong)], stretches(*again, by_word)], axis=1)
        found = found[:, np.argsort(found[0], kind="stable")]
    return symbols[found[0]], found[1] - low[found[0]], found[2] - found[1], found[3]


def all_runs(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and period of every run of the texts, sorted by start and period."""
    grammar, top, top_place = compress(ids, doc)
    symbol, offset, n, q = own_runs(grammar, ids)
    left, right, length, _ = grammar.closed()
    has = np.zeros(grammar.size, bool)
    has[symbol] = True
    for first, last in zip(grammar.layers[1:-1], grammar.layers[2:]):
        has[first:last] |= has[left[first:last]] | has[right[first:last]]
    # Where each symbol stands, from the texts downwards.
    wanted = has[top] if len(top) else np.zeros(0, bool)
    at, place, found = top[wanted], top_place[wanted], []
    for first, last in reversed(list(zip(grammar.layers[1:-1], grammar.layers[2:]))):
        here = (at >= first) & (at < last)
        some, where = at[here], place[here]
        if not len(some):
            continue
        begin, end = np.searchsorted(symbol, some), np.searchsorted(symbol, some, "right")
        times = end - begin
        run = np.repeat(begin - (np.cumsum(times) - times), times) + np.arange(times.sum())
        found.append((np.repeat(where, times) + offset[run], n[run], q[run]))
        lower = [(child, where + gap) for child, gap in ((left[some], 0), (right[some], length[left[some]]))]
        at = np.concatenate([at[~here], *(child[has[child]] for child, _ in lower)])
        place = np.concatenate([place[~here], *(to[has[child]] for child, to in lower)])
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    start, n, q = (np.concatenate(c) for c in zip(*found))
    # Of one period, keep what no other holds; texts do not touch, since symbols end with them.
    order = np.lexsort((-n, start, q))
    start, end, q = start[order], (start + n)[order], q[order]
    group = np.concatenate([[0], np.cumsum(np.diff(q) != 0)])
    span = int(end.max()) + 1
    reached = np.maximum.accumulate(end + group * span) - group * span
    keep = np.ones(len(start), bool)
    keep[1:] = (np.diff(group) != 0) | (end[1:] > reached[:-1])
    start, end, q = start[keep], end[keep], q[keep]
    order = np.lexsort((q, start))
    return start[order], (end - start)[order], q[order]


def rewritten(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a document that the contract makes periodic, the original word of each of its n words; else None."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    words = np.arange(n)
    words[a:] = a + (words[a:] - a) % p
    return words


def _found(planted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, doc_ids = binary_texts(batch, "text"), batch.column("doc_id").to_pylist()
            for first, last in slices(texts):
                rows = list(_rows(texts[first:last], doc_ids[first:last], planted))
                names = [field.split()[0] for field in SCHEMA.split(", ")]
                kinds = [pa.int64()] * 6 + [pa.string()] * 2
                yield pa.record_batch({name: pa.array(c, kind) for name, kind, c in zip(names, kinds, zip(*rows))})

    return run


def _rows(texts: list[bytes | None], doc_ids: list[int | None], planted: bool) -> Iterator[tuple]:
    joined, begin, end, word = words_of(texts)
    ids = np.unique(word_hashes(joined, begin, end), return_inverse=True)[1].astype(np.int64)
    sizes = np.diff(word)
    origin = np.arange(len(ids))
    if planted:
        for d, doc_id in enumerate(doc_ids):
            moved = rewritten(doc_id, int(sizes[d]))
            if moved is not None:
                origin[word[d]:word[d + 1]] = word[d] + moved
    ids = ids[origin]
    start, length, period = all_runs(ids, np.repeat(np.arange(len(texts)), sizes))
    # A word is dropped if it lies behind the first period of a run.
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    keep = np.cumsum(cover[:-1]) == 0
    of = np.searchsorted(start, word)
    for d, doc_id in enumerate(doc_ids):
        i, j = of[d], of[d + 1]
        spans = list(zip((start[i:j] - word[d]).tolist(), length[i:j].tolist(), period[i:j].tolist()))
        best = min(spans, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        told = "".join(f"{s},{n},{q}\n" for s, n, q in spans)
        if spans or doc_id is None or len(texts[d] or b"") == 0 or planted and rewritten(doc_id, int(sizes[d])) is not None:
            kept = word[d] + np.flatnonzero(keep[word[d]:word[d + 1]])
            left = b" ".join(joined[a:b] for a, b in zip(begin[origin[kept]].tolist(), end[origin[kept]].tolist()))
        else:
            left = b" ".join(texts[d].split())
        yield (
            doc_id, len(spans), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """n_runs, the strongest run and hashes of all runs and of the collapsed text, for each row of docs (doc_id, text).

    start, length, period and exponent_milli are of the run with the greatest
    length / period (ties: smallest start, then period), or NULL without a run.
    runs_sha256 is over ``start,length,period`` and a line end per run;
    collapsed_sha256 over the words that lie behind no first period of a run,
    joined by one space. A NULL text has no words, like an empty one. Rows that
    repeat an id and NULL ids are rows like any other; other columns are ignored; an
    empty table gives no rows. ``planted`` first makes the documents of one id in
    ten periodic, see ``rewritten``; a NULL id is none of them.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_found(planted), SCHEMA)
