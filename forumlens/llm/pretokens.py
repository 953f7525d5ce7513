"""Texts to byte-level BPE ids, many texts at a time.

The pattern that splits a text before the merges is

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Said as rules on a sequence of characters: a token is a run of one kind (letter,
number, space, other); of spaces in front of something else the last one stands
apart, and if it is U+0020 it belongs to what follows; a run of others that
begins with an apostrophe and one of the seven endings ends behind the ending.
The rules are applied to arrays of whole slices, and the tokenizer sees each
distinct word of a slice once.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from forumlens.llm.common import word_hashes

#: Words of a generation whose ids a worker keeps.
WORDS_KEPT = 300_000
#: The endings and the white space of the pattern.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

SPACE, LETTER, NUMBER, OTHER, UNSEEN = range(5)
_kinds = np.full(0x110000, UNSEEN, np.uint8)
_kinds[list(WHITE_SPACE)] = SPACE


def kinds(chars: np.ndarray) -> np.ndarray:
    """The kind of each code point; a code point is looked up when it is first met."""
    found = _kinds[chars]
    new = found == UNSEEN
    if new.any():
        of = {"L": LETTER, "N": NUMBER}
        for c in np.unique(chars[new]).tolist():
            _kinds[c] = of.get(unicodedata.category(chr(c))[0], OTHER)
        found = _kinds[chars]
    return found


def token_ranges(texts: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Texts joined; start and end of each token in that; first token of each text and one more."""
    joined = b"".join(t or b"" for t in texts)
    if not joined:
        none = np.zeros(0, np.int64)
        return joined, none, none, np.zeros(len(texts) + 1, np.int64)
    chars = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
    width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width)])  # first byte of each character
    kind = kinds(chars)
    borders = np.cumsum([0] + [len(t or b"") for t in texts])
    begins = np.zeros(len(chars) + 1, bool)
    begins[np.searchsorted(at, borders)] = True
    start = begins.copy()
    start[1:-1] |= kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~begins[1:-1])
    start[last] = True
    start[last + 1] = chars[last] != 0x20
    # Endings behind an apostrophe that begins a token.
    marks = np.flatnonzero((chars == 0x27) & start[:-1])
    for ending in ENDINGS:
        n = len(ending)
        marks_left = marks[marks + n < len(chars)]
        fits = np.ones(len(marks_left), bool)
        for j, letter in enumerate(ending, 1):
            fits &= (chars[marks_left + j] == ord(letter)) & ~begins[marks_left + j]
        hit = marks_left[fits]
        start[hit + 1] = False
        start[hit + 1 + n] = True
        marks = np.setdiff1d(marks, hit, assume_unique=True)
    starts = at[np.flatnonzero(start[:-1])]
    ends = np.append(starts[1:], len(joined))
    return joined, starts, ends, np.searchsorted(starts, borders)


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, the first place of each, and for each value which of them it is.

    As ``np.unique`` gives them, but only the distinct values are sorted.
    """
    coded = pa.array(values).dictionary_encode()
    which, found = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    # Numbers are given out in order of their first places.
    first = np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1))
    order = np.argsort(found)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return found[order], first[order], rank[which]


def distinct_tokens(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each distinct token, the first place of each, and for each token which of them it is.

    Tokens are told apart by their hashes and then held against the bytes of the
    first one; should two share a hash, the slice is told apart by bytes alone.
    Tokens lie end to end, so their bytes in order are those of ``joined``.
    """
    hashes, first, which = _numbered(word_hashes(joined, starts, ends))
    sizes, data = ends - starts, np.frombuffer(joined, np.uint8)
    place = first[which]
    same = np.array_equal(sizes, sizes[place])
    if same:
        moved = np.repeat(starts[place] - starts, sizes)
        moved += np.arange(len(moved))
        same = np.array_equal(data[moved], data[:len(moved)])
    if not same:
        tokens = [joined[i:j] for i, j in zip(starts.tolist(), ends.tolist())]
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(t, len(number)) for t in tokens])
        first = np.unique(which, return_index=True)[1]
        hashes = word_hashes(joined, starts[first], ends[first])
    return hashes, first, which


def spread(values: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of values (of given lengths, end to end), picked by number and laid end to end; where each begins, and the end."""
    begin = np.cumsum(lengths) - lengths
    picked = lengths[which]
    to = np.concatenate([[0], np.cumsum(picked)])
    return values[np.repeat(begin[which] - to[:-1], picked) + np.arange(to[-1])], to


class KnownWords:
    """Ids of words in arrays: sorted hashes, with the bytes and the ids of each word in two buffers.

    A slice is looked up at once and its bytes are compared; words that are not
    there are learned, from their bytes end to end and their lengths. Beyond ``size`` words those are forgotten whose last use is
    longest ago, down to half of it, so frequent words stay. The buffers grow at
    their ends and are made anew only when words are forgotten.
    """

    def __init__(self, learn: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], size: int):
        self.learn, self.size, self.clock = learn, size, 0
        self.hashes = np.zeros(0, np.uint64)
        #: Last use, place and length of the bytes, place and number of the ids of each word, in order of hashes.
        self.words = np.zeros((5, 0), np.int64)
        self.bytes, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)

    def __call__(self, joined: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct tokens end to end, how many each has, and for each token which of them it is."""
        hashes, first, which = distinct_tokens(joined, starts, ends)
        self.clock += 1
        starts, sizes = starts[first], ends[first] - starts[first]
        own = _runs(np.frombuffer(joined, np.uint8), starts, sizes)
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        used, byte_at, n_bytes, id_at, own_ids = self.words
        known[known] = n_bytes[at[known]] == sizes[known]
        if known.any():
            kept = _runs(self.bytes, byte_at[at[known]], sizes[known])
            other = np.add.reduceat(kept != own[np.repeat(known, sizes)], np.cumsum(sizes[known]) - sizes[known])
            known[known] = other == 0
        used[at[known]] = self.clock
        new = np.flatnonzero(~known)
        n_ids, begin = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        n_ids[known], begin[known] = own_ids[at[known]], id_at[at[known]]
        values = self.ids
        if len(new):
            data = own[np.repeat(~known, sizes)]
            learned, lengths = self.learn(data, sizes[new])
            n_ids[new], begin[new] = lengths, len(values) + np.cumsum(lengths) - lengths
            values = np.concatenate([values, learned])
            self._add(hashes[new], sizes[new], data, lengths, values)
        return _runs(values, begin, n_ids), n_ids, which

    def _add(self, hashes: np.ndarray, n_bytes: np.ndarray, data: np.ndarray, n_ids: np.ndarray, ids: np.ndarray) -> None:
        """Take in new words; ``ids`` holds those kept so far, then theirs. Of words with one hash the first stays."""
        new = np.array([
            np.full(len(hashes), self.clock), len(self.bytes) + np.cumsum(n_bytes) - n_bytes, n_bytes,
            len(self.ids) + np.cumsum(n_ids) - n_ids, n_ids], np.int64)
        self.bytes, self.ids = np.concatenate([self.bytes, data]), ids
        hashes, first = np.unique(hashes, return_index=True)
        place = np.searchsorted(self.hashes, hashes)
        if len(self.hashes):
            fresh = self.hashes[np.minimum(place, len(self.hashes) - 1)] != hashes
            hashes, first, place = hashes[fresh], first[fresh], place[fresh]
        self.hashes = np.insert(self.hashes, place, hashes)
        self.words = np.insert(self.words, place, new[:, first], axis=1)
        if len(self.hashes) > self.size:
            self._forget()

    def _forget(self) -> None:
        used, byte_at, n_bytes, id_at, n_ids = self.words
        stay = used >= np.partition(used, len(used) - self.size // 2)[len(used) - self.size // 2]
        if stay.sum() > self.size:
            # One slice brought them all: any half will do.
            stay &= np.cumsum(stay) <= self.size // 2
        self.bytes = _runs(self.bytes, byte_at[stay], n_bytes[stay])
        self.ids = _runs(self.ids, id_at[stay], n_ids[stay])
        self.hashes, self.words = self.hashes[stay], self.words[:, stay]
        _, byte_at, n_bytes, id_at, n_ids = self.words
        byte_at[:], id_at[:] = np.cumsum(n_bytes) - n_bytes, np.cumsum(n_ids) - n_ids


def _runs(values: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs of values, given by where they begin and how long they are, end to end."""
    to = np.cumsum(lengths) - lengths
    places = np.repeat(begin - to, lengths)
    places += np.arange(len(places))
    return values[places]


def split_words(data: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Words that lie end to end."""
    whole, ends = data.tobytes(), np.cumsum(sizes).tolist()
    return [whole[i:j] for i, j in zip([0, *ends[:-1]], ends)]


#: Second bytes of a word behind a space that are sure to be no white space.
_SOLID = np.isin(np.arange(256), [*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)])
#: Words that are sent to the tokenizer as one text.
TOGETHER = 1000


class WordIds:
    """Ids of words by a tokenizer of the ``tokenizers`` library.

    A word that begins with a space stands apart from the one before it, so many
    of them go as one text and are told apart by the bytes of their tokens.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        # Byte-level tokens have one character per byte.
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.sizes[number] = len(token)
        self.known = KnownWords(self.learn, WORDS_KEPT)

    def __call__(self, joined: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.known(joined, starts, ends)

    def learn(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has; ``data`` holds their bytes end to end."""
        at = np.cumsum(sizes) - sizes
        second = data[np.minimum(at + 1, len(data) - 1)]
        solid = (sizes > 1) & (data[at] == 0x20) & _SOLID[second]
        together, alone = np.flatnonzero(solid), np.flatnonzero(~solid)
        # Text by text, words end where their bytes do.
        ends, text = np.cumsum(sizes[together]), data[np.repeat(solid, sizes)].tobytes()
        cuts = [0, *ends[TOGETHER - 1:-1:TOGETHER].tolist(), len(text)] if len(together) else [0]
        texts, whole = [text[i:j] for i, j in zip(cuts[:-1], cuts[1:])], data.tobytes()
        ids = self._encoded(texts + [whole[i:i + n] for i, n in zip(at[alone].tolist(), sizes[alone].tolist())])
        counts = np.array([len(e) for e in ids], np.int64)
        values = np.concatenate([*ids, np.zeros(0, np.uint32)])
        # A word ends where the bytes of its tokens do.
        first = int(counts[:len(texts)].sum())
        ends = np.searchsorted(np.cumsum(self.sizes[values[:first]]), ends) + 1
        lengths = np.concatenate([np.diff(ends, prepend=0), counts[len(texts):]])
        order = np.argsort(np.concatenate([together, alone]))
        begin = np.cumsum(lengths) - lengths
        return _runs(values, begin[order], lengths[order]), lengths[order]

    def _encoded(self, texts: list[bytes]) -> list[np.ndarray]:
        return [
            np.array(e.ids, np.uint32) for i in range(0, len(texts), 1000)
            for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts[i:i + 1000]], add_special_tokens=False)]


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The tokenizer of a worker; it outlives the task."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


#: For a text joined of tokens, their starts and ends: see KnownWords.
Coder = Callable[[bytes, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def encoded(texts: list[bytes | None], ids_of: Coder) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and where those of each text begin, and the end."""
    joined, starts, ends, first = token_ranges(texts)
    return encoded_ranges(joined, starts, ends, first, ids_of)


def encoded_ranges(
    joined: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, ids_of: Coder
) -> tuple[np.ndarray, np.ndarray]:
    """The same for texts that are cut already; ``first`` has the first token of each text and the end."""
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(first), np.int64)
    values, lengths, which = ids_of(joined, starts, ends)
    ids, to = spread(values, lengths, which)
    return ids, to[first]
