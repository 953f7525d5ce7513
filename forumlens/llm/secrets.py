"""Secrets in texts: fixed patterns, and a linear-chain conditional random field.

Patterns find assignments to telling names, access keys and long hexadecimal
strings. The field adds what looks like those without matching: a text is cut into
tokens (runs of letters and digits, single marks), each token gets features (its
shape, shapes and words around it, whether it touches them, what kind of file it is
in), and a line is a chain of tags B, I and O, the first and the following tokens of
a secret and all others. The best tags are decoded by Viterbi's algorithm, exactly
and for all lines of a slice at once: chains lie end to end and are cut into blocks of
equal length, whose score matrices are multiplied in (max, +) before the paths are
followed.

The field is fitted here to what the patterns find in a bounded sample: the SAMPLE
documents with the smallest hash of their id among those that hold a telling name,
as many among all documents, and fewer if they hold more than SAMPLE_BYTES.
Fitting maximises the likelihood of the tags, with chains cut at CHAIN tokens;
decoding cuts nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.llm.common import binary_texts, slices, word_hashes, written

#: Documents of each half of the sample, and bytes of all of them.
SAMPLE, SAMPLE_BYTES = 600, 1 << 22
#: Tokens of a chain in fitting, chains fitted together, passes over the sample and steps at least, rate, pull towards zero.
CHAIN, BATCH, EPOCHS, STEPS, RATE, DECAY = 128, 512, 4, 100, 0.1, 1e-4
#: Characters of a span that the field may add.
LEAST = 8
#: Tokens of a block in decoding.
BLOCK = 256

#: The patterns, and what each must have at least (fixed values). Bytes: only A-Z have another case.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_VALUE, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
KINDS = ("assign", "access", "hex", "tagged")

WORD_BITS = 12
B, I, O = range(3)
NEVER = -1e4

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_tagged long"

_byte = np.arange(256)
_WHITE = np.isin(_byte, [0x20, *range(0x09, 0x0E)])
_DIGIT = np.isin(_byte, list(b"0123456789"))
_UPPER = np.isin(_byte, list(range(0x41, 0x5B)))
_LOWER = np.isin(_byte, list(range(0x61, 0x7B)))
_FOREIGN = _byte >= 0x80
_RUN = _DIGIT | _UPPER | _LOWER | _FOREIGN
_HEX = np.isin(_byte, list(b"0123456789abcdef"))


def base_spans(text: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the matches of the patterns in a text, in bytes."""
    found, lower = [], text.lower()
    if any(name in lower for name in NAMES):
        found += [
            (m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    return found


def hex_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of hexadecimal digits that are long enough."""
    inside = np.concatenate([[False], _HEX[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    return starts[ends - starts >= HEX_CHARS], ends[ends - starts >= HEX_CHARS]


@dataclass
class Tokens:
    """Tokens of texts joined by line ends: their ends in that, features, and which begin a line."""

    starts: np.ndarray
    ends: np.ndarray
    features: np.ndarray
    breaks: np.ndarray


def _bucket(values: np.ndarray, edges: list[int]) -> np.ndarray:
    return np.searchsorted(edges, values, "right")


LENGTHS = [2, 3, 5, 9, 16, 24, 40]
SHAPES = 8 * 16 * 2 + 256
#: Number of values of each feature, in the order ``tokens_of`` gives them.
SIZES = np.array([SHAPES, SHAPES, SHAPES, SHAPES, 1 << WORD_BITS, 1 << WORD_BITS, 1 << WORD_BITS, 1 << WORD_BITS, 6 * 8, 4 * 16, 16 * 16, 1])


def _shares(borders: np.ndarray, data: np.ndarray, table: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(table[data])])
    return (sums[borders[1:]] - sums[borders[:-1]]) / np.maximum(np.diff(borders), 1)


def tokens_of(texts: list[bytes | None]) -> tuple[bytes, np.ndarray, Tokens]:
    """Texts joined by line ends; where each text begins in that, and the end; their tokens."""
    joined = b"\n".join(t or b"" for t in texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    borders = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
    run, white = _RUN[data], _WHITE[data]
    begin = ~white
    begin[1:] &= ~(run[1:] & run[:-1])
    starts = np.flatnonzero(begin)
    n = len(starts)
    if not n:
        return joined, borders, Tokens(starts, starts, np.zeros((0, len(SIZES)), np.int32), np.zeros(0, bool))
    close = ~white
    close[:-1] &= ~(run[1:] & run[:-1])
    ends = np.flatnonzero(close) + 1
    size = ends - starts

    def has(table):
        return np.add.reduceat(table[data].astype(np.int32), np.stack([starts, ends], 1).ravel())[::2]

    lower, upper, digit, foreign, hexa = map(has, (_LOWER, _UPPER, _DIGIT, _FOREIGN, _HEX))
    length = _bucket(size, LENGTHS)
    mix = (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (foreign > 0)
    word = run[starts]
    shape = np.where(word, length * 32 + mix * 2 + (hexa == size), 256 + data[starts].astype(np.int64))
    # Letters that follow digits or the other way round.
    swaps = np.zeros(len(data) + 1, np.int32)
    swaps[2:] = np.cumsum(_DIGIT[data[1:]] != _DIGIT[data[:-1]])
    turns = _bucket(swaps[ends] - swaps[starts + 1], [1, 2, 3, 5, 8])
    hashes = (word_hashes(joined.lower(), starts, ends) >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    # A token with digits tells by its shape, not by its spelling.
    hashes = np.where(word & (digit == 0), hashes, 0)
    touch = np.concatenate([starts[1:] == ends[:-1], [False]])
    glued = np.concatenate([[False], touch[:-1]]) + 2 * touch
    lines = np.cumsum(data == 0x0A)
    line = lines[starts]
    breaks = np.concatenate([[True], line[1:] != line[:-1]])
    # What kind of file it is: shares of marks and of digits.
    of = np.searchsorted(borders, starts, "right") - 1
    kind = _bucket(_shares(borders, data, ~_RUN & ~_WHITE), [0.03, 0.06, 0.12]) * 4 + _bucket(
        _shares(borders, data, _DIGIT), [0.005, 0.02, 0.1])

    def moved(values, by, fill):
        """Values of the token ``by`` places on, in the same line."""
        out = np.full(n, fill, np.int64)
        if by < 0:
            out[-by:] = np.where(line[-by:] == line[:by], values[:by], fill)
        else:
            out[:-by] = np.where(line[:-by] == line[by:], values[by:], fill)
        return out

    columns = [
        shape, moved(shape, -1, 256), moved(shape, 1, 256), moved(shape, -2, 256),
        hashes, moved(hashes, -1, 0), moved(hashes, -2, 0), moved(hashes, -3, 0),
        turns * 8 + length, glued * 16 + mix, kind[of] * 16 + mix, np.zeros(n, np.int64),
    ]
    offsets = np.cumsum(SIZES) - SIZES
    features = np.stack([c + o for c, o in zip(columns, offsets)], 1).astype(np.int32)
    return joined, borders, Tokens(starts, ends, features, breaks)


@dataclass(frozen=True)
class Weights:
    """Scores of features, of a tag after a tag, and of a tag at the beginning of a chain."""

    features: np.ndarray
    follow: np.ndarray
    begin: np.ndarray


def no_weights() -> Weights:
    """A field that tags nothing."""
    features = np.zeros((int(SIZES.sum()), 3), np.float32)
    features[-1] = (-4, -4, 0)
    return Weights(features, np.zeros((3, 3), np.float32), np.zeros(3, np.float32))


def _follow(weights: Weights) -> np.ndarray:
    """Scores (two of them: inside a chain, and into a new one) of a tag after a tag; I comes after B or I only."""
    scores = np.stack([weights.follow, np.tile(weights.begin, (3, 1))]).astype(np.float32)
    scores[0, O, I] = NEVER
    scores[1, :, I] = NEVER
    return scores


def emissions(weights: Weights, features: np.ndarray) -> np.ndarray:
    out = weights.features[features[:, 0]]
    for k in range(1, features.shape[1]):
        out += weights.features[features[:, k]]
    return out


def viterbi(scores: np.ndarray, breaks: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """The best tags of chains that lie end to end; ``breaks`` marks their first tokens."""
    n = len(scores)
    if not n:
        return np.zeros(0, np.int8)
    width = -(-n // BLOCK)
    own = np.zeros((width * BLOCK, 3), np.float32)
    own[:n] = scores
    new = np.ones(width * BLOCK, np.int8)
    new[:n] = breaks
    # Step t of all blocks together.
    own, new = own.reshape(width, BLOCK, 3).swapaxes(0, 1), new.reshape(width, BLOCK).T
    across = np.arange(width)
    # From each tag before a block to each tag at its end.
    whole = follow[new[0]] + own[0][:, None, :]
    for t in range(1, BLOCK):
        step = follow[new[t]][:, None]
        ways = [whole[:, :, k, None] + step[:, :, k] for k in range(3)]
        whole = np.maximum(np.maximum(ways[0], ways[1]), ways[2]) + own[t][:, None, :]
    entered = np.zeros((width, 3), np.float32)
    for b in range(1, width):
        best = (entered[b - 1][:, None] + whole[b - 1]).max(0)
        entered[b] = best - best.max()
    back = np.empty((BLOCK, width, 3), np.int8)
    score = entered
    for t in range(BLOCK):
        ways = [score[:, k, None] + follow[new[t]][:, k] for k in range(3)]
        two = np.maximum(ways[0], ways[1])
        back[t] = np.where(ways[2] > two, 2, ways[1] > ways[0])
        score = np.maximum(two, ways[2]) + own[t]
    # The tag before a block for each tag at its end, then the tags at all ends.
    at = np.tile(np.arange(3, dtype=np.int8), (width, 1))
    for t in reversed(range(BLOCK)):
        at = np.take_along_axis(back[t], at.astype(np.int64), 1)
    ends = np.empty(width, np.int64)
    ends[-1] = score[-1].argmax()
    for b in range(width - 1, 0, -1):
        ends[b - 1] = at[b, ends[b]]
    tags = np.empty((BLOCK, width), np.int8)
    tag = ends
    for t in reversed(range(BLOCK)):
        tags[t] = tag
        tag = back[t][across, tag].astype(np.int64)
    return tags.T.reshape(-1)[:n]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def gradient(weights: Weights, features: np.ndarray, tags: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Negative log-likelihood of chains and its gradient; a chain is ``sizes`` tokens from ``starts``."""
    follow = _follow(weights)[0].astype(float)
    begin = _follow(weights)[1, 0].astype(float)
    longest, n = int(sizes.max()), len(starts)
    place = np.minimum(starts[:, None] + np.arange(longest), len(features) - 1)
    real = np.arange(longest) < sizes[:, None]
    scores, tag = emissions(weights, features[place.ravel()]).reshape(n, longest, 3).astype(float), tags[place]
    forward, backward = np.empty((longest, n, 3)), np.zeros((longest, n, 3))
    forward[0] = begin + scores[:, 0]
    for t in range(1, longest):
        forward[t] = np.where(
            real[:, t, None], _log_sum(forward[t - 1][:, :, None] + follow, 1) + scores[:, t], forward[t - 1])
    for t in range(longest - 2, -1, -1):
        ahead = _log_sum(follow + (scores[:, t + 1] + backward[t + 1])[:, None, :], 2)
        backward[t] = np.where(real[:, t + 1, None], ahead, 0)
    total = _log_sum(forward[-1], 1)
    share = np.exp(forward + backward - total[:, None]).swapaxes(0, 1)  # (chain, place, tag)
    d_scores = (share - np.eye(3)[tag]) * real[:, :, None]
    d_features = np.zeros_like(weights.features, dtype=float)
    rows, flat = features[place[real]], d_scores[real]
    for k in range(3):
        d_features[:, k] = np.bincount(
            rows.ravel(), np.repeat(flat[:, k], rows.shape[1]), minlength=len(d_features))
    d_follow = np.zeros((3, 3))
    for t in range(1, longest):
        some = real[:, t]
        if some.any():
            both = np.exp(
                forward[t - 1][some][:, :, None] + follow + (scores[some, t] + backward[t][some])[:, None, :]
                - total[some][:, None, None]).sum(0)
            d_follow += both
            np.add.at(d_follow, (tag[some, t - 1], tag[some, t]), -1)
    d_begin = d_scores[:, 0].sum(0)
    path = np.take_along_axis(scores, tag[:, :, None], 2)[:, :, 0] * real
    inside = follow[tag[:, :-1], tag[:, 1:]] * real[:, 1:]
    loss = (total - path.sum(1) - inside.sum(1) - begin[tag[:, 0]]).sum()
    return loss, (d_features, d_follow, d_begin)


def train(texts: list[bytes], seed: int = 5) -> Weights:
    """Weights fitted to what the patterns find in the texts; without a match a field that tags nothing."""
    joined, borders, tokens = tokens_of(texts)
    inside = np.zeros(len(joined) + 1, np.int64)
    for d, text in enumerate(texts):
        for _, _, end, value in base_spans(text):
            inside[borders[d] + value] += 1
            inside[borders[d] + end] -= 1
    starts, ends = hex_runs(np.frombuffer(joined, np.uint8))
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(inside[:-1]) > 0)])
    secret = covered[tokens.ends] > covered[tokens.starts]
    if not secret.any():
        return no_weights()
    # A chain begins with B, and I follows B or I.
    line = np.cumsum(tokens.breaks)
    first = np.flatnonzero(tokens.breaks)
    begins = tokens.breaks | ((np.arange(len(line)) - first[line - 1]) % CHAIN == 0)
    before = np.concatenate([[False], secret[:-1]]) & ~begins
    tags = np.where(secret, np.where(before, I, B), O)
    at = np.flatnonzero(begins)
    sizes = np.diff(np.append(at, len(line)))
    weights = no_weights()
    values = [weights.features.astype(float), weights.follow.astype(float), weights.begin.astype(float)]
    first_moment, second = ([np.zeros_like(v) for v in values] for _ in range(2))
    # Chains of like length together.
    batches = np.array_split(np.argsort(sizes, kind="stable"), -(-len(at) // BATCH))
    passes = max(EPOCHS, -(-STEPS // len(batches)))
    rng, step, total = np.random.default_rng(seed), 0, passes * len(batches)
    for _ in range(passes):
        for b in rng.permutation(len(batches)):
            now = Weights(values[0].astype(np.float32), values[1], values[2])
            some = batches[b]
            _, found = gradient(now, tokens.features, tags, at[some], sizes[some])
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for v, g, m, s in zip(values, found, first_moment, second):
                g = g / len(some) + DECAY * v
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
    return Weights(values[0].astype(np.float32), values[1].astype(np.float32), values[2].astype(np.float32))


def fit(docs: DataFrame) -> Weights:
    """Fit the field to the sample of docs (doc_id, text); rows without an id are not used."""
    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.xxhash64("doc_id").alias("order"))
    lower = F.lower("text")
    telling = F.contains("text", F.lit("AKIA"))
    for name in NAMES:
        telling = telling | F.contains(lower, F.lit(name.decode()))
    known = rows.agg(F.count("*").alias("all"), F.count_if(telling).alias("telling")).first()
    texts: set[tuple[int, bytes]] = set()
    for some, count in ((rows.filter(telling), known["telling"]), (rows, known["all"])):
        # Hashes are even, so a bound on them leaves about four times SAMPLE rows before they are sorted.
        bound = -(1 << 63) + int((1 << 64) * min(1.0, 4 * SAMPLE / max(count, 1)))
        few = some.filter(F.col("order") < min(bound, (1 << 63) - 1)) if count > 4 * SAMPLE else some
        chosen = few.select("order", "doc_id").distinct().orderBy("order", "doc_id").limit(SAMPLE)
        found = written(few.join(F.broadcast(chosen), ["order", "doc_id"]).select(
            "order", "doc_id", F.col("text").cast("binary").alias("text")), "sample")
        sizes = [r["n"] for r in found.groupBy("order", "doc_id").agg(F.sum(F.length("text")).alias("n")).orderBy(
            "order", "doc_id").collect()]
        fit_in = max(1, int(np.searchsorted(np.cumsum(sizes), SAMPLE_BYTES // 2, "right")))
        if fit_in < len(sizes):
            found = found.join(F.broadcast(chosen.orderBy("order", "doc_id").limit(fit_in)), ["order", "doc_id"])
        texts |= {(r["doc_id"], bytes(r["text"])) for r in found.select("doc_id", "text").collect()}
    return train([text for _, text in sorted(texts)])


def spans_of(texts: list[bytes | None], weights: Weights) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) in code points of all spans of each text, sorted."""
    joined, borders, tokens = tokens_of(texts)
    data = np.frombuffer(joined, np.uint8)
    found = [(borders[d] + s, kind, borders[d] + e) for d, t in enumerate(texts) if t for s, kind, e, _ in base_spans(t)]
    found += [(s, 2, e) for s, e in zip(*(x.tolist() for x in hex_runs(data)))]
    covered = np.zeros(len(data) + 1, np.int64)
    for s, _, e in found:
        covered[s] += 1
        covered[e] -= 1
    covered = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    tags = viterbi(emissions(weights, tokens.features), tokens.breaks, _follow(weights))
    first = np.flatnonzero(tags == B)
    after = np.concatenate([tags[1:] != I, [True]])
    last = np.flatnonzero(after & (tags != O))
    begin, end = tokens.starts[first], tokens.ends[last]
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    # The field adds spans; those that touch a match add nothing.
    new = (covered[end] == covered[begin]) & (chars[end] - chars[begin] >= LEAST)
    found += [(s, 3, e) for s, e in zip(begin[new].tolist(), end[new].tolist())]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for s, kind, e in sorted(found):
        d = int(np.searchsorted(borders, s, "right")) - 1
        out[d].append((int(chars[s] - chars[borders[d]]), kind, int(chars[e] - chars[borders[d]])))
    return out


def _scanned(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = binary_texts(batch, "text"), batch.column("doc_id")
            for first, last in slices(texts):
                spans = spans_of(texts[first:last], weights.value)
                told = [[(k, f"{KINDS[k]}:{s}:{e}") for s, k, e in own] for own in spans]
                counts = [[sum(k == kind for k, _ in own) for own in told] for kind in range(4)]
                base = [",".join(t for k, t in own if k < 3) for own in told]
                yield pa.record_batch({
                    "doc_id": ids.slice(first, last - first),
                    **{name: pa.array(c, pa.int64()) for name, c in zip(("n_assign", "n_access", "n_hex"), counts)},
                    "base_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in base], pa.string()),
                    "spans": pa.array([",".join(t for _, t in own) for own in told], pa.string()),
                    "n_tagged": pa.array(counts[3], pa.int64()),
                })

    return run


def find_secrets(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_tagged for each row of docs (doc_id, text).

    ``spans`` lists ``kind:start:end`` in code points, by start and kind; the kind of
    what the field adds is ``tagged``, and such a span neither overlaps another nor
    is shorter than LEAST. base_sha256 is over the others. A NULL text counts as
    empty: no spans. Rows that repeat an id, and NULL ids, are rows like any other;
    other columns are ignored; an empty table gives no rows. Without ``weights`` the
    field is fitted to a sample of docs.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fitted = docs.sparkSession.sparkContext.broadcast(fit(texts) if weights is None else weights)
    return texts.mapInArrow(_scanned(fitted), SCHEMA)
