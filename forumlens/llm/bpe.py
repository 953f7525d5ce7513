"""Byte-level BPE with DuckDB inside each partition.

The ranks of a vocabulary give a merge table (left, right, token): every way to
split a token into two others. The distinct words of a slice of texts become rows
(word, position, token), first one per byte. A recursive query joins each pair of
neighbours with the merge table and contracts, in each word, the leftmost pair of
the smallest rank; a word without a pair is done and leaves the recursion. Decoding joins ids with the vocabulary and aggregates the pieces in
order.

A recursion keeps the rows of all its rounds, so words are fed in batches of
bounded bytes, and a word that needs more than ROUNDS rounds goes on in another
query from where it stood.

A round merges one pair of a word, so a long word, a run of letters without end, is
cut into pieces of PIECE bytes that are contracted side by side and then joined two
and two. Ranks grow with every merge, hence ids are those of the whole word if each
two neighbours among them stay as they are when their bytes are encoded alone. Where
two pieces meet that is asked; if it does not hold, some tokens on either side are
contracted again as one word, twice as many each time, until it does.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.llm.common import binary_texts, slices
from forumlens.llm.pretokens import KnownWords, encoded, split_words

ROUNDS = 64
#: Bytes of words of up to SHORT bytes in one recursive query, and ids in one decoding query. Nothing spills: rows are bounded.
BATCH_BYTES, SHORT, BATCH_IDS = 1 << 18, 16, 1 << 20
#: Words of a generation whose ids a worker keeps.
WORDS_KEPT = 300_000
ENCODE_BYTES = 4 << 20
#: Bytes of a piece of a long word, bytes of pieces in one query, and tokens on either side of a border that are first tried anew.
PIECE, PIECE_BYTES, SEAM = 64, 1 << 17, 4

CONTRACT = f"""
WITH RECURSIVE state(round, word, pos, token, done) AS (
    SELECT 0, word, pos, token, false FROM begin_rows
    UNION ALL
    SELECT * FROM (
        WITH pairs AS MATERIALIZED (
            SELECT s.*, (m.token << 32) + s.pos AS key
            FROM (
                SELECT round, word, pos, token, lead(token) OVER next AS following, lead(pos) OVER next AS next_pos
                FROM state WHERE NOT done AND round < {ROUNDS}
                WINDOW next AS (PARTITION BY word ORDER BY pos)
            ) s LEFT JOIN merges m ON m.pair = (s.token << 32) + s.following
        ),
        best AS (
            SELECT word, min(key) AS key, arg_min(next_pos, key) AS gone
            FROM pairs WHERE key IS NOT NULL GROUP BY word
        )
        SELECT p.round + 1, p.word, p.pos, CASE WHEN p.key = b.key THEN b.key >> 32 ELSE p.token END, b.key IS NULL
        FROM pairs p LEFT JOIN best b USING (word)
        WHERE b.gone IS NULL OR p.pos <> b.gone
    )
)
SELECT word, pos, token, done FROM state WHERE done OR round = {ROUNDS} ORDER BY word, pos
"""

DECODE = """
SELECT part, string_agg(piece, '' ORDER BY pos) AS piece
FROM id_rows JOIN vocabulary USING (token) GROUP BY part ORDER BY part
"""


class DuckBpe:
    """The tables of one vocabulary and the ids of words seen, in a worker's own DuckDB."""

    def __init__(self, path: str):
        import duckdb

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.piece_of = {rank: piece for piece, rank in ranks.items()}
        self.keeps: dict[tuple[int, int], bool] = {}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs, merged = [], []
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
                if left is not None and right is not None:
                    pairs.append((left << 32) + right)
                    merged.append(rank)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.con.execute("SET preserve_insertion_order = false")
        self._load("merges", pa.table({"pair": pa.array(pairs, pa.int64()), "token": pa.array(merged, pa.int64())}))
        # Bytes as the characters of the same number: DuckDB concatenates text, not blobs.
        self._load("vocabulary", pa.table({
            "token": pa.array(list(ranks.values()), pa.int64()),
            "piece": pa.array([p.decode("latin-1") for p in ranks], pa.string()),
        }))
        self.ids_of = KnownWords(lambda data, sizes: self.learn(split_words(data, sizes)), WORDS_KEPT)

    def _load(self, name: str, rows: pa.Table) -> None:
        self.con.register("arrow_rows", rows)
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM arrow_rows")
        self.con.unregister("arrow_rows")

    def _query(self, sql: str, name: str, rows: pa.Table) -> dict[str, np.ndarray]:
        self.con.register(name, rows)
        try:
            return self.con.execute(sql).fetchnumpy()
        finally:
            self.con.unregister(name)

    def _contracted(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new words."""
        ids = {}
        sizes = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words)), sizes)
        pos = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        token = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        while len(word):
            rows = pa.table({"word": word, "pos": pos, "token": token})
            found = self._query(CONTRACT, "begin_rows", rows)
            word, pos, token = (np.asarray(found[c], np.int64) for c in ("word", "pos", "token"))
            unsettled = ~np.asarray(found["done"], bool)
            done = token[~unsettled].astype("<u4")
            who, first = np.unique(word[~unsettled], return_index=True)
            for w, i, j in zip(who.tolist(), first.tolist(), [*first[1:].tolist(), len(done)]):
                ids[words[w]] = done[i:j].tobytes()
            word, pos, token = word[unsettled], pos[unsettled], token[unsettled]
        return ids

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has."""
        ids = self._batches([w for w in words if len(w) <= SHORT], BATCH_BYTES)
        ids |= self._batches([w for w in words if SHORT < len(w) <= PIECE], PIECE_BYTES)
        for word in words:
            if len(word) > PIECE:
                ids[word] = self._long(word)
        runs = [ids[w] for w in words]
        return np.frombuffer(b"".join(runs), "<u4"), np.array([len(r) // 4 for r in runs], np.int64)

    def _batches(self, words: list[bytes], size: int) -> dict[bytes, bytes]:
        return {w: ids for i, j in slices(words, size) for w, ids in self._contracted(words[i:j]).items()}

    def _long(self, word: bytes) -> bytes:
        """Ids of a long word from those of its pieces."""
        cut = [word[i:i + PIECE] for i in range(0, len(word), PIECE)]
        found = self._batches(list(dict.fromkeys(cut)), PIECE_BYTES)
        parts = [np.frombuffer(found[piece], "<u4").tolist() for piece in cut]
        while len(parts) > 1:
            odd = parts[len(parts) // 2 * 2:]
            parts = self._joined(parts[:len(parts) // 2 * 2:2], parts[1::2]) + odd
        return np.array(parts[0], "<u4").tobytes()

    def _joined(self, lefts: list[list[int]], rights: list[list[int]]) -> list[list[int]]:
        """Ids of left and right words as one, for each two of them."""
        out: list[list[int] | None] = [None] * len(lefts)
        keep = self._kept([(a[-1], b[0]) for a, b in zip(lefts, rights)])
        for k, kept in enumerate(keep):
            if kept:
                out[k] = lefts[k] + rights[k]
        width = SEAM
        while todo := [k for k, done in enumerate(out) if done is None]:
            seams = [self._bytes(lefts[k][-width:] + rights[k][:width]) for k in todo]
            found = self._batches(list(dict.fromkeys(seams)), PIECE_BYTES)
            middles = [np.frombuffer(found[s], "<u4").tolist() for s in seams]
            heads, tails = [lefts[k][:-width] for k in todo], [rights[k][width:] for k in todo]
            # A side that is used up has no border left.
            asked = [(h[-1], m[0]) if h else None for h, m in zip(heads, middles)]
            asked += [(m[-1], t[0]) if t else None for m, t in zip(middles, tails)]
            kept = iter(self._kept([pair for pair in asked if pair]))
            good = [pair is None or next(kept) for pair in asked]
            for i, (k, head, middle, tail) in enumerate(zip(todo, heads, middles, tails)):
                if good[i] and good[len(todo) + i]:
                    out[k] = head + middle + tail
            width *= 2
        return out

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.piece_of.__getitem__, ids))

    def _kept(self, pairs: list[tuple[int, int]]) -> list[bool]:
        """Whether two neighbouring tokens are the ids of their own bytes."""
        new = [pair for pair in dict.fromkeys(pairs) if pair not in self.keeps]
        if len(self.keeps) + len(new) > WORDS_KEPT:
            self.keeps, new = {}, list(dict.fromkeys(pairs))
        words = [self._bytes(list(pair)) for pair in new]
        found = self._batches(list(dict.fromkeys(words)), PIECE_BYTES)
        self.keeps.update((pair, found[w] == np.array(pair, "<u4").tobytes()) for pair, w in zip(new, words))
        return [self.keeps[pair] for pair in pairs]

    def decoded(self, ids: np.ndarray, part: np.ndarray) -> dict[int, bytes]:
        """Bytes of each part of a run of ids; ``part`` numbers the part of each id."""
        rows = pa.table({"part": part, "pos": np.arange(len(ids)), "token": ids.astype(np.int64)})
        found = self._query(DECODE, "id_rows", rows)
        return {int(p): piece.encode("latin-1") for p, piece in zip(found["part"], found["piece"])}


_loaded: dict[str, DuckBpe] = {}


def duck_bpe(path: str) -> DuckBpe:
    """The encoder of a worker; it outlives the task."""
    if path not in _loaded:
        _loaded[path] = DuckBpe(path)
    return _loaded[path]


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = duck_bpe(path)
        for batch in batches:
            texts, doc_ids = binary_texts(batch, "text"), batch.column("doc_id")
            for first, last in slices(texts, ENCODE_BYTES):
                ids, at = encoded(texts[first:last], bpe.ids_of)
                hashes = [hashlib.sha256() for _ in range(first, last)]
                for begin in range(0, len(ids), BATCH_IDS):
                    end = min(begin + BATCH_IDS, len(ids))
                    part = np.searchsorted(at, np.arange(begin, end), "right") - 1
                    for d, piece in bpe.decoded(ids[begin:end], part).items():
                        hashes[d].update(piece)
                raw = ids.astype("<u4")
                yield pa.record_batch({
                    "doc_id": doc_ids.slice(first, last - first),
                    "n_tokens": pa.array(np.diff(at), pa.int64()),
                    "ids": pa.array([raw[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary()),
                    "decoded_sha256": pa.array([h.hexdigest() for h in hashes], pa.string()),
                })

    return run


def encode_decode(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian 32-bit), decoded_sha256 for each row of docs (doc_id, text).

    A NULL text counts as empty: no ids, and the hash of no bytes. NULL and
    repeated ids are rows like any other. Other columns are ignored. An empty table
    gives no rows. A word may be as long as a text: the work grows with its bytes.
    """
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_round_trip(ranks), "doc_id long, n_tokens long, ids binary, decoded_sha256 string")
