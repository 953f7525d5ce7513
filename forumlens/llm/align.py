"""Alignment of the tokens of two tokenizers on the same bytes.

A slice of texts becomes two Arrow list arrays of ids, A and B. Flattened, with
the parent index of each token and the segmented cumulative sum of their byte
lengths, they are two tables of (document, end); an Acero hash join on those keys
gives the ends that both have, and these cut the tokens into groups. Tokens of a
group are counted by id and joined by group, which gives the linked id pairs of
each document without repeating equal tokens. ``Table.group_by`` counts the
documents of each pair within a task, and Spark merges those counts.

Pairs are looked up again for each document: the HOT most frequent ones in a
broadcast table of bounded size, all others by a join on the pair. A pair beyond the
first HOT is held by few documents, so no key of that join is hot.

Texts are encoded by distinct words, which the tokenizers see once. For A a word is
a match of its pattern, for B a run of spaces and what follows it: no piece of B has
a space behind another character, which is checked when it is loaded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forumlens.llm.common import binary_texts, slices, written
from forumlens.llm.pretokens import KnownWords, encoded, encoded_ranges, split_words, word_ids
from forumlens.session import scratch_folder

#: Id pairs that are broadcast, by the number of documents that hold them.
HOT = 200_000
#: Distinct pairs whose counts a task holds before it hands them on.
HELD = 1 << 20
ENCODE_BYTES = 1 << 20
#: Words of B that a worker keeps, and that are sent to its tokenizer as one text.
WORDS_KEPT, TOGETHER = 300_000, 1000
#: How B writes a space (a fixed value).
MARK = "▁"

ALIGNED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<long>, links array<int>, counted array<long>, documents array<int>")


class PieceIds:
    """Ids of words by a sentencepiece model; a word is a run of spaces with what follows it."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in pieces):
            raise ValueError("a piece reaches over the beginning of a word")
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.width = len(pieces)
        self.known = KnownWords(lambda data, sizes: self.learn(split_words(data, sizes)), WORDS_KEPT)

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has: none, if they do not spell the word."""
        runs: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        spelled = [i for i, w in enumerate(words) if MARK.encode() not in w]
        # Spaces at the end of a text would run into the next word.
        alone = [[i] for i in spelled if words[i].endswith(b" ")]
        plain = [i for i in spelled if not words[i].endswith(b" ")]
        for some in [plain[k:k + TOGETHER] for k in range(0, len(plain), TOGETHER)] + alone:
            whole = b"".join(words[i] for i in some)
            # The model puts one space in front by itself, if there is anything behind it.
            found = self.model.encode(whole[1:].decode(), num_threads=1) if len(whole) > 1 else [self.model.piece_to_id(MARK)]
            ids = np.array(found, np.uint32)
            if b"".join(map(self.bytes.__getitem__, ids.tolist())) != whole:
                continue
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(words[i]) for i in some])) + 1
            for i, begin, end in zip(some, [0, *ends[:-1].tolist()], ends.tolist()):
                runs[i] = ids[begin:end]
        return np.concatenate([*runs, np.zeros(0, np.uint32)]), np.array([len(r) for r in runs], np.int64)

    def encoded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that begin with a space, end to end, and where those of each text begin, and the end."""
        joined = b"".join(texts)
        space = np.frombuffer(joined, np.uint8) == 0x20
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        borders = np.cumsum([0] + [len(t) for t in texts])
        begins[borders[:-1][np.diff(borders) > 0]] = True
        starts = np.flatnonzero(begins)
        return encoded_ranges(joined, starts, np.append(starts[1:], len(joined)), np.searchsorted(starts, borders), self.known)


_loaded: dict[str, PieceIds] = {}


def piece_ids(path: str) -> PieceIds:
    """The model of a worker; it outlives the task."""
    if path not in _loaded:
        _loaded[path] = PieceIds(path)
    return _loaded[path]


def _tokens(ids: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> pa.Table:
    """doc, id, end and token number of the tokens of all texts; ``end`` is the byte behind a token in its text."""
    lists = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(ids, pa.uint32()))
    flat, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    sums = pc.cumulative_sum(pc.take(pa.array(sizes), flat))
    # The sum before each text, taken from all of its tokens.
    before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), sums]), pa.array(at[:-1], pa.int64()))
    return pa.table({
        "doc": doc, "id": flat, "end": pc.subtract(sums, pc.take(before, doc)),
        "token": pa.array(np.arange(len(ids)), pa.int64()),
    })


def _grouped(tokens: pa.Table, closing: np.ndarray) -> tuple[np.ndarray, pa.Table]:
    """The group of each token, and (group, id, count): ``closing`` are the tokens that end one."""
    last = np.zeros(len(tokens), np.int64)
    last[closing] = 1
    group = pc.subtract(pc.cumulative_sum(pa.array(last)), pa.array(last))
    counted = tokens.select(["doc", "id"]).append_column("group", group).group_by(["group", "id"], use_threads=False)
    return group.to_numpy(zero_copy_only=False), counted.aggregate([([], "count_all"), ("doc", "min")])


class Spelling:
    """Groups as text, ``a1,a2|b1;a3|b2,b3``, from rows of digits with a place for the mark behind them."""

    def __init__(self, ids: int):
        self.width = len(str(ids - 1))
        places = 10 ** np.arange(self.width - 1, -1, -1)
        digits = np.arange(ids)[:, None] // places % 10
        self.digits = np.concatenate([digits + ord("0"), np.zeros((ids, 1), np.int64)], axis=1).astype(np.uint8)
        self.shown = np.ones((ids, self.width + 1), bool)
        self.shown[:, :-1] = np.arange(ids)[:, None] >= places
        self.shown[0, self.width - 1] = True

    def __call__(self, ids_a, group_a, closing_a, ids_b, group_b, closing_b) -> tuple[np.ndarray, np.ndarray]:
        """The groups of all texts, each with a mark behind it, and where each group begins, and the end."""
        n = len(closing_a)
        # A token stands behind the B tokens of earlier groups, a B token behind the A tokens of its own group too.
        first_a, first_b = (np.searchsorted(g, np.arange(n + 1)) for g in (group_a, group_b))
        at_a, at_b = np.arange(len(ids_a)) + first_b[group_a], np.arange(len(ids_b)) + first_a[group_b + 1]
        ids, mark = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = ids_a, ids_b
        mark[at_a[closing_a]], mark[at_b[closing_b]] = ord("|"), ord(";")
        shown, text = self.shown[ids], self.digits[ids]
        text[:, -1] = mark
        to = np.concatenate([[0], np.cumsum(shown.sum(1))])
        return text[shown], to[first_a + first_b]


class Aligner:
    """Both tokenizers of a worker, and the number of an id pair."""

    def __init__(self, a: str, b: str):
        self.a, self.b = word_ids(a), piece_ids(b)
        self.width = len(self.b.bytes)
        self.spelling = Spelling(max(len(self.a.sizes), self.width))

    def __call__(self, texts: list[bytes | None]) -> tuple[dict[str, pa.Array], pa.Table]:
        """Columns of a row per text, and the table (pair, documents) of these texts."""
        texts = [b" " + t if t else b"" for t in texts]
        (ids_a, at_a), (ids_b, at_b) = encoded(texts, self.a), self.b.encoded(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        # Texts that either side does not spell have no tokens.
        good = np.ones(len(texts), bool)
        for ids, at, of in ((ids_a, at_a, self.a.sizes), (ids_b, at_b, self.b.sizes)):
            sums = np.concatenate([[0], np.cumsum(of[ids])])
            good &= sums[at[1:]] - sums[at[:-1]] == sizes
        ids_a, at_a = _only(ids_a, at_a, good)
        ids_b, at_b = _only(ids_b, at_b, good)
        a, b = _tokens(ids_a, at_a, self.a.sizes), _tokens(ids_b, at_b, self.b.sizes)
        ends = a.select(["doc", "end", "token"]).join(
            b.select(["doc", "end", "token"]), ["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False)
        closing_a, closing_b = (np.sort(ends.column(c).to_numpy()) for c in ("token", "token_b"))
        group_a, counted_a = _grouped(a, closing_a)
        group_b, counted_b = _grouped(b, closing_b)
        linked = counted_a.join(
            counted_b.select(["group", "id", "count_all"]), "group", join_type="inner", right_suffix="_b", use_threads=False)
        pair = pc.add(pc.multiply(linked["id"].cast(pa.int64()), self.width), linked["id_b"].cast(pa.int64()))
        links = pc.multiply(linked["count_all"], linked["count_all_b"])
        held = pa.table({"doc": linked["doc_min"].cast(pa.int64()), "pair": pair, "links": links}).group_by(
            ["doc", "pair"], use_threads=False).aggregate([("links", "sum")])
        documents = held.group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "documents"])
        doc, pair, links = (held.column(c).to_numpy() for c in ("doc", "pair", "links_sum"))
        order = np.lexsort((pair, doc))
        doc, pair, links = doc[order], pair[order], links[order]
        to = np.searchsorted(doc, np.arange(len(texts) + 1))
        sums = np.concatenate([[0], np.cumsum(links)])
        # Groups of a text: those that its A tokens close.
        of = np.searchsorted(closing_a, at_a)
        told, begin = self.spelling(ids_a, group_a, closing_a, ids_b, group_b, closing_b)
        shas = [
            hashlib.sha256(told[i:j - 1]).hexdigest() if j > i else ""
            for i, j in zip(begin[of[:-1]].tolist(), begin[of[1:]].tolist())]
        lists = pa.array(to, pa.int32())
        return {
            "n_a": pa.array(np.diff(at_a), pa.int64()), "n_b": pa.array(np.diff(at_b), pa.int64()),
            "n_groups": pa.array(np.diff(of), pa.int64()), "n_links": pa.array(sums[to[1:]] - sums[to[:-1]], pa.int64()),
            "groups_sha256": pa.array(shas, pa.string()),
            "pairs": pa.ListArray.from_arrays(lists, pa.array(pair, pa.int64())),
            "links": pa.ListArray.from_arrays(lists, pa.array(links, pa.int32())),
        }, documents


def _only(ids: np.ndarray, at: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the good texts; the others have none."""
    if good.all():
        return ids, at
    sizes = np.diff(at)
    return ids[np.repeat(good, sizes)], np.concatenate([[0], np.cumsum(np.where(good, sizes, 0))])


def _aligned(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, before = Aligner(a, b), TaskContext.get().partitionId() << 40
        kinds = {name: kind for name, kind in (f.split() for f in ALIGNED.split(", "))}
        counts: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(counts).group_by("pair", use_threads=False).aggregate(
                [("documents", "sum")]).rename_columns(["pair", "documents"])

        def handed_on(table: pa.Table) -> pa.RecordBatch:
            """A row that is no document but holds counts."""
            own = {
                "counted": pa.array([table["pair"].to_numpy()], pa.list_(pa.int64())),
                "documents": pa.array([table["documents"].to_numpy()], pa.list_(pa.int32()))}
            return pa.record_batch({name: own.get(name, pa.nulls(1, _ARROW[kind])) for name, kind in kinds.items()})

        for batch in batches:
            texts, doc_ids = binary_texts(batch, "text"), batch.column("doc_id")
            for first, last in slices(texts, ENCODE_BYTES):
                found, documents = aligner(texts[first:last])
                n = last - first
                own = found | {"row": pa.array(before + np.arange(n), pa.int64()), "doc_id": doc_ids.slice(first, n)}
                yield pa.record_batch({name: own.get(name, pa.nulls(n, _ARROW[kind])) for name, kind in kinds.items()})
                before += n
                counts.append(documents)
                if sum(map(len, counts)) > 2 * HELD:
                    counts[:] = [merged()]
                    if len(counts[0]) > HELD:
                        yield handed_on(counts.pop())
        if counts:
            yield handed_on(merged())

    return run


_ARROW = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def _looked_up(hot):
    """Sums of a document over the hot pairs, and what is left to be joined."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, documents, best = hot.value
        for batch in batches:
            lists, links = batch.column("pairs"), batch.column("links").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            to = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            at = np.minimum(np.searchsorted(pairs, values), max(len(pairs) - 1, 0))
            known = pairs[at] == values if len(pairs) else np.zeros(len(values), bool)
            own = np.where(known, links, 0)
            best_sums, count_sums, left = (
                np.concatenate([[0], np.cumsum(x)]) for x in (
                    own * best[at] if len(pairs) else own, own * documents[at] if len(pairs) else own, ~known))
            rest = pa.array(left[to], pa.int32())
            yield pa.record_batch({
                "row": batch.column("row"),
                "n_best": pa.array(best_sums[to[1:]] - best_sums[to[:-1]], pa.int64()),
                "count_sum": pa.array(count_sums[to[1:]] - count_sums[to[:-1]], pa.int64()),
                "pairs": pa.ListArray.from_arrays(rest, pa.array(values[~known], pa.int64())),
                "links": pa.ListArray.from_arrays(rest, pa.array(links[~known], pa.int32())),
            })

    return run


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """pair, documents, best (the most documents of any pair with its A id), from the counts that tasks handed on."""
    counts = aligned.select(F.explode(F.arrays_zip("counted", "documents")).alias("c")).groupBy(F.col("c.counted").alias("pair")).agg(
        F.sum("c.documents").alias("documents"))
    # At most as many pairs of one A id as B has ids.
    of_a = W.partitionBy(F.floor(F.col("pair") / F.lit(width)))
    return counts.select("pair", "documents", (F.col("documents") == F.max("documents").over(of_a)).cast("int").alias("best"))


def _hot_pairs(counts: DataFrame, hot: int) -> DataFrame:
    """The most frequent pairs, at most ``hot`` of them; pairs of about the same count are all in or all out.

    A pair that is out has fewer documents than ``hot`` pairs on average, or about
    as many as more than ``hot`` others.
    """
    band = F.floor(8 * F.log2("documents"))
    # At most eight rows per bit of a count.
    sizes = sorted(((r["band"], r["count"]) for r in counts.groupBy(band.alias("band")).count().collect()), reverse=True)
    lowest, held = None, 0
    for own, n in sizes:
        held += n
        if held > hot:
            break
        lowest = own
    return counts.filter(band >= lowest if lowest is not None else F.lit(False))


def align(docs: DataFrame, a: str | None = None, b: str | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs (doc_id, text).

    ``a`` is a byte-level tokenizer file, ``b`` a sentencepiece model that puts a
    space in front. A NULL or empty text, and one that either side does not spell
    byte for byte, has no tokens: zeros and an empty hash. Rows that repeat an id,
    and NULL ids, are rows like any other and each counts as a document. Other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    a, b = a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = scratch_folder(spark, "aligned")
    found = texts.mapInArrow(_aligned(a, b), ALIGNED)
    found.write.option("compression", "zstd").parquet(kept)
    aligned = spark.read.schema(found.schema).parquet(kept)
    rows = aligned.filter("row IS NOT NULL")
    counts = written(pair_counts(aligned, piece_ids(b).width), "pairs")
    top = _hot_pairs(counts, hot).toArrow().sort_by("pair")
    table = spark.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "documents", "best")))
    looked = written(rows.select("row", "pairs", "links").mapInArrow(
        _looked_up(table), "row long, n_best long, count_sum long, pairs array<long>, links array<int>"), "looked")
    rest = looked.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("c")).select(
        "row", F.col("c.pairs").alias("pair"), F.col("c.links").alias("links"))
    sums = rest.join(counts, "pair").select(
        "row", (F.col("links") * F.col("best")).alias("n_best"), (F.col("links") * F.col("documents")).alias("count_sum"))
    every = looked.select("row", "n_best", "count_sum").unionByName(sums).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(every, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
