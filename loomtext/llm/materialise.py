"""Training-order materialisation of token ids.

1. Texts are tokenised where they are read, an end-of-text id after each, and
   written once to the shared folder; later steps start from those files. The
   token stream is that of the table's rows in their order: by the number and name of
   the file and the row's place in it (tables that aren't read from files are
   sorted by doc_id and text and written first). A scan task meets runs of
   consecutive rows; each run's first row and number of ids say where in the stream it
   begins, so the stream is cut into sequences of ``length`` ids alike however
   the files were split.
2. A keyed Feistel permutation on the next even power of two, walked until
   it falls below the number of sequences, gives each its global slot: a bijection
   that needs no shuffle to know. With ``window``, each stretch of so many sequences
   has a permutation of its own, so that what an earlier stage has put in order (a mix of
   sources) holds for every stretch.
3. Sequences are dealt by ranges of slots and sorted inside them. A shard is
   ``shard_rows`` consecutive slots. ``write_shards`` writes each as one binary file of
   fixed stride (little-endian ids and one line feed for each slot): slot s stands at byte
   (s mod shard_rows) * stride of file s div shard_rows, so ``read_sequences``
   resumes at any slot without an index.

Defined results: null and empty texts give the end-of-text id alone; the last
sequence is filled up with that id (n_tokens tells how many are real); rows that
repeat are packed as often as they stand; a very long text spans as many
sequences as it takes; an empty table gives none.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._store import written
from ._text import stream

#: Split pattern of the byte-level vocabularies (a fixed value of their format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

LENGTH = 512
SHARD_ROWS = 1024
#: Sequences that a range partition holds, about (a whole number of shards).
PARTITION_ROWS = 32 * SHARD_ROWS


def end_id(ranks: bytes) -> tuple[int, np.dtype]:
    """The id of the end of a text (one more than the vocabulary's last) and the
    type that holds all ids."""
    end = max(int(line.split()[1]) for line in ranks.splitlines() if line) + 1
    return end, np.dtype("<u2") if end < 1 << 16 else np.dtype("<u4")


class Tokenizer:
    """Byte-level BPE; chunks between single spaces are looked up once.

    A piece of the split pattern has a space only at its start or in a run of
    white space, so a text whose spaces all stand alone between other characters
    can be cut before each of them without changing its ids.
    """

    def __init__(self, ranks: bytes, cache: int = 200_000) -> None:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.end, self.dtype = end_id(ranks)
        self._bpe = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self._seen: dict[str, bytes] = {}
        self._most = cache

    def _ids(self, text: str) -> bytes:
        return np.array(self._bpe.encode_ordinary(text), self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as bytes."""
        first, *rest = text.split(" ")
        if not rest or not first or first[-1].isspace() or not all(rest):
            return self._ids(text)
        seen, out = self._seen, [self._ids(first)]
        for word in rest:
            got = seen.get(word)
            if got is None:
                if word[0].isspace() or word[-1].isspace():
                    return self._ids(text)
                if len(seen) >= self._most:
                    seen.clear()
                got = seen[word] = self._ids(" " + word)
            out.append(got)
        return b"".join(out)


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file, read once by the driver and sent to the executors."""
    with open(path, "rb") as f:
        return f.read()


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of range(n): balanced Feistel rounds on the next
    even power of two, repeated until the value is below n (cycle-walking)."""

    n: int
    key: int
    rounds: int = 6

    def __call__(self, index: np.ndarray) -> np.ndarray:
        half = np.uint64(max(1, ((max(self.n, 2) - 1).bit_length() + 1) // 2))
        low = np.uint64((1 << int(half)) - 1)
        keys = stream(self.key, self.rounds)
        out = np.asarray(index).astype(np.uint64)
        todo = np.arange(len(out))
        while len(todo):
            left, right = out[todo] >> half, out[todo] & low
            for k in keys:
                f = (right ^ k) * np.uint64(0xBF58476D1CE4E5B9)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((f >> np.uint64(32)) & low)
            out[todo] = (left << half) | right
            todo = todo[out[todo] >= np.uint64(self.n)]
        return out.astype(np.int64)


@dataclass(frozen=True)
class Permutation:
    """A permutation of range(n); with a window, one in each stretch of so many."""

    n: int
    key: int
    window: int | None = None

    def __call__(self, index: np.ndarray) -> np.ndarray:
        if self.window is None:
            return Feistel(max(self.n, 1), self.key)(index)
        out = np.empty(len(index), np.int64)
        stretch = index // self.window
        for k in np.unique(stretch):
            here, first = stretch == k, int(k) * self.window
            out[here] = first + Feistel(min(self.window, self.n - first), self.key + int(k))(index[here] - first)
        return out


#: Ids that a task writes in one row, about; a longer text is still one row.
_ROW_IDS = 1 << 16


def in_file_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, file (its number and name), block (where the part of the file
    that is read at once begins) and row of each row of docs."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = written(docs.select("doc_id", "text").repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text"))
    path = F.col("_metadata.file_path")
    number = F.lpad(F.regexp_extract(path, r"part-(\d+)[^/]*$", 1), 12, "0")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.concat_ws(" ", number, path).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.row_index").cast("long").alias("row"))


def tokenised(docs: DataFrame, vocabulary: bytes) -> DataFrame:
    """Pieces of the token stream, each of whole texts: file, run (the first row of the
    rows that a task has read in a row), at (ids of the run before it), n, doc_ids,
    starts (where in the piece each text begins) and tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = ["file", "run", "at", "n", "doc_ids", "starts", "tokens"]

    def run(batches):
        tok = Tokenizer(shared.value)
        size, end = tok.dtype.itemsize, np.array([tok.end], tok.dtype).tobytes()
        now, first, before, parts, ids, starts, held = None, 0, 0, [], [], [], 0

        def piece():
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            row = (now[0], first, before, held, ids, starts, b"".join(parts))
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for doc_id, text, file, block, row in zip(batch.column("doc_id").to_pylist(), batch.column("text"), *(batch.column(c).to_pylist() for c in ("file", "block", "row")), strict=True):
                if now != (file, block):
                    if ids:
                        yield piece()
                    first, before, parts, ids, starts, held = row, 0, [], [], [], 0
                elif held >= _ROW_IDS:
                    yield piece()
                    before, parts, ids, starts, held = before + held, [], [], [], 0
                now = (file, block)
                parts.append(tok.encode(text.as_py() or "") + end)
                ids.append(doc_id)
                starts.append(held)
                held += len(parts[-1]) // size
        if ids:
            yield piece()

    return in_file_order(docs).mapInArrow(run, "file string, run long, at long, n long, doc_ids array<long>, starts array<long>, tokens binary")


def materialise(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, length: int = LENGTH, shard_rows: int = SHARD_ROWS, key: int = 20240229, window: int | None = None) -> DataFrame:
    """slot, shard, byte_offset (in the shard's file), sequence (before the
    permutation), n_tokens, first_doc_id, n_docs (that have ids in it) and tokens of
    every sequence, each range of slots in one partition and sorted by slot."""
    spark: SparkSession = docs.sparkSession
    ranks = read_vocabulary(vocabulary)
    pieces = written(tokenised(docs, ranks))
    # one row for each run of rows that a task has read: a few for each file split
    runs = pieces.groupBy("file", "run").agg(F.sum("n").alias("n")).toArrow().sort_by([("file", "ascending"), ("run", "ascending")])
    ends = np.cumsum(np.concatenate([[0], runs.column("n").to_numpy()])).astype(np.int64)
    ids, total = int(ends[-1]), -(-int(ends[-1]) // length)
    bases = spark.sparkContext.broadcast({(f, r): b for f, r, b in zip(runs.column("file").to_pylist(), runs.column("run").to_pylist(), ends[:-1].tolist(), strict=True)})
    filler, kind = end_id(ranks)
    permute = Permutation(total, key, window)
    parts = max(1, -(-total // PARTITION_ROWS), min(-(-total // shard_rows), spark.sparkContext.defaultParallelism))
    shards = -(-max(total, 1) // shard_rows)
    size, stride = kind.itemsize, length * kind.itemsize

    def cut(batches):
        """The parts of sequences that a piece holds; whole ones but for its ends."""
        for batch in batches:
            for file, run, at, n, doc_ids, starts, tokens in zip(*(batch.column(c).to_pylist() for c in ("file", "run", "at", "n", "doc_ids", "starts", "tokens")), strict=True):
                begin = bases.value[file, run] + at
                first, last = begin // length, (begin + n - 1) // length
                number = np.arange(first, last + 1)
                left = np.maximum(number * length, begin) - begin
                right = np.minimum((number + 1) * length, begin + n) - begin
                opened = np.searchsorted(starts, left, "right") - 1  # the text that an id at left belongs to
                held = np.searchsorted(starts, right, "left") - opened
                slot = permute(number)
                columns = [pa.array(x) for x in ((slot // shard_rows * parts // shards).astype(np.int32), slot, number, (begin + left) % length)]
                more = [pa.array(right - left), pa.array([doc_ids[k] for k in opened.tolist()], pa.int64()), pa.array(held.astype(np.int32)), pa.array([tokens[a * size : b * size] for a, b in zip(left.tolist(), right.tolist(), strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns + more, names=["part", "slot", "sequence", "place", "n", "doc_id", "held", "tokens"])

    def joined(batches):
        """Whole sequences from parts that are sorted by slot and place."""
        rows: list[list] = []

        def batch_of(done):
            for r in done:
                if r[2] < length:  # the last sequence
                    r[5] += np.full(length - r[2], filler, kind).tobytes()
            slots = np.array([r[0] for r in done], np.int64)
            columns = [pa.array(slots), pa.array(slots // shard_rows), pa.array(slots % shard_rows * (stride + 1)), *(pa.array([r[k] for r in done], kind_of) for k, kind_of in ((1, pa.int64()), (2, pa.int32()), (3, pa.int64()), (4, pa.int32()))), pa.array([bytes(r[5]) for r in done], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["slot", "shard", "byte_offset", "sequence", "n_tokens", "first_doc_id", "n_docs", "tokens"])

        for batch in batches:
            for slot, sequence, n, doc_id, held, tokens in zip(*(batch.column(c).to_pylist() for c in ("slot", "sequence", "n", "doc_id", "held", "tokens")), strict=True):
                if rows and rows[-1][0] == slot:
                    rows[-1][2] += n
                    rows[-1][4] += held
                    rows[-1][5] += tokens
                else:
                    if len(rows) >= 2048:
                        yield batch_of(rows)
                        rows = []
                    rows.append([slot, sequence, n, doc_id, held, bytearray(tokens)])
        if rows:
            yield batch_of(rows)

    placed = pieces.mapInArrow(cut, "part int, slot long, sequence long, place long, n long, doc_id long, held int, tokens binary")
    placed = placed.repartitionById(parts, "part").sortWithinPartitions("slot", "place")
    return placed.mapInArrow(joined, "slot long, shard long, byte_offset long, sequence long, n_tokens int, first_doc_id long, n_docs int, tokens binary")


def write_shards(placed: DataFrame, path: str, shard_rows: int = SHARD_ROWS) -> None:
    """Writes materialise's result as binary files, one for each shard, through
    Spark to any store that it can reach: the ids of each slot and a line feed."""
    # a partition holds whole shards in order, so files of shard_rows rows are the shards
    placed.select(F.col("tokens").cast("string")).write.mode("overwrite").option("maxRecordsPerFile", shard_rows).option("lineSep", "\n").text(path)


def read_sequences(spark: SparkSession, path: str, first: int = 0, shard_rows: int = SHARD_ROWS, length: int = LENGTH, kind: str = "<u2") -> Iterator[np.ndarray]:
    """The sequences of written shards from slot ``first`` on, in order, one shard
    in memory at a time."""
    number = lambda name: [int(x) for x in re.findall(r"part-(\d+)[^/]*-c(\d+)", name)[0]]
    names = sorted(spark.read.format("binaryFile").load(path).select("path").toArrow().column("path").to_pylist(), key=number)
    stride = length * np.dtype(kind).itemsize + 1
    for k in range(first // shard_rows, len(names)):
        payload = spark.read.format("binaryFile").load(names[k]).select("content").first()[0]
        for at in range((first % shard_rows if k == first // shard_rows else 0) * stride, len(payload), stride):
            yield np.frombuffer(payload, kind, length, at)
