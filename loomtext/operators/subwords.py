"""Byte-level subword units: a trainer, an encoder and a lossless decoder.

Texts are split into pieces and each piece's bytes are its first symbols, so every text
has an encoding and every encoding gives its text back.

Training counts each piece once (Spark) and then merges the pair of neighbours with the
largest count, again and again; of equal counts the pair with the smaller ids goes first.
Rewriting all pieces for each merge would be a job per merge. Instead a round finds many merges
that are certain to follow one another:

* The ``LEADING`` most frequent pairs come back. Each piece is cut where two neighbours form
  none of them; what is left between the cuts are segments, and equal ones are added up over
  all pieces. A merge of leading pairs happens inside a segment, and a pair that
  reaches over a cut is at most as frequent as the pair that was cut there.
* So the driver merges in the segments (an inverted table of pairs leads to those that hold one)
  for as long as the best pair is more frequent than the first one that doesn't lead. There are
  at most ``SEGMENTS`` segments: where there would be more, fewer pairs lead, down to one, whose
  merge is always certain.
* The pieces that hold a merged pair are rewritten once for all merges of the round, where
  they are stored; pieces that are whole leave the table. Each symbol is one letter there. In each turn
  every piece of a batch makes its earliest merge.

Texts are cut into pieces by the kinds of their characters, in all texts of a part at once; the kinds are those
that Spark's own expressions find. Only the distinct pieces of a part are counted or encoded.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..sources.stored import written

#: Split pattern of byte-level vocabularies (a fixed value of their format), for Java with Unicode's white space.
SPLIT = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Special tokens that a vocabulary begins with (fixed values).
SPECIALS = ("[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]")
#: Pairs that may lead in a round, and distinct segments that come back.
LEADING = 2048
SEGMENTS = 100_000
#: Bytes of the texts that are cut into pieces at once, and of those whose distinct pieces are found together.
_CUT = 1 << 19
_BYTES = 4 << 20
#: Units that are decoded together.
_UNITS = 1 << 19
#: Symbols up to which a table holds the merges of all pairs.
_DENSE = 2048

Pair = tuple[int, int]


def byte_letters() -> list[str]:
    """The letter by which a vocabulary writes each byte: printable Latin-1 letters stand
    for themselves, the other bytes for code points from 256 on, in their order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


@dataclass(frozen=True)
class ByteVocabulary:
    """Specials, the letters of all bytes in the order of their code points, and merges."""

    merges: list[Pair]
    specials: tuple[str, ...] = SPECIALS

    @property
    def first_ids(self) -> list[int]:
        """The id of each byte."""
        letters = byte_letters()
        place = {c: k for k, c in enumerate(sorted(letters))}
        return [len(self.specials) + place[c] for c in letters]

    @property
    def made(self) -> dict[Pair, int]:
        """The new symbol of each merge."""
        return {pair: len(self.specials) + 256 + k for k, pair in enumerate(self.merges)}

    @property
    def payloads(self) -> list[bytes]:
        """The bytes of each id; none for specials."""
        out = [b""] * len(self.specials) + [b""] * 256
        for b, k in enumerate(self.first_ids):
            out[k] = bytes([b])
        for x, y in self.merges:
            out.append(out[x] + out[y])
        return out


def pieces(text: Column, prefix_space: bool = True) -> Column:
    """The pieces of a text; with ``prefix_space`` a text that doesn't begin with a space
    gets one before it."""
    whole = F.when(F.startswith(text, F.lit(" ")) | (text == ""), text).otherwise(F.concat(F.lit(" "), text)) if prefix_space else text
    return F.regexp_extract_all(whole, F.lit(SPLIT), 0)


#: Kinds of characters; what is none of them is 0.
_LETTER, _NUMBER, _SPACE = 1, 2, 3


def kinds(spark: SparkSession) -> Broadcast:
    """The kind of each code point, as Spark's expressions see it; found once for each application."""
    kept = spark.sparkContext.__dict__
    if "_loomtext_kinds" not in kept:
        points = spark.range(0x110000).where("id not between 55296 and 57343")
        letter = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        kind = F.when(F.regexp_like(letter, F.lit(r"\p{L}")), _LETTER).when(F.regexp_like(letter, F.lit(r"\p{N}")), _NUMBER).when(F.regexp_like(letter, F.lit(r"(?U)\s")), _SPACE)
        found = points.select("id", kind.alias("kind")).where("kind is not null").toArrow()
        table = np.zeros(0x110000, np.uint8)
        table[found["id"].to_numpy()] = found["kind"].to_numpy()
        kept["_loomtext_kinds"] = spark.sparkContext.broadcast(table)
    return kept["_loomtext_kinds"]


def _parts(sizes: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Begins and ends of runs of rows whose sizes (of texts, of lists) sum up to at most so many, or of one row."""
    upto = np.cumsum(pc.fill_null(sizes, 0).to_numpy(), dtype=np.int64)
    begin = 0
    while begin < len(upto):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + most, "right")))
        yield begin, end
        begin = end


def split(texts: pa.Array, kind_of: np.ndarray, prefix_space: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, one text after the other, and how many each text has; the same as ``pieces``."""
    runs = [_split(texts[begin:end], kind_of, prefix_space) for begin, end in _parts(pc.binary_length(texts), _CUT)]
    return pa.concat_arrays([found for found, _ in runs]), np.concatenate([many for _, many in runs])


def _split(texts: pa.Array, kind_of: np.ndarray, prefix_space: bool) -> tuple[pa.Array, np.ndarray]:
    texts = pc.fill_null(texts.cast(pa.string()), "")
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        texts = pa.array([t.decode(errors="replace") for t in texts.cast(pa.binary()).to_pylist()], pa.string())
    if prefix_space:
        texts = pc.if_else(pc.or_(pc.starts_with(texts, " "), pc.equal(texts, "")), texts, pc.binary_join_element_wise("", texts, " "))
    bounds = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64))
    begin = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]
    if not bounds[-1]:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    data = texts.buffers()[2].slice(int(begin), int(bounds[-1]))
    byte = np.frombuffer(data, np.uint8)
    n = len(byte)
    kind = np.frombuffer(bytearray(data).translate(kind_of[:256].tobytes()), np.uint8)
    # every byte of a longer character has the character's kind
    lead = np.flatnonzero(byte >= 0xC0)
    more = 1 + (byte[lead] >= 0xE0) + (byte[lead] >= 0xF0)
    code = byte[lead].astype(np.int32) & (0x3F >> more)
    for k in (1, 2, 3):
        code = np.where(more >= k, code << 6 | byte[np.minimum(lead + k, n - 1)] & 0x3F, code)
    own = kind_of[code]
    kind[lead] = own
    for k in (1, 2, 3):
        kind[lead[more >= k] + k] = own[more >= k]
    first = np.zeros(n + 2, bool)
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    first[n:] = True  # nothing follows the last text
    space = np.append(kind == _SPACE, True)
    starts = np.ones(n, bool)
    # a kind begins; a blank goes with what follows it
    starts[1:] = (kind[1:] != kind[:-1]) & ~((byte[:-1] == 0x20) & ~space[1:n])
    # the last white space before something else
    starts[:-1] |= space[: n - 1] & ~space[1:n] & ~first[1:n] & (byte[:-1] < 0x80)
    wide, after = lead[own == _SPACE], (lead + more + 1)[own == _SPACE]
    starts[wide[~space[after] & ~first[after]]] = True
    starts |= first[:n]
    at = np.flatnonzero((byte == 0x27) & starts)
    padded = np.append(byte, np.zeros(2, np.uint8))
    one, two = padded[at + 1], padded[at + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = np.logical_or.reduce([(one == ord(x)) & (two == ord(y)) for x, y in ("re", "ve", "ll")]) & ~first[at + 2]
    held = (short | long) & ~first[at + 1]
    starts[at[held] + 1] = False
    ends = at[held] + np.where(short[held], 2, 3)
    starts[ends[ends < n]] = True
    begins = np.flatnonzero(starts)
    offsets = np.append(begins, n).astype(np.int32)
    return pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), data), np.diff(np.searchsorted(begins, bounds))


def piece_counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """piece and c (how often it stands) over all texts; null texts have none."""
    shared = kinds(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = shared.value
        for batch in batches:
            texts = batch.column(0)
            for begin, end in _parts(pc.binary_length(texts), _BYTES):
                found = split(texts[begin:end], kind_of)[0].dictionary_encode()
                c = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))
                yield pa.RecordBatch.from_arrays([found.dictionary, pa.array(c, pa.int64())], names=["piece", "c"])

    return docs.select(column).mapInArrow(run, "piece string, c long").groupBy("piece").agg(F.sum("c").alias("c"))


def merged(symbols: list[int], pair: Pair, new: int) -> list[int]:
    """The symbols with every occurrence of the pair, from the left, as one."""
    out, k = [], 0
    while k < len(symbols):
        if k + 1 < len(symbols) and symbols[k] == pair[0] and symbols[k + 1] == pair[1]:
            out.append(new)
            k += 2
        else:
            out.append(symbols[k])
            k += 1
    return out


#: Between two words of a joined text; no symbol is written so.
_GAP = 10
#: The rank of a pair that has no merge.
_NONE = np.int32(2**31 - 1)


def sign(symbol: int) -> str:
    """The letter that stands for a symbol while texts are rewritten; letters are in the order of the symbols."""
    return chr(symbol + 0x100 if symbol < 0xD700 else symbol + 0x900)


def _codes(joined: str) -> np.ndarray:
    """The code points of a joined text, with a gap at the end."""
    return np.frombuffer(f"{joined}\n".encode("utf-32-le"), np.uint32).astype(np.int64)


def _symbols(codes: np.ndarray) -> np.ndarray:
    """The symbols of code points; gaps are below 0."""
    return codes - np.where(codes < 0xD800, 0x100, 0x900)


def spelt(pieces: list[str], first: list[int]) -> str:
    """The pieces' bytes as signs, joined by gaps. A byte of 255 stands in no text."""
    letters = np.array([ord(sign(k)) for k in first], "<u4")
    letters[255] = _GAP
    return letters[np.frombuffer(b"\xff".join(map(str.encode, pieces)), np.uint8)].tobytes().decode("utf-32-le")


@dataclass(frozen=True)
class Merges:
    """Merges in their order, found by the pairs of many symbols at once. No symbol may be above the largest new one."""

    made: dict[Pair, int]

    @cached_property
    def new(self) -> np.ndarray:
        """The new symbol of each merge."""
        return np.array(list(self.made.values()), np.int32)

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.array(list(self.made), np.int64).T
        return x, y

    @cached_property
    def _table(self) -> np.ndarray:
        x, y = self._pairs
        k = int(self.new.max()) + 1
        table = np.full((k, k), _NONE, np.int32)
        table[x, y] = np.arange(len(x))
        return table

    @cached_property
    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        keys = self._pairs[0] << 32 | self._pairs[1]
        order = np.argsort(keys)
        return keys[order], order.astype(np.int32)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair's merge in the order; ``_NONE`` where it has none."""
        if not self.made:
            return np.full(len(a), _NONE, np.int32)
        if self.new.max() < _DENSE:
            return self._table[a, b]
        keys, order = self._sorted
        wanted = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, order[at], _NONE)


def encoded(symbols: np.ndarray, sizes: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of words (one after the other, with their sizes) after all merges, and the new sizes. In each turn
    every word makes its earliest merge, wherever it stands there; words without one are done. A merge's symbol
    stands only in later merges, so this is the same as one merge after the other in all words."""
    word = np.repeat(np.arange(len(sizes)), sizes)
    done_symbols, done_words = [symbols[:0]], [word[:0]]
    while len(symbols):
        begins = np.flatnonzero(np.diff(word, prepend=-1))
        lengths = np.diff(begins, append=len(symbols))
        rank = np.full(len(symbols), _NONE, np.int32)
        rank[:-1] = merges.ranks(symbols[:-1], symbols[1:])
        rank[begins[1:] - 1] = _NONE
        best = np.minimum.reduceat(rank, begins)
        left = np.repeat(best < _NONE, lengths)
        done_symbols.append(symbols[~left])
        done_words.append(word[~left])
        symbols, word, rank = symbols[left], word[left], rank[left]
        hit = rank == np.repeat(best[best < _NONE], lengths[best < _NONE])
        if (hit[1:] & hit[:-1]).any():  # equal symbols in a row are paired from the left
            at = np.flatnonzero(hit)
            runs = np.flatnonzero(np.diff(at, prepend=-2) > 1)
            hit[at[(np.arange(len(at)) - np.repeat(runs, np.diff(runs, append=len(at)))) % 2 == 1]] = False
        symbols[hit] = merges.new[rank[hit]]
        gone = np.flatnonzero(hit) + 1
        symbols, word = np.delete(symbols, gone), np.delete(word, gone)
    symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
    return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(sizes))


def replaced(joined: str, made: dict[Pair, int]) -> str:
    """The joined words after all merges, in their order."""
    codes = _codes(joined)
    gap = codes == _GAP
    symbols, sizes = encoded(_symbols(codes[~gap]), np.diff(np.flatnonzero(gap), prepend=-1) - 1, Merges(made))
    letters = np.insert(symbols + np.where(symbols < 0xD700, 0x100, 0x900), np.cumsum(sizes)[:-1], _GAP)
    return letters.astype("<u4").tobytes().decode("utf-32-le")


def certain_merges(segments: list[tuple[list[int], int]], floor: int, most: int, next_id: int, least: int) -> list[tuple[Pair, int]]:
    """(pair, count) of the merges that follow one another while the best pair of the segments is
    more frequent than ``floor``, and of the first one in any case."""
    texts = [list(s) for s, _ in segments]
    weight = [c for _, c in segments]
    counts: dict[Pair, int] = defaultdict(int)
    holders: dict[Pair, set[int]] = defaultdict(set)
    for k, s in enumerate(texts):
        for p in zip(s, s[1:], strict=False):
            counts[p] += weight[k]
            holders[p].add(k)
    queue = [(-n, p) for p, n in counts.items()]
    heapq.heapify(queue)
    out: list[tuple[Pair, int]] = []
    while queue and len(out) < most:
        n, pair = heapq.heappop(queue)
        if counts[pair] != -n:  # an older count
            continue
        if -n < least or (out and -n <= floor):
            break
        out.append((pair, -n))
        changed: set[Pair] = set()
        for k in holders.pop(pair):
            before = texts[k]
            after = texts[k] = merged(before, pair, next_id)
            if len(after) == len(before):
                continue
            for p in zip(before, before[1:], strict=False):
                counts[p] -= weight[k]
                changed.add(p)
            for p in zip(after, after[1:], strict=False):
                counts[p] += weight[k]
                holders[p].add(k)
                changed.add(p)
        counts[pair] = 0
        for p in changed - {pair}:
            if counts[p] > 0:
                heapq.heappush(queue, (-counts[p], p))
        next_id += 1
    return out


def _counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[begins], np.add.reduceat(weights[order], begins) if len(begins) else np.zeros(0, np.int64)


def _neighbours(joined: str, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, keys of each one and its next (0 at a gap) and the count of each one's word."""
    codes = _codes(joined)
    gap = codes == _GAP
    keys = np.zeros(len(codes), np.int64)
    keys[:-1] = np.where(gap[:-1] | gap[1:], 0, codes[:-1] << 21 | codes[1:])
    return codes, keys, np.repeat(c, np.diff(np.flatnonzero(gap), prepend=-1))


def _joined(batch: pa.RecordBatch) -> tuple[str, np.ndarray]:
    return "\n".join(batch.column(0).to_pylist()), batch.column(1).to_numpy()


def _pair_counts(words: DataFrame) -> DataFrame:
    """a, b and n: how often the symbols are neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, keys, c = _neighbours(*_joined(batch))
                keys, n = _counted(keys[keys > 0], c[keys > 0])
                yield pa.RecordBatch.from_arrays([pa.array(_symbols(keys >> 21), pa.int32()), pa.array(_symbols(keys & 0x1FFFFF), pa.int32()), pa.array(n)], names=["a", "b", "n"])

    return words.select("s", "c").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _segments(words: DataFrame, leading: set[Pair]) -> DataFrame:
    """s and c: the runs of symbols in which all neighbours are leading pairs, added up."""
    lead = np.array(sorted(ord(sign(a)) << 21 | ord(sign(b)) for a, b in leading))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, keys, c = _neighbours(*_joined(batch))
            inside = lead[np.minimum(np.searchsorted(lead, keys), len(lead) - 1)] == keys  # of a symbol and the next one
            held = inside.copy()
            held[1:] |= inside[:-1]
            ends = held & ~inside
            codes, c, ends = codes[held], c[ends], ends[held]
            runs = np.insert(codes, np.flatnonzero(ends) + 1, _GAP).astype("<u4").tobytes().decode("utf-32-le").split("\n")
            sums: dict[str, int] = defaultdict(int)
            for s, n in zip(runs, c.tolist(), strict=False):  # nothing stands behind the last gap
                sums[s] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["s", "c"])

    return words.select("s", "c").mapInArrow(run, "s string, c long").groupBy("s").agg(F.sum("c").alias("c"))


def _rewritten(words: DataFrame, made: dict[Pair, int]) -> DataFrame:
    """The words after the merges of a round; those without such a pair as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(replaced(_joined(batch)[0], made).split("\n") if batch.num_rows else [], pa.string()), batch.column(1)], names=["s", "c"])

    return words.select("s", "c").mapInArrow(run, "s string, c long").where(F.length("s") > 1)


def train(counts: DataFrame, merges: int, min_frequency: int = 2, specials: tuple[str, ...] = SPECIALS) -> list[tuple[Pair, int]]:
    """(pair of ids, count) of the merges over pieces (piece, c), fewer if no pair is left
    that stands ``min_frequency`` times. New symbols are numbered after specials and bytes."""
    ids = ByteVocabulary([], specials).first_ids

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(spelt(batch.column(0).to_pylist(), ids).split("\n") if batch.num_rows else [], pa.string()), batch.column(1)], names=["s", "c"])

    words = written(counts.select("piece", F.col("c").cast("long").alias("c")).mapInArrow(spell, "s string, c long").where(F.length("s") > 1))
    out: list[tuple[Pair, int]] = []
    leading = LEADING
    while len(out) < merges:
        top = _pair_counts(words).orderBy(F.desc("n"), "a", "b").limit(LEADING + 1).collect()
        if not top or top[0]["n"] < min_frequency:
            break
        leading = min(4 * leading, LEADING)
        while True:
            first = {(r["a"], r["b"]) for r in top[:leading]}
            # a sixteenth of the words holds about a sixth of the segments; where that is too many, the whole pass is spared.
            # how many pairs lead changes no merge
            if leading > 1 and _segments(words.where(F.pmod(F.xxhash64("s"), F.lit(16)) == 0), first).limit(SEGMENTS // 6 + 1).count() > SEGMENTS // 6:
                leading //= 2
                continue
            found = _segments(words, first).limit(SEGMENTS + 1).collect() if leading > 1 else [(top[0]["a"], top[0]["b"])]
            if len(found) <= SEGMENTS:
                break
            leading //= 2
        floor = top[leading]["n"] if len(top) > leading else 0
        next_id = len(specials) + 256 + len(out)
        if leading > 1:
            batch = certain_merges([(_symbols(_codes(r["s"]))[:-1].tolist(), r["c"]) for r in found], floor, merges - len(out), next_id, min_frequency)
        else:
            batch = [((top[0]["a"], top[0]["b"]), top[0]["n"])]
        made = {pair: next_id + k for k, (pair, _) in enumerate(batch)}
        out += batch
        if len(out) < merges:
            words = written(_rewritten(words, made))
    return out


def encode(docs: DataFrame, vocabulary: ByteVocabulary, column: str = "text", prefix_space: bool = True) -> DataFrame:
    """docs and ``ids``: the whole text's units. The distinct pieces of a part are encoded together."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.first_ids, vocabulary.made))
    shared_kinds = kinds(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    names = docs.columns
    place = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = shared.value
        first, merges, kind_of = np.array(first, np.int32), Merges(made), shared_kinds.value
        for whole in batches:
            for begin, end in _parts(pc.binary_length(whole.column(place)), _BYTES):
                batch = whole.slice(begin, end - begin)
                parts, many = split(batch.column(place), kind_of, prefix_space)
                found = parts.dictionary_encode()
                at_piece, distinct = found.indices.to_numpy(), found.dictionary
                length = pc.binary_length(distinct).to_numpy()
                # distinct pieces lie in one buffer of their own, from its begin on
                letters = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)[: length.sum()]
                units, sizes = encoded(first[letters], length, merges)
                begins = np.cumsum(sizes) - sizes
                size = sizes[at_piece]
                upto = np.append(0, np.cumsum(size))
                ids = units[np.repeat((begins[at_piece] - upto[:-1]).astype(np.int32), size) + np.arange(upto[-1], dtype=np.int32)]
                bounds = upto[np.append(0, np.cumsum(many))]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*names, "ids"])

    return docs.mapInArrow(run, schema)


def unit_counts(counts: DataFrame, merges: list[Pair], sizes: tuple[int, ...], specials: tuple[str, ...] = SPECIALS) -> DataFrame:
    """merges and units: how many units all pieces (piece, c) have after so many merges."""
    vocabulary = ByteVocabulary(merges, specials)
    first, made = vocabulary.first_ids, list(vocabulary.made.items())
    upto = sorted(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(upto, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            joined, c, done = spelt(batch.column(0).to_pylist(), first), batch.column(1).to_numpy(), 0
            for n in upto:  # more merges go on from fewer
                joined, done = replaced(joined, dict(made[done:n])), n
                total[n] += int(c @ (np.diff(np.flatnonzero(_codes(joined) == _GAP), prepend=-1) - 1))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["merges", "units"])

    return counts.select("piece", F.col("c").cast("long").alias("c")).mapInArrow(run, "merges long, units long").groupBy("merges").agg(F.sum("units").alias("units"))


def piece_units(counts: DataFrame, vocabulary: ByteVocabulary) -> DataFrame:
    """unit (its id) and c over all pieces (piece, c)."""
    first = vocabulary.first_ids
    made = vocabulary.made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = _codes(replaced(spelt(batch.column(0).to_pylist(), first), made))
            gap = codes == _GAP
            unit, c = _counted(_symbols(codes[~gap]), np.repeat(batch.column(1).to_numpy(), np.diff(np.flatnonzero(gap), prepend=-1) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int32()), pa.array(c, pa.int64())], names=["unit", "c"])

    return counts.select("piece", F.col("c").cast("long").alias("c")).mapInArrow(run, "unit int, c long").groupBy("unit").agg(F.sum("c").alias("c"))


def decode(ids: Column, vocabulary: ByteVocabulary) -> Column:
    """The text of units (without the space put before it, if any)."""
    payloads = [*vocabulary.payloads, b""]  # the last one for what is no unit

    def part(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        units = pc.fill_null(lists.flatten(), -1).to_numpy()
        units = np.where((units < 0) | (units >= len(payloads)), len(payloads) - 1, units)
        found = pa.array(payloads, pa.large_binary()).take(pa.array(units))
        upto = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1][np.append(0, np.cumsum(sizes))]
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(upto), found.buffers()[2]])
        return pc.if_else(lists.is_valid(), whole, pa.scalar(None, pa.large_binary())).cast(pa.binary())

    @F.arrow_udf("binary")
    def joined(lists: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.binary()), *(part(lists[begin:end]) for begin, end in _parts(pc.list_value_length(lists), _UNITS))])

    return F.decode(joined(ids), "UTF-8")
