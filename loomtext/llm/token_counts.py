"""Token counts by a tokenizer that is compiled to finite-state transducers.

Byte-level BPE is a cascade of two deterministic transducers:

1. The splitter reads classes of code points. Its transitions are annotated with the
   places where pieces begin; what later symbols decide (the last of several blanks, a
   contraction of two letters) is emitted one symbol late. A block of texts, each closed by
   an end symbol, is cut into chunks of equal length. All chunks are stepped at once from
   every state until their states meet (after ``horizon`` symbols, found when the
   transducer is compiled), then from the one that is left. So each chunk has a map from
   states to states, and the maps compose by an inclusive prefix scan in log2(chunks)
   rounds: that gives each chunk's true first state.
2. The counter reads the bytes of a piece. A prefix of a piece has one encoding, and its
   last token is the one that ends there and stays apart from the last token before it
   (``Vocabulary.apart``). A state holds every place from which a token of the vocabulary may
   still grow, with the last token and the relative count there; a transition is annotated
   with how many tokens the byte adds (or, where tokens merge, takes back). States
   are compiled when they are first reached, into one table of fixed size that is started
   again when it is full. All pieces of a block are stepped at once; a piece of more than
   ``SPAN`` bytes is cut into chunks that start from a state guessed by running the chunk
   before from the first state. Where the composition shows that a chunk starts
   elsewhere, its map is evaluated there too, so counts are exact.

Special tokens that stand in a text count one each and divide it, as the library does
it. The classes of code points are asked of the library once, on the driver; the texts never
pass through it.

Defined results: null and empty texts have no bytes and no tokens; a very long text
is counted in slices of ``BLOCK`` bytes that end at a piece; repeated rows have equal
counts; an empty table gives an empty one; a column of the table that is named like a new
one is replaced, all others stay.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from ._frames import with_arrow_columns

#: Bytes that are counted at once, about.
BLOCK = 1 << 21
#: Symbols of a splitter's chunk.
CHUNK = 512
#: Bytes of a counter's chunk.
SPAN = 64
#: States that the counter's table holds.
STATES = 1 << 17
#: Tokens beyond a node up to which states are compared by them.
FEW = 64

# classes of code points (the letters are those of contractions: 's 't 'm 'd, 're, 've, 'll)
END, BLANK, WHITE, LETTER, NUMBER, OTHER, QUOTE, ONE, R, V, E, L = range(12)
CLASSES = 12
# states of the splitter: within a run of letters, numbers or others, after an apostrophe
# that begins a piece (and r, v or l), after a contraction, after one or more blanks
BEGIN, LETTERS, NUMBERS, OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, CLOSED, BLANK1, BLANKS, WHITE1, WHITES = range(13)
SPLITTER_STATES = 13
#: Annotations: a piece begins at this symbol, at the one before it.
HERE, BEFORE = 1, 2


def _split_step(state: int, c: int) -> tuple[int, int]:
    """The next state and the annotation."""
    letter = c in (LETTER, ONE, R, V, E, L)
    run = LETTERS if letter else {NUMBER: NUMBERS, OTHER: OTHERS, QUOTE: OTHERS}.get(c)
    if c == END:
        return BEGIN, HERE | (BEFORE if state in (QUOTED_R, QUOTED_V, QUOTED_L) else 0)
    if state in (QUOTED_R, QUOTED_V, QUOTED_L):
        if (state, c) in ((QUOTED_R, E), (QUOTED_V, E), (QUOTED_L, L)):
            return CLOSED, 0
        after, marks = _split_step(LETTERS, c)
        return after, marks | BEFORE
    if state == QUOTED:
        of_two = {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}
        return (CLOSED, 0) if c == ONE else (of_two[c], 0) if c in of_two else _split_step(OTHERS, c)
    if state in (BLANK1, BLANKS, WHITE1, WHITES) and c in (BLANK, WHITE):
        return (BLANKS if c == BLANK else WHITES), 0
    if state in (BLANK1, BLANKS):  # a blank joins what follows it
        return run, BEFORE if state == BLANKS else 0
    if state == WHITES:
        after, marks = _split_step(BEGIN, c)
        return after, marks | BEFORE
    if state in (LETTERS, NUMBERS, OTHERS) and run == state:
        return state, 0
    return {BLANK: BLANK1, WHITE: WHITE1, QUOTE: QUOTED}.get(c, run), HERE


class Splitter:
    """The first transducer over code points."""

    def __init__(self, classes: bytes) -> None:
        starts, kinds = np.frombuffer(zlib.decompress(classes), np.int32).reshape(2, -1)
        self.classes = np.repeat(kinds, np.diff(np.append(starts, 0x110000))).astype(np.uint8)
        steps = [_split_step(s, c) for s in range(SPLITTER_STATES) for c in range(CLASSES)]
        self.next = np.array([s * CLASSES for s, _ in steps], np.uint8)  # rows of the table
        self.marks = np.array([m for _, m in steps], np.uint8)
        self.horizon = self._horizon()

    def _horizon(self) -> int:
        """The least number of symbols after which every word has led all states to one."""
        sets, n = {frozenset(range(0, SPLITTER_STATES * CLASSES, CLASSES))}, 0
        while any(len(x) > 1 for x in sets):
            sets = {frozenset(int(self.next[s + c]) for s in x) for x in sets if len(x) > 1 for c in range(CLASSES)}
            n += 1
        return n

    def begins(self, symbols: np.ndarray) -> np.ndarray:
        """Whether a piece (or an end symbol) stands at each symbol; each text is closed by END."""
        lanes = max(1, -(-len(symbols) // CHUNK))
        x = np.full(lanes * CHUNK, END, np.uint8)
        x[: len(symbols)] = symbols
        x = np.ascontiguousarray(x.reshape(lanes, CHUNK).T)
        marks = np.empty((CHUNK, lanes), np.uint8)
        every = np.arange(SPLITTER_STATES, dtype=np.uint8) * CLASSES
        state = np.repeat(every[:, None], lanes, axis=1)
        for k in range(self.horizon):
            state = self.next[state + x[k]]
        state = state[0]  # all are equal
        for k in range(self.horizon, CHUNK):
            at = state + x[k]
            marks[k] = self.marks[at]
            state = self.next[at]
        maps = np.repeat((state // CLASSES)[:, None], SPLITTER_STATES, axis=1)
        state = compose(maps)[:, BEGIN] * CLASSES
        state = np.concatenate([[np.uint8(BEGIN)], state[:-1]]).astype(np.uint8)
        for k in range(self.horizon):
            at = state + x[k]
            marks[k] = self.marks[at]
            state = self.next[at]
        flat = marks.T.reshape(-1)[: len(symbols)]
        out = (flat & HERE) != 0
        out[:-1] |= (flat[1:] & BEFORE) != 0
        return out


def compose(maps: np.ndarray) -> np.ndarray:
    """The inclusive prefix scan of maps [chunk, state] -> state: row k is the map
    of all chunks up to k."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], axis=1)
        step *= 2
    return out


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1
    stands for itself, the other bytes for code points from 256 on in their order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Merges of a byte-level BPE file, and a trie of its tokens."""

    def __init__(self, model: dict) -> None:
        letter = byte_letters()
        number = model["vocab"]
        self.rank: dict[int, int] = {}
        #: for each token the tokens at its right and left end, from single bytes up, with the ranks that form them
        self.right: dict[int, tuple[tuple[int, int], ...]] = {}
        self.left: dict[int, tuple[tuple[int, int], ...]] = {}
        for c in letter:
            self.right[number[c]] = self.left[number[c]] = ((number[c], -1),)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, xy = number[a], number[b], number[a + b]
            self.rank[x << 32 | y] = rank
            self.right[xy] = (*self.right[y], (xy, rank))
            self.left[xy] = (*self.left[x], (xy, rank))
        self.child: dict[int, int] = {}
        self.token = [-1]
        parent = [0]
        for text, t in number.items():
            if t not in self.right:
                continue  # no merge makes it
            node = 0
            for c in text:
                key = node << 8 | letter[c]
                above, node = node, self.child.setdefault(key, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
                    parent.append(above)
            self.token[node] = t
        #: the tokens that go on beyond a node (None: more than ``FEW``)
        self.below: list[list[int] | None] = [[] for _ in parent]
        for node in range(len(parent) - 1, 0, -1):  # a node's number is larger than its parent's
            own, up = self.below[node], self.below[parent[node]]
            if up is not None:
                up += [*(own or ()), *([self.token[node]] if self.token[node] >= 0 else [])]
                if own is None or len(up) > FEW:
                    self.below[parent[node]] = None
        self._apart: dict[int, bool] = {}
        self._open: dict[int, int] = {}
        self._alike: dict[tuple[int, int], int] = {}

    def open(self, node: int, before: int) -> int:
        """What stands for the token before an open place: tokens that are apart from
        the same tokens beyond the node are one, so that their states are; -1 if all
        are apart, -2 if none is (nothing can grow from there)."""
        key = node << 32 | (before + 1)
        known = self._open.get(key)
        if known is None:
            tokens = self.below[node]
            if tokens is None:
                known = before
            else:
                mask = 0
                for k, t in enumerate(tokens):
                    mask |= (before < 0 or self.apart(before, t)) << k
                known = -2 if not mask else -1 if mask == (1 << len(tokens)) - 1 else self._alike.setdefault((node, mask), before)
            if len(self._open) >= 1 << 20:
                self._open.clear()
            self._open[key] = known
        return known

    def apart(self, x: int, y: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these tokens: no merge across
        the seam comes before those that form its neighbours. Of equal merges the left goes first."""
        key = x << 32 | y
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) >= 1 << 20:
                self._apart.clear()
            known = self._apart[key] = self._stay(self.right[x], self.left[y])
        return known

    def _stay(self, a: tuple, b: tuple) -> bool:
        i = j = 0
        never = 1 << 60
        while True:
            ra = a[i + 1][1] if i + 1 < len(a) else never
            rb = b[j + 1][1] if j + 1 < len(b) else never
            across = self.rank.get(a[i][0] << 32 | b[j][0], never)
            if across < ra and across <= rb and across < never:
                return False
            if ra == rb == never:
                return True
            if ra <= rb:
                i += 1
            else:
                j += 1


#: The annotation of a transition is kept in the low byte beside the next state.
_ZERO = 128


class Counter:
    """The second transducer: states are compiled as they are reached."""

    def __init__(self, vocabulary: Vocabulary, states: int = STATES) -> None:
        self.vocabulary = vocabulary
        self.most = states
        self.table = np.zeros(1, np.int32)
        self._restart()

    def _restart(self) -> None:
        self.table = np.full(self.most * 256, -1, np.int32)
        self.keys: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.first = self._state(((0, -1, 0),))

    def _state(self, key: tuple) -> int:
        k = self.number.get(key)
        if k is None:
            k = self.number[key] = len(self.keys)
            self.keys.append(key)
        return k

    def _compile(self, state: int, byte: int) -> int:
        """Adds the transition; a state is (node, last token, count) of each open place."""
        v = self.vocabulary
        opened, last, delta = [], -1, 0
        for node, before, count in self.keys[state]:
            child = v.child.get(node << 8 | byte)
            if child is None:
                continue
            stands = v.open(child, before)
            if stands != -2:
                opened.append((child, stands, count))
            t = v.token[child]
            if t >= 0 and (before < 0 or v.apart(before, t)):
                last, delta = t, count + 1
        key = (*((c, b, n - delta) for c, b, n in opened), (0, last, 0))
        if not -_ZERO <= delta < _ZERO:
            raise OverflowError("a byte takes back too many tokens")
        to = self.table[state << 8 | byte] = self._state(key) << 8 | (delta + _ZERO)
        return int(to)

    def _after(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Transitions of lanes (renumbered if the table was started again), and the lanes' states before."""
        at = (state << 8) | byte
        got = self.table[at]
        missing = got < 0
        if missing.any():
            new = np.unique(at[missing])
            if len(self.keys) + len(new) > self.most:  # keep the states that are in use
                used, where = np.unique(state, return_inverse=True)
                keys = [self.keys[s] for s in used.tolist()]
                while 2 * (len(keys) + len(new)) + 2 > self.most:
                    self.most *= 2
                self._restart()
                state = np.array([self._state(k) for k in keys], np.int64)[where]
                return self._after(state, byte)
            for k in new.tolist():
                self._compile(k >> 8, k & 255)
            got = self.table[at]
        return got, state

    def run(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, keys: list[tuple] | None = None) -> tuple[np.ndarray, list[tuple]]:
        """Emitted counts of the byte ranges, stepped at once from the first state (or
        from the states of ``keys``), and with ``keys`` the states after them."""
        order = np.argsort(-size, kind="stable")
        begin, length = start[order], size[order]
        counts = np.zeros(len(order), np.int64)
        state = np.full(len(order), self.first, np.int64)
        if keys is not None:
            if len(self.keys) + len(keys) > self.most // 2:
                while 2 * len(keys) + 2 > self.most:
                    self.most *= 2
                self._restart()
            state = np.array([self._state(keys[k]) for k in order.tolist()], np.int64)
        ended: list[tuple] = [()] * len(order)
        active, k = len(order), 0
        while True:
            still = int(np.searchsorted(-length[:active], -k, "left"))  # those longer than k
            if keys is not None:
                for lane in range(still, active):
                    ended[order[lane]] = self.keys[state[lane]]
            active = still
            if not active:
                break
            got, _ = self._after(state[:active], data[begin[:active] + k])
            state[:active] = got >> 8
            counts[:active] += (got & 255) - _ZERO
            k += 1
        out = np.empty_like(counts)
        out[order] = counts
        return out, ended

    def one(self, data: bytes, key: tuple) -> tuple[int, tuple]:
        """The map of one chunk at one state."""
        if len(self.keys) + len(data) > self.most:
            self._restart()
        state, count, table = self._state(key), 0, self.table
        for b in data:
            got = int(table[state << 8 | b])
            if got < 0:
                got = self._compile(state, b)
            state = got >> 8
            count += (got & 255) - _ZERO
        return count, self.keys[state]

    def count(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each piece."""
        out = np.zeros(len(start), np.int64)
        short = size <= SPAN
        out[short] = self.run(data, start[short], size[short])[0]
        long = np.flatnonzero(~short)
        if len(long):
            chunks = -(-size[long] // SPAN)
            owner = np.repeat(np.arange(len(long)), chunks)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
            begin = start[long][owner] + place * SPAN
            width = np.minimum(SPAN, (start + size)[long][owner] - begin)
            origin = ((0, -1, 0),)
            counts, ends = self.run(data, begin, width, [origin] * len(owner))
            guess = [origin if p == 0 else ends[k - 1] for k, p in enumerate(place.tolist())]
            later = np.flatnonzero(place > 0)
            more, after = self.run(data, begin[later], width[later], [guess[k] for k in later.tolist()])
            for k, n, e in zip(later.tolist(), more.tolist(), after, strict=True):
                counts[k], ends[k] = n, e
            for k in later.tolist():  # the maps compose from left to right
                if ends[k - 1] != guess[k]:
                    counts[k], ends[k] = self.one(data[begin[k] : begin[k] + width[k]].tobytes(), ends[k - 1])
            np.add.at(out, long[owner], counts)
        return out


class CompiledTokenizer:
    """Both transducers of one vocabulary file."""

    def __init__(self, payload: bytes, classes: bytes) -> None:
        model = json.loads(payload)
        self.special = [t["content"].encode() for t in model["added_tokens"]]
        self.splitter = Splitter(classes)
        self.counter = Counter(Vocabulary(model["model"]))

    def _pieces(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of texts begin and end in their joined bytes."""
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        width = np.ones(len(points), np.int64)
        for above in (0x7F, 0x7FF, 0xFFFF):
            width += points > above
        offset = np.cumsum(width) - width
        closing = np.searchsorted(offset, ends, "left")
        symbols = np.insert(self.splitter.classes[points], closing, END)
        offset = np.insert(offset, closing, ends)
        at = np.flatnonzero(self.splitter.begins(symbols))
        real = symbols[at[:-1]] != END
        return offset[at[:-1]][real], offset[at[1:]][real]

    def _segments(self, text: bytes) -> tuple[list[bytes], int]:
        """The text between special tokens, and how many there are."""
        out, n, at = [], 0, 0
        while True:
            found = [(p, -len(s), s) for s in self.special if (p := text.find(s, at)) >= 0]
            if not found:
                return [*out, text[at:]], n
            p, _, s = min(found)
            out.append(text[at:p])
            at, n = p + len(s), n + 1

    def _long(self, text: bytes) -> int:
        """Tokens of one long text, in slices that end where a piece does."""
        total, at, size = 0, 0, BLOCK
        while at < len(text):
            end = min(len(text), at + size)
            while end < len(text) and text[end] & 0xC0 == 0x80:
                end += 1
            part = text[at:end]
            begin, stop = self._pieces(part, np.array([len(part)]))
            if end < len(text):  # the last symbols may belong to what follows
                sure = int(np.searchsorted(begin, len(part) - 64, "right")) - 1
                if sure <= 0:
                    size *= 2
                    continue
                begin, stop, cut = begin[:sure], stop[:sure], int(begin[sure])
            else:
                cut = len(part)
            total += int(self.counter.count(np.frombuffer(part, np.uint8), begin, stop - begin).sum())
            at, size = at + cut, BLOCK
        return total

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text (UTF-8)."""
        out = np.zeros(len(texts), np.int64)
        parts: list[bytes] = []
        owner: list[int] = []
        for k, text in enumerate(texts):
            if any(s in text for s in self.special):
                segments, out[k] = self._segments(text)
            else:
                segments = [text]
            for s in segments:
                if len(s) > 2 * BLOCK:
                    out[k] += self._long(s)
                else:
                    parts.append(s)
                    owner.append(k)
        if parts:
            ends = np.cumsum([len(p) for p in parts])
            data = b"".join(parts)
            begin, stop = self._pieces(data, ends)
            counts = self.counter.count(np.frombuffer(data, np.uint8), begin, stop - begin)
            of = np.asarray(owner)[np.searchsorted(ends, begin, "right")] if len(begin) else np.zeros(0, np.int64)
            np.add.at(out, of, counts)
        return out


@functools.lru_cache(maxsize=2)
def code_point_classes(path: str) -> bytes:
    """The runs of code points with equal classes, as the library of the file splits
    them (compressed). Code points beyond the third plane are no letters in any version of Unicode."""
    from tokenizers import Tokenizer

    splitter = Tokenizer.from_file(path).pre_tokenizer
    points = [c for c in range(0x40000) if not 0xD800 <= c < 0xE000]

    def joins(letter: str) -> np.ndarray:
        """Code points without a class that form one piece with the letter before them."""
        left = [c for c in points if kinds[c] == WHITE]
        text = "".join(f"{letter}{chr(c)}\n" for c in left)
        return np.array([left[a // 3] for _, (a, b) in splitter.pre_tokenize_str(text) if a % 3 == 0 and b - a >= 2], int)

    kinds = np.full(0x110000, WHITE, np.int32)
    kinds[0x40000:] = kinds[0xD800:0xE000] = OTHER
    for letter, kind in (("x", LETTER), ("1", NUMBER), (".", OTHER)):
        kinds[joins(letter)] = kind
    for signs, kind in ((" ", BLANK), ("'", QUOTE), ("stmd", ONE), ("r", R), ("v", V), ("e", E), ("l", L)):
        kinds[[ord(c) for c in signs]] = kind
    starts = np.flatnonzero(np.diff(kinds, prepend=-1)).astype(np.int32)
    return zlib.compress(np.concatenate([starts, kinds[starts]]).tobytes())


_made: dict[int, CompiledTokenizer] = {}


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, text_column: str = "text") -> DataFrame:
    """docs and n_bytes, n_tokens and over_limit of its texts, by the byte-level BPE
    file ``vocabulary``, which the driver reads."""
    with open(vocabulary, "rb") as f:
        payload = f.read()
    classes = code_point_classes(vocabulary)
    key = zlib.crc32(payload)
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(payload, 1))
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]

    def make(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        tokenizer = _made.get(key)  # one for all tasks of a worker
        if tokenizer is None:
            _made.clear()
            tokenizer = _made[key] = CompiledTokenizer(zlib.decompress(shared.value), classes)
        column = batch.column(batch.schema.get_field_index(text_column)).cast(pa.large_binary()).fill_null(b"")
        first, held = 0, 0
        sizes = [len(x.as_buffer()) for x in column]
        for k, n in enumerate([*sizes, 0]):
            held += n
            if k == len(sizes) or held > BLOCK:
                last = min(k + 1, len(sizes))
                if last > first:
                    n_bytes = np.array(sizes[first:last], np.int64)
                    counts = tokenizer.count([valid(x) for x in column.slice(first, last - first).to_pylist()])
                    yield batch.slice(first, last - first), [pa.array(n_bytes), pa.array(counts), pa.array(counts > limit)]
                first, held = last, 0

    return with_arrow_columns(docs, fields, make)


def valid(text: bytes) -> bytes:
    """Valid UTF-8: bytes that are none become replacement characters."""
    try:
        text.decode("utf-8")
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode("utf-8")
    return text
