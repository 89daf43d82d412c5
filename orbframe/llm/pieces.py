"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is one run of characters behind an added space; spaces are the mark U+2581. It is
cut wherever no piece of the vocabulary holds the two characters side by side, since no
merge can reach over such a place. The distinct segments of a chunk are one flat array of
symbols. In each round the segment's least pair rank is found (a segmented minimum), its
places are merged from the left, all segments at once, and the array is compacted, until
no pair is left. Where a piece of the same or a lower rank can grow out of a merge, only
the segment's leftmost place is merged in that round, because the library would go on
there first. Characters without a piece become the pieces of their bytes.

Segments of more than ``LONG`` characters (a run of blanks, say) would need a round for
each of their merges; they are merged from a heap in the same order, with equal results.

A null text counts as empty and has no tokens. Rows, also equal ones and those without a
doc_id, are answered one by one. A text is looked at whole, however long. An empty table
gives no rows. Other columns are left out of the result.
"""

import hashlib
import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orbframe.llm import text as T
from orbframe.llm.bpe import distinct, joined, raw_file

#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MARK = 0x2581
#: Longer segments are merged from a heap.
LONG = 256
#: Segments that a worker remembers.
REMEMBERED = 250_000
NONE = np.int64(1 << 40)


def fields(message: bytes):
    """``number, value`` of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        field, kind = divmod(number(), 8)
        if kind == 0:
            yield field, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield field, message[at : at + size]
        at += size


class Model:
    """What the model file says, as tables; files that ask for more than this module does are refused."""

    def __init__(self, raw: bytes):
        texts, scores, kinds = [], [], []
        for field, value in fields(raw):
            if field == 1:
                piece = dict(fields(value))
                texts.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                training = dict(fields(value))
                if training.get(3) != 2 or not training.get(35):
                    raise ValueError("only merged pairs (BPE) with a byte fallback are known")
            elif field == 3:
                rule = dict(fields(value))
                if rule.get(2) or not rule.get(3, 1) or rule.get(4, 1) or not rule.get(5, 1):
                    raise ValueError("only texts as they are, with a space in front, are known")
        if set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("unused pieces and those of users are not known")
        self.size = len(texts)
        self.byte_id = np.zeros(256, np.int64)
        plain = {}
        shown = [b""] * self.size
        for i, (text, kind) in enumerate(zip(texts, kinds)):
            if kind == BYTE:
                self.byte_id[int(text[1:-1], 16)] = i
                shown[i] = bytes([int(text[1:-1], 16)])
            elif kind == NORMAL:
                plain.setdefault(text, i)
                shown[i] = text.replace(chr(MARK), " ").encode()
        self.shown = pa.array(shown, pa.large_binary())
        self.decimal = pa.array([b"%d," % i for i in range(self.size)], pa.large_binary())
        self._characters(plain)
        self._pairs(plain, scores)
        self.forget()

    def _characters(self, plain: dict[str, int]) -> None:
        """Symbols of characters (without a piece: above all ids), and which two can stand in a piece."""
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.size
        for text, i in plain.items():
            if len(text) == 1:
                self.symbol[ord(text)] = i
        self.symbol[0x20] = self.symbol[MARK]
        beside = {(a, b) for text in plain for a, b in zip(text, text[1:])}
        known = sorted({c for pair in beside for c in pair})
        self.place = np.zeros(0x110000, np.int32)
        self.place[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        self.place[0x20] = self.place[MARK]
        self.width = len(known) + 1
        self.meet = np.zeros(self.width * self.width, bool)
        for a, b in beside:
            self.meet[self.place[ord(a)] * self.width + self.place[ord(b)]] = True

    def _pairs(self, plain: dict[str, int], scores: list[float]) -> None:
        """All pairs of symbols that make a piece, with the piece and its rank (the best score first)."""
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in plain.values()}, reverse=True))}
        rank = {text: order[scores[i]] for text, i in plain.items()}
        one = lambda t: plain.get(t, self.size + ord(t) if len(t) == 1 else None)
        found, ends = [], []
        for text, made in plain.items():
            for j in range(1, len(text)):
                a, b = one(text[:j]), one(text[j:])
                if a is not None and b is not None:
                    found.append((a * NONE + b, rank[text], made))
                    ends += [(end, rank[text]) for end in (text[:j], text[j:]) if len(end) > 1]
        found.sort()
        self.keys, self.ranks, self.made = (np.array([f[k] for f in found], np.int64) for k in range(3))
        #: pieces out of which another one of the same or a lower rank can grow
        self.eager = np.zeros(self.size, bool)
        self.eager[[plain[end] for end, above in ends if above <= rank[end]]] = True
        self.pair = {key: (r, m) for key, r, m in found}

    def segments(self, code, fresh):
        """Numbers of the characters that begin a segment; ``fresh`` are those that begin a row."""
        place = self.place[code]
        begin = np.ones(len(code), bool)
        begin[1:] = ~self.meet[place[:-1].astype(np.int64) * self.width + place[1:]]
        begin[fresh] = True
        return np.flatnonzero(begin)

    def merged(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments end to end, and their offsets."""
        code = [np.frombuffer(s.decode().encode("utf-32-le"), np.uint32) for s in segments]
        size = np.array([len(c) for c in code], np.int64)
        done = [(np.full(len(ids), i), ids) for i in np.flatnonzero(size > LONG).tolist() for ids in [self._one_by_one(self.symbol[code[i]].tolist())]]
        short = np.flatnonzero(size <= LONG)
        symbols = self.symbol[np.concatenate([np.zeros(0, np.uint32), *(code[i] for i in short.tolist())])]
        owner = np.repeat(short, size[short])
        while len(symbols):
            at = self._found(symbols[:-1], symbols[1:])
            rank = np.where(at >= 0, self.ranks[at], NONE)
            rank[owner[1:] != owner[:-1]] = NONE
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            length = np.diff(np.r_[first, len(owner)])
            best = np.minimum.reduceat(np.r_[rank, NONE], first)
            ready = np.repeat(best == NONE, length)
            done.append((owner[ready], symbols[ready]))
            hit = np.flatnonzero((rank == np.repeat(best, length)[:-1]) & (rank < NONE))
            hit = self._leftmost(hit, owner, self.made[at[hit]])
            symbols[hit] = self.made[at[hit]]
            ready[hit + 1] = True
            symbols, owner = symbols[~ready], owner[~ready]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(segments) + 1, np.int64)
        owner, symbols = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(owner, kind="stable")
        return self._in_bytes(owner[order], symbols[order], len(segments))

    def _found(self, a, b):
        """Place of each pair in the table, -1 if it makes no piece."""
        key = a * NONE + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def _leftmost(self, hit, owner, made):
        """Of the places to merge, those of this round: no two share a symbol, and of eager ones the segment's first alone."""
        if not len(hit):
            return hit
        new_run = np.r_[True, np.diff(hit) > 1]
        at = np.arange(len(hit))
        odd = (at - np.maximum.accumulate(np.where(new_run, at, 0))) % 2
        whose = owner[hit]
        begins = np.r_[True, whose[1:] != whose[:-1]]
        wild = np.logical_or.reduceat(self.eager[made], np.flatnonzero(begins))[np.cumsum(begins) - 1]
        return hit[np.where(wild, begins, odd == 0)]

    def _one_by_one(self, ids: list[int]) -> np.ndarray:
        n, wide = len(ids), int(NONE)
        before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
        heap = [(p[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := self.pair.get(ids[i] * wide + ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.pair[a * wide + b][1], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (made := self.pair.get(ids[p] * wide + ids[q])):
                    heapq.heappush(heap, (made[0], p, ids[p], ids[q]))
        return np.array([x for x in ids if x >= 0], np.int64)

    def _in_bytes(self, owner, symbols, n: int):
        """Symbols without a piece as the pieces of their bytes."""
        code = symbols - self.size
        bare = code >= 0
        if bare.any():
            width = np.where(bare, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
            ends = np.cumsum(width)
            raw = np.frombuffer(code[bare].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            owner, symbols, inside = np.repeat(owner, width), np.repeat(symbols, width), np.repeat(bare, width)
            symbols[inside] = self.byte_id[raw]
            assert len(symbols) == ends[-1]
        return symbols, np.r_[0, np.cumsum(np.bincount(owner, minlength=n))]

    def slots(self, segments: list[bytes]) -> np.ndarray:
        """Places in ``start``, ``length`` of the segments' ids in ``pool``: a memory of bounded size."""
        at = np.fromiter((self.known.get(s, -1) for s in segments), np.int64, len(segments))
        new = np.flatnonzero(at < 0)
        if len(new) and len(new) + len(self.known) > REMEMBERED:
            self.forget()
            new = np.arange(len(segments))
        if len(new):
            some = [segments[i] for i in new.tolist()]
            ids, ends = self.merged(some)
            at[new] = len(self.start) + np.arange(len(new))
            self.known.update(zip(some, at[new].tolist()))
            self.start, self.length = np.r_[self.start, len(self.pool) + ends[:-1]], np.r_[self.length, np.diff(ends)]
            self.pool = np.r_[self.pool, ids.astype(np.int32)]
        return at

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.start, self.length, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)


def with_space(data, at):
    """The rows with a space before each that isn't empty, and their offsets."""
    full = np.diff(at) > 0
    return np.insert(data, at[:-1][full], 0x20), at + np.r_[0, np.cumsum(full)]


def encode(data, at, model: Model):
    """Ids of all rows end to end, and each row's offsets in them."""
    data, at = with_space(data, at)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    code = data if len(lead) == len(data) else np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begin = model.segments(code, np.searchsorted(lead, at[:-1][np.diff(at) > 0]))
    offsets = np.r_[lead[begin], len(data)]
    which, words = distinct(data, offsets)
    slot = model.slots(words.to_pylist())[which]
    n = model.length[slot]
    ends = np.cumsum(n)
    ids = model.pool[np.repeat(model.start[slot] - ends + n, n) + np.arange(ends[-1])]
    return ids, np.r_[0, ends][np.searchsorted(offsets, at)]


def decoded(model: Model, ids, at):
    """Bytes of each row's text end to end, without the space in front, as a buffer and places from, to.

    A row that doesn't begin with the mark (ids of another source) loses nothing.
    """
    data, ends = joined(model.shown, ids, at)
    begin = ends[:-1].copy()
    full = ends[1:] > begin
    begin[full] += data[begin[full]] == 0x20
    return data, begin, ends[1:]


_state: dict = {}


def model_of(raw: bytes) -> Model:
    """The worker's copy."""
    key = zlib.crc32(raw)
    if _state.get("key") != key:
        _state.update(key=key, model=Model(raw))
    return _state["model"]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` (text from the ids) for each row of ``docs``."""
    return _answers(docs, path, "doc_id long, ids array<int>, decoded string", _full)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` without moving ids out of the task."""
    return _answers(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digest)


def _answers(docs, path, schema, form):
    raw = docs.sparkSession.sparkContext.broadcast(raw_file(path))

    def run(batches):
        model = model_of(raw.value)
        for batch in batches:
            for first, last, data, at in T.chunks(batch.column(1)):
                yield form(batch.column(0)[first:last], model, *encode(data, at, model))

    return T.plain(docs).mapInArrow(run, schema)


def _full(doc_id, model, ids, at):
    data, begin, end = decoded(model, ids, at)
    texts = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(begin.tolist(), end.tolist())]
    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
    return pa.RecordBatch.from_arrays([doc_id, lists, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])


def _digest(doc_id, model, ids, at):
    data, ends = joined(model.decimal, ids, at)
    raw = memoryview(np.ascontiguousarray(data))
    listed = [hashlib.sha256(raw[s : max(s, e - 1)]).hexdigest() for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
    data, begin, end = decoded(model, ids, at)
    raw = memoryview(np.ascontiguousarray(data))
    # ids of a whole text are whole characters, so its bytes are the text's
    texts = [hashlib.sha256(raw[s:e]).hexdigest() for s, e in zip(begin.tolist(), end.tolist())]
    return pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(at)), pa.array(listed), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
