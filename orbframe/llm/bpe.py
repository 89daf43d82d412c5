"""Byte-pair encoding by a minimal acyclic transducer, and decoding.

Frequent pre-tokens, counted over all documents, are compiled into an automaton
in which equal suffixes are one state. Its edges carry numbers that add up to a
word's place in the list of ids. Workers map the compiled file into memory.
Words that the automaton doesn't know are merged pair by pair, exactly.

A null text counts as empty and has no tokens. Rows, also equal ones, are
answered one by one; other columns are left out of the result.
"""

import hashlib
import heapq
import json
import os
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbframe.llm import text as T
from orbframe.session import cut

#: Fixed values of the pattern that splits texts: letters, what follows an apostrophe.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")
BREAK, LETTER, NUMBER, OTHER, BLANK, SPACE = 0, 1, 2, 3, 4, 5
#: Entries that a worker remembers of words it has merged.
REMEMBERED = 250_000
LONG_WORD = 200
NONE, HASH, TABLE_BITS = np.int64(1 << 40), np.uint64(0xD6E8FEB86659FD93), 19


def _hash_table(keys):
    """Keys by their hash, each at most ``probes`` places behind it."""
    table, place, probes = np.full((1 << TABLE_BITS) + 64, -1, np.int64), np.zeros((1 << TABLE_BITS) + 64, np.int64), 1
    for rank, (slot, key) in enumerate(zip((keys.astype(np.uint64) * HASH >> np.uint64(64 - TABLE_BITS)).tolist(), keys.tolist())):
        i = slot
        while table[i] >= 0:
            i += 1
        table[i], place[i] = key, rank
        probes = max(probes, i - slot + 1)
    return table, place, probes


class Vocabulary:
    """What the tokenizer file says: byte symbols, merges, special strings."""

    def __init__(self, raw: bytes):
        file = json.loads(raw)
        ids, model = file["model"]["vocab"], file["model"]
        to_byte = byte_alphabet()
        self.size = 1 + max([*ids.values(), *(t["id"] for t in file["added_tokens"])])
        self.special = {t["content"].encode(): t["id"] for t in file["added_tokens"]}
        pieces = [b""] * self.size
        for token, i in ids.items():
            pieces[i] = bytes(to_byte[c] for c in token)
        for content, i in self.special.items():
            pieces[i] = content
        self.pieces = pa.array(pieces, pa.large_binary())
        self.decimal = pa.array([b"%d," % i for i in range(self.size)], pa.large_binary())
        self.byte_id = np.zeros(256, np.int64)
        for c, b in to_byte.items():
            self.byte_id[b] = ids[c]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.made = made
        self.table, self.place, self.probes = _hash_table(keys)
        self.rank_of = dict(zip(keys.tolist(), zip(range(len(keys)), made.tolist())))
        self.forget()

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and their offsets.

        In each round every word merges all places of its pair of lowest rank; a
        pair that holds a new symbol has a higher rank than the one that made it.
        """
        size = np.array([len(w) for w in words], np.int64)
        long = np.flatnonzero(size > LONG_WORD).tolist()
        symbols = self.byte_id[np.frombuffer(b"".join(w for w in words if len(w) <= LONG_WORD), np.uint8)]
        owner = np.repeat(np.arange(len(words)), np.where(size > LONG_WORD, 0, size))
        none, done = NONE, []
        for i in long:
            ids = self._merged_long(words[i])
            done.append((np.full(len(ids), i), ids))
        while len(symbols):
            key = symbols[:-1] * self.size + symbols[1:]
            rank = self.ranks(key)
            rank[owner[:-1] != owner[1:]] = none
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(np.r_[rank, none], first)
            per = np.repeat(best, np.diff(np.r_[first, len(owner)]))
            idle = per == none
            done.append((owner[idle], symbols[idle]))
            hit = _first_of_pairs((rank == per[:-1]) & (rank < none))
            new = symbols.copy()
            new[:-1][hit] = self.made[rank[hit]]
            keep = ~idle
            keep[1:] &= ~hit
            symbols, owner = new[keep], owner[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        owner, symbols = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        return symbols[np.argsort(owner, kind="stable")], np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))]

    def ranks(self, key: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, NONE for those that never merge."""
        slot = (key.astype(np.uint64) * HASH >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        found = self.table[slot]
        out = np.where(found == key, self.place[slot], NONE)
        left = np.flatnonzero((found != key) & (found >= 0))
        for i in range(1, self.probes):
            at = slot[left] + i
            same = self.table[at] == key[left]
            out[left[same]] = self.place[at[same]]
            left = left[~same]
        return out

    def _merged_long(self, word: bytes) -> np.ndarray:
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank_of.get(ids[i] * self.size + ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.rank_of[a * self.size + b][1], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (r := self.rank_of.get(ids[p] * self.size + ids[q])):
                    heapq.heappush(heap, (r[0], p, ids[p], ids[q]))
        return np.array([x for x in ids if x >= 0], np.int64)

    def slots(self, words: list[bytes]) -> np.ndarray:
        """Places in ``start``, ``length`` of the words' ids in ``pool``: a memory of bounded size."""
        at = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        if len(new := np.flatnonzero(at < 0)) + len(self.known) > REMEMBERED:
            self.forget()
            new = np.arange(len(words))
        if len(new):
            some = [words[i] for i in new.tolist()]
            ids, ends = self.merged(some)
            at[new] = slots = len(self.start) + np.arange(len(new))
            self.known.update(zip(some, slots.tolist()))
            self.start, self.length = np.r_[self.start, len(self.pool) + ends[:-1]], np.r_[self.length, np.diff(ends)]
            self.pool = np.r_[self.pool, ids.astype(np.int32)]
        return at

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.start, self.length, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)


def _first_of_pairs(hit):
    """Of neighbouring places, the first, third, fifth ...: a merge uses up the next place."""
    if not len(hit):
        return hit
    i = np.arange(len(hit))
    gap = np.maximum.accumulate(np.where(~hit, i, -1))
    return hit & ((i - gap) % 2 == 1)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the tokenizer's file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _classes():
    """Class of every code point, by the properties that the pattern names."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", BLANK)):
        for m in regex.finditer(pattern, every):
            table[np.frombuffer(m[0].encode("utf-32-le"), np.uint32)] = kind
    table[0x20] = SPACE
    return table


_state: dict = {}


def pretokens(data, at, special: dict[bytes, int]):
    """Byte offsets of pre-tokens (with the end), and which of them are special strings.

    They tile the rows; no pre-token reaches over a row's end.
    """
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(0, bool)
    if "classes" not in _state:
        _state["classes"] = _classes()
    raw = data.tobytes()
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    code = data if len(lead) == len(data) else np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = _state["classes"][code]
    n = len(code)
    new = np.zeros(n + 1, bool)
    edges = [np.searchsorted(lead, at)]
    found = []
    for content in special:
        i = raw.find(content)
        while i >= 0:
            if np.searchsorted(at, i, "right") == np.searchsorted(at, i + len(content), "left"):
                found.append((i, i + len(content)))
                i += len(content) - 1
            i = raw.find(content, i + 1)
    found = np.searchsorted(lead, np.array(found, np.int64).reshape(-1, 2))
    for e in (*edges, found.ravel()):
        new[e] = True
    blank = kind >= BLANK
    after_blank = np.r_[False, blank[:-1]] & ~new[:-1]
    before_text = np.r_[~blank[1:], False] & ~new[1:]
    changed = np.r_[True, kind[1:] != kind[:-1]] | new[:-1]
    spaced = np.r_[False, kind[:-1] == SPACE] & ~new[:-1]
    begin = np.where(blank, ~after_blank | before_text, changed & ~spaced)
    begin |= new[:-1]
    quote = np.flatnonzero((code == 0x27) & begin)
    if len(quote):
        padded, fresh = np.r_[code, 0, 0, 0].astype(np.uint32), np.r_[new, True, True]
        one, two = padded[quote + 1], padded[quote + 2]
        near = ~fresh[quote + 1]
        is_one = near & np.isin(one, [ord(c) for c in ONE_LETTER])
        is_two = near & ~fresh[np.minimum(quote + 2, len(fresh) - 1)] & np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in TWO_LETTERS])
        for which, size in ((is_one, 1), (is_two, 2)):
            begin[quote[which] + 1] = False
            rest = quote[which] + 1 + size
            rest = rest[rest < n]
            begin[rest[kind[rest] < BLANK]] = True
    for s, e in found:
        begin[s + 1 : e] = False
    first = np.flatnonzero(begin)
    flags = np.zeros(len(first), bool)
    flags[np.searchsorted(first, found[:, 0])] = True
    return np.r_[lead[first], len(data)], flags


def distinct(data, offsets):
    """Place of each pre-token in the list of distinct ones, and that list."""
    # a pre-token over a row's end can't occur, so the bytes are one column
    column = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


# --- the transducer -----------------------------------------------------------


def compile_lexicon(words: list[bytes], ids: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted ``words``; numbers on edges add up to a word's place.

    Built as usual for sorted input: what has been left for good is looked up in a
    register of states with equal futures, so suffixes are shared.
    """
    register: dict[tuple, int] = {}
    edges: list[tuple] = []  # by state: ((byte, target), ...)
    final: list[bool] = []
    path: list[list] = [[False, []]]  # open states: final, [(byte, state)]

    def close(down_to: int) -> None:
        while len(path) - 1 > down_to:
            end, out = path.pop()
            key = (end, tuple(out))
            if key not in register:
                register[key] = len(edges)
                edges.append(key[1])
                final.append(end)
            byte, _ = path[-1][1][-1]
            path[-1][1][-1] = (byte, register[key])

    last = b""
    for w in words:
        same = os.path.commonprefix([last, w])
        close(len(same))
        for b in w[len(same) :]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        last = w
    close(0)
    edges.append(tuple(path[0][1]))
    final.append(path[0][0])
    count = [0] * len(edges)  # words below; targets come before their sources
    key, target, number = [], [], []
    for s, out in enumerate(edges):
        n = int(final[s])
        for b, t in out:
            key.append(s * 256 + b)
            target.append(t)
            number.append(n)
            n += count[t]
        count[s] = n
    return {
        "key": np.array(key, np.int64), "target": np.array(target, np.int64), "number": np.array(number, np.int64),
        "final": np.array(final, np.int64), "offsets": offsets.astype(np.int64), "ids": ids.astype(np.int64),
    }


PARTS = ("key", "target", "number", "final", "offsets", "ids")


def write_lexicon(parts: dict[str, np.ndarray], path: str) -> None:
    with open(path, "wb") as f:
        f.write(np.array([len(parts[p]) for p in PARTS], np.int64).tobytes())
        for p in PARTS:
            f.write(parts[p].tobytes())


def open_lexicon(path: str) -> dict[str, np.ndarray]:
    whole = np.memmap(path, np.int64, "r")
    at, out = len(PARTS), {}
    for p, n in zip(PARTS, whole[: len(PARTS)].tolist()):
        out[p] = whole[at : at + n]
        at += n
    return out


def walk(lexicon: dict[str, np.ndarray], words: pa.Array) -> np.ndarray:
    """The place of each word in the lexicon, -1 if it isn't there; all words step together."""
    data, at = T.flat(words)
    size, n = np.diff(at), len(words)
    state = np.full(n, len(lexicon["final"]) - 1, np.int64)
    place = np.zeros(n, np.int64)
    alive, depth, key = np.flatnonzero(size >= 0), 0, lexicon["key"]
    gone = np.zeros(n, bool)
    while len(alive := alive[size[alive] > depth]):
        want = state[alive] * 256 + data[at[alive] + depth]
        i = np.minimum(np.searchsorted(key, want), max(0, len(key) - 1))
        ok = key[i] == want if len(key) else np.zeros(len(alive), bool)
        gone[alive[~ok]] = True
        alive, i = alive[ok], i[ok]
        state[alive] = lexicon["target"][i]
        place[alive] += lexicon["number"][i]
        depth += 1
    return np.where(gone | (lexicon["final"][state] == 0), -1, place)


# --- encoding in a task -------------------------------------------------------


def vocabulary(raw: bytes) -> Vocabulary:
    """The worker's copy."""
    key = zlib.crc32(raw)
    if _state.get("key") != key:
        _state.update(key=key, vocabulary=Vocabulary(raw))
    return _state["vocabulary"]


def encode(data, at, v: Vocabulary, lexicon=None):
    """Ids of all rows end to end, and each row's offsets in them."""
    offsets, special = pretokens(data, at, v.special)
    if len(offsets) == 1:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    which, words = distinct(data, offsets)
    start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    place = walk(lexicon, words) if lexicon is not None else np.full(len(words), -1)
    missing, seen = np.flatnonzero(place < 0), np.flatnonzero(place >= 0)
    at_slots = v.slots((words.take(pa.array(missing)) if len(seen) else words).to_pylist())
    start[missing], size[missing], parts = v.start[at_slots], v.length[at_slots], [v.pool]
    if len(seen):
        start[seen] = len(v.pool) + lexicon["offsets"][place[seen]]
        size[seen] = lexicon["offsets"][place[seen] + 1] - lexicon["offsets"][place[seen]]
        parts.append(lexicon["ids"])
    if special.any():
        names = [data[offsets[i] : offsets[i + 1]].tobytes() for i in np.flatnonzero(special)]
        which = which.astype(np.int64)
        which[special] = len(words) + np.arange(len(names))
        start = np.r_[start, sum(map(len, parts)) + np.arange(len(names))]
        size = np.r_[size, np.ones(len(names), np.int64)]
        parts.append(np.array([v.special[x] for x in names], np.int64))
    pool = np.concatenate(parts) if len(parts) > 1 else v.pool
    n = size[which]
    ends = np.cumsum(n)
    ids = pool[np.repeat(start[which] - ends + n, n) + np.arange(ends[-1])]
    return ids, np.r_[0, ends][np.searchsorted(offsets, at)]


def joined(pieces: pa.Array, ids, at):
    """The pieces of each row's ids end to end, as buffer and offsets."""
    taken = pc.take(pieces, pa.array(ids))
    data, offsets = T.flat(taken)
    return data, offsets[at]


# --- operators ----------------------------------------------------------------


def raw_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def frequent(docs: DataFrame, path: str, size: int) -> list[bytes]:
    """The most frequent pre-tokens of all documents: those with a count of ``2**b`` or more,
    for the least b that leaves at most ``size``."""
    raw = docs.sparkSession.sparkContext.broadcast(raw_file(path))

    def count(batches):
        special, held = vocabulary(raw.value).special, None
        for batch in batches:
            for _, _, data, at in T.chunks(batch.column(0), 2 * T.CHUNK):
                offsets, flags = pretokens(data, at, special)
                if len(offsets) == 1:
                    continue
                which, words = distinct(data, offsets)
                n = np.bincount(which[~flags], minlength=len(words))
                some = pa.table({"word": words, "n": n}).filter(pa.array(n > 0))
                held = some if held is None else pa.concat_tables([held, some]).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
                if held.num_rows > REMEMBERED:
                    yield from held.combine_chunks().to_batches()
                    held = None
        if held is not None:
            yield from held.combine_chunks().to_batches()

    counts = cut(T.plain(docs).select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    by_size = {r.b: r.words for r in counts.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count("*").alias("words")).collect()}
    least, left = 63, size
    while least > 0 and (left := left - by_size.get(least - 1, 0)) >= 0:
        least -= 1
    return sorted(bytes(r.word) for r in counts.where(F.col("n") >= F.lit(1 << least).cast("long")).collect())


def lexicon_of(docs: DataFrame, path: str, size: int) -> str:
    """Compile the frequent words of ``docs`` and hand the file to all workers; its name."""
    words = frequent(docs, path, size)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    file = os.path.join(tempfile.mkdtemp(), name)
    write_lexicon(compile_lexicon(words, *Vocabulary(raw_file(path)).merged(words)), file)
    docs.sparkSession.sparkContext.addFile(file)
    return name


def encoded(docs: DataFrame, path: str, words: int = 65_536) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` (text from the ids) for each row of ``docs``.

    ``words`` bounds the lexicon, a file of a few MB; results don't depend on it.
    """
    return _answers(docs, path, words, "doc_id long, ids array<int>, decoded string", _full)


def digests(docs: DataFrame, path: str, words: int = 65_536) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` without moving ids out of the task."""
    return _answers(docs, path, words, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digest)


def _answers(docs, path, words, schema, form):
    raw = docs.sparkSession.sparkContext.broadcast(raw_file(path))
    name = lexicon_of(docs, path, words)

    def run(batches):
        v = vocabulary(raw.value)
        if _state.get("lexicon") != name:
            _state.update(lexicon=name, opened=open_lexicon(SparkFiles.get(name)))
        for batch in batches:
            for first, last, data, at in T.chunks(batch.column(1)):
                ids, offsets = encode(data, at, v, _state["opened"])
                yield form(batch.column(0)[first:last], v, ids, offsets)

    return T.plain(docs).mapInArrow(run, schema)


def _full(doc_id, v, ids, at):
    data, ends = joined(v.pieces, ids, at)
    decoded = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(ends[:-1], ends[1:])]
    return pa.RecordBatch.from_arrays([doc_id, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])


def _digest(doc_id, v, ids, at):
    data, ends = joined(v.decimal, ids, at)
    raw = memoryview(np.ascontiguousarray(data))
    listed = [hashlib.sha256(raw[s : max(s, e - 1)]).hexdigest() for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
    data, ends = joined(v.pieces, ids, at)
    raw = memoryview(np.ascontiguousarray(data))
    # a row's pieces are whole UTF-8 unless ids were cut; then decoding replaces what is broken
    text = [hashlib.sha256(bytes(raw[s:e]).decode("utf-8", "replace").encode()).hexdigest() for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(at)), pa.array(listed), pa.array(text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
