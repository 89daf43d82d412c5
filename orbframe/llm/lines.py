"""Fuzzy line dedup: SimHash over classes of words, pigeonhole blocks, edit similarity.

A line is normalised (lower case, digits as 0, other marks as one space). Its tokens are
its words; characters from U+0E00 up, whose scripts don't space words, are tokens each.
A token's hash puts it into one of some classes, and each block of the line's SimHash sees
the tokens of one class alone, each once. A changed word is one token less and one more, so it touches
two blocks at most, and by the pigeonhole principle the others are equal. What is joined on:

- from 84 tokens, each of 16 blocks: up to 7 changed words leave two blocks as they were;
- from 40 to 94 tokens, each of 8 blocks: up to 3 changed words leave two;
- from 8 to 45 tokens, each two of 6 blocks together: up to 2 changed words leave two blocks;
- up to 9 tokens, the SimHash of the whole line, and of all its tokens but one, for each.

More changes are found as long as one of these stays by chance. Ranges overlap, so lines
of a few words more or less have a kind of key in common. A key holds four tokens at least
(three in lines of up to 21 tokens, two in those of up to 15, if the line has them), so lines of one or two tokens meet
only if they are equal but for order.

Each key comes with the SimHash of the line's neighbouring tokens (57 bits) and the class of
its length. Lines that differ in more than 21 bits (from about 135 characters on, 18) or by more than
two classes (a class is a quarter longer than the one before) are no candidates, if they have more than 9 tokens;
lines with two changed words of twelve differ in 16 bits, with a deviation of 3.5, and less
if a smaller share has changed.

Under a key all lines are held against the one
of the smallest hash; keys that then still hold several components compare across these,
large ones by length (twice, so that lengths within 0.8 stay together). A few common words are a key of
many lines that have nothing else in common, so across components only lines whose characters allow it are
a pair: an edit adds one character and takes one at most, so a link lacks no more of either line's characters than
its edits. Characters are counted by kind up to a limit, which only makes lines more alike; no link is lost. Lines are linked
if their edit similarity, one minus the edit distance over the longer length, is 0.8 or
more. Equal normalised lines are one node. Of each connected group the occurrence with the
smallest doc_id and line number stays.

Texts don't travel: a second pass over the documents picks the lines that share a key, by a
bitmap of fixed size.

Every line takes part that isn't blank, whatever its script. A line of marks alone is
one node with lines of the same marks. Rows without doc_id have no lines here and stay.
A null text has no lines. Rows that repeat a doc_id with other texts have lines each;
those with the same text share their lines' fate. A text without breaks is one line; the
edit distance of two lines of n characters that really differ takes n * n / 64 steps.
An empty table gives no rows. ``deduplicated`` keeps all columns, whatever their names.
"""

import itertools
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbframe.llm import text as T
from orbframe.llm.graph import components
from orbframe.session import cut

#: Classes of tokens, how many of them a key joins, and tokens of the lines (from, to) that have such keys.
KINDS = ((16, 1, 84, 1 << 40), (8, 1, 40, 94), (6, 2, 8, 45))
#: Tokens of a key, at least (three in lines of fewer than MANY tokens, two in those of fewer than FEW).
LEAST, FEW, MANY = 4, 16, 22
#: Tokens, at most, of lines with keys that leave out a token each.
SHORT = 9
#: Keys with more lines are divided by length before lines are compared across components.
LARGE = 16
#: Bits that the SimHashes of candidates differ in, at most (short lines, long ones); and the lowest bits of a sketch: class of length, mark of short lines.
APART, LENGTH, IS_SHORT, LOW = (21, 18), 63, 64, 7
#: Class of the length from which lines may differ in fewer bits.
LONGER = 22
#: Kinds of characters that are counted, and how far.
CHARACTERS, COUNTED = 32, 8
#: Pairs of lines, and bytes of them, that a task holds against each other at once.
PAIRS, PAIR_BYTES = 16384, 1 << 24
#: Words of 64 bits in a column of the tables of edits that are worked out together, and numbers in their maps of characters. Characters from which a line is first looked at
#: for what it has in common with the other, and of lines that have a table alone.
COLUMN, MARKED, LONG, ALONE = 8192, 1 << 20, 160, 4096
#: Bits of the map of wanted lines, as a power of two.
MAP_BITS = 25
#: How bytes of ASCII are seen: letters in lower case, digits as 0, others as a space.
_SEEN = np.arange(256, dtype=np.uint8)
_SEEN[:128] = 32
_SEEN[97:123] = _SEEN[65:91] = np.arange(97, 123)
_SEEN[48:58] = 48
#: The bits of a byte as counts of a byte each.
_COUNTS = np.array([sum((i >> j & 1) << (8 * j) for j in range(8)) for i in range(256)], np.uint64)


def tokens(seen, edges):
    """Start and end of each token of lines as they are seen, and the first token of each line (and of all)."""
    if not len(seen):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(edges), np.int64)
    inside = seen != 32
    new = np.zeros(len(seen) + 5, bool)
    new[edges] = True
    after = np.r_[seen[1:], np.uint8(0)]
    own = np.flatnonzero((seen >= 0xE1) | ((seen == 0xE0) & (after >= 0xB8)))
    new[own] = new[own + 3 + (seen[own] >= 0xF0)] = True
    new = new[: len(seen) + 1]
    begin = inside & (np.r_[True, ~inside[:-1]] | new[:-1])
    end = inside & (np.r_[~inside[1:], True] | new[1:])
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, edges)


def _most(ones, count):
    """The bits that more than half of ``count`` hashes have set, from how many do."""
    return np.packbits(ones > (count // 2).astype(ones.dtype)[:, None], axis=1)


def _key(ones, count, name):
    """Keys of SimHashes, from how often each bit is set among ``count`` tokens."""
    return T.mix(_most(ones, count).view(np.uint64)[:, 0] ^ T.mix(count.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(name)))


def _counts(hashes):
    """The 64 bits of each hash as numbers of 8 bits, eight in a word."""
    return _COUNTS[hashes.view(np.uint8).reshape(-1, 8)]


def _ones(hashes, size):
    """How often each of the 64 bits is set in each run of ``size`` hashes, which are not empty."""
    # a number of 8 bits holds 255: longer runs are counted in parts
    parts = -(-size // 255)
    part = np.cumsum(parts) - parts
    begin = np.repeat(np.cumsum(size) - size, parts) + 255 * (np.arange(parts.sum()) - np.repeat(part, parts))
    ones = np.add.reduceat(_counts(hashes), begin, axis=0).view(np.uint8)
    return ones if len(ones) == len(size) else np.add.reduceat(ones, part, axis=0, dtype=np.uint16)


def _once(row, values):
    """Marks one of those tokens of a row that are equal."""
    key = T.mix(values + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    new = np.r_[True, key[order][1:] != key[order][:-1]] if len(row) else np.zeros(0, bool)
    out = np.zeros(len(row), bool)
    out[order] = new
    return out


def block_keys(seen, edges, hasher=None, wanted=None, words=None):
    """The line of each key, the keys, and each line's sketch: SimHash of all its tokens, whether they are few, class of length.

    ``hasher`` is that of the words of ``seen``, and ``words`` (starts, ends, first) are these, if there are any already. Lines that are not ``wanted`` have no keys, and no sketch that counts.
    """
    # without characters that are tokens each, tokens are words
    starts, ends, first = words if words and not (seen >= 0xE0).any() else tokens(seen, edges)
    gap = np.r_[False, starts[1:] > ends[:-1]] if len(starts) else np.zeros(0, bool)
    if wanted is not None and not wanted.all():
        keep = np.repeat(wanted, np.diff(first))
        starts, ends, gap = starts[keep], ends[keep], gap[keep]
        first = np.r_[0, np.cumsum(np.where(wanted, np.diff(first), 0))]
    h, n = (hasher or T.word_hasher(seen))(starts, ends), np.diff(first)
    row = T.rows_of(first)
    mixed = T.mix(h)
    once = _once(row, h)
    lines, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for kind, (classes, joined, least, most) in enumerate(KINDS):
        some = np.flatnonzero((n >= least) & (n <= most))
        if not len(some):
            continue
        place = np.full(len(n), -1, np.int64)
        place[some] = np.arange(len(some))
        mine = np.flatnonzero((place[row] >= 0) & once)
        group = place[row[mine]] * classes + ((h[mine] >> np.uint64(32 + 4 * kind)) % np.uint64(classes)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        held = np.bincount(group, minlength=len(some) * classes)
        full = np.flatnonzero(held)
        found = _ones(mixed[mine[order]], held[full])
        ones = np.zeros((len(held), 64), found.dtype)
        ones[full] = found
        ones, held = ones.reshape(len(some), classes, 64), held.reshape(len(some), classes)
        for which in itertools.combinations(range(classes), joined):
            count = reduce(np.add, (held[:, c] for c in which))
            good = count >= np.where(n[some] < FEW, 2, np.where(n[some] < MANY, 3, LEAST))
            lines.append(some[good])
            keys.append(_key(reduce(np.add, (ones[good, c] for c in which)), count[good], kind << 16 | sum(1 << c for c in which)))
    # neighbouring tokens, the line's two ends among them
    before = np.r_[np.uint64(0), h[:-1]] if len(h) else h
    before = np.where(np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool), np.uint64(1), before)
    pair = T.mix(T.mix(before) + h * np.uint64(0x9E3779B97F4A7C15))
    some = np.flatnonzero(n)
    bits = np.zeros(len(n), np.int64)
    if len(some):
        bits[some] = _most(_ones(pair, n[some]), n[some]).view(np.int64)[:, 0]
    # characters of the line with one space between words, as its text will have it
    chars = np.r_[0, np.cumsum((seen & 0xC0) != 0x80)]
    wide = np.bincount(row, chars[ends] - chars[starts] + gap, len(n))
    length = np.minimum(LENGTH, np.floor(np.log(np.maximum(wide, 1)) / np.log(1.25))).astype(np.int64)
    sketch = bits & ~np.int64((1 << LOW) - 1) | np.where(n <= SHORT, IS_SHORT, 0) | length
    some = np.flatnonzero((n > 0) & (n <= SHORT))
    if len(some):
        mine = np.flatnonzero((n[row] <= SHORT))
        each, count = _counts(mixed[mine]), n[some]
        whole = np.add.reduceat(each, np.r_[0, np.cumsum(count)[:-1]], axis=0)
        lines.append(some)
        keys.append(_key(whole.view(np.uint8), count, 1 << 18))
        count = np.repeat(count, count)
        good = count > 2
        lines.append(row[mine][good])
        keys.append(_key((np.repeat(whole, n[some], axis=0) - each)[good].view(np.uint8), count[good] - 1, 1 << 18))
    return np.concatenate(lines), np.concatenate(keys).view(np.int64), sketch


def spaced(data, starts, ends, words):
    """The words of each line joined by one space, end to end, and the lines' offsets."""
    last = np.zeros(len(starts), bool)
    last[words[1:][np.diff(words) > 0] - 1] = True
    size = ends - starts + ~last
    begin = np.cumsum(np.r_[0, size])
    source = np.arange(begin[-1]) + np.repeat(starts - begin[:-1], size)
    out = data[np.minimum(source, max(0, len(data) - 1))]
    out[(begin[1:] - 1)[~last]] = 32
    return out, begin[words]


def hashed(data, edges):
    """Lines as they are seen: all bytes, a hasher of words, words (starts, ends, first), and a hash of the whole line; 0 if it is blank."""
    seen = _SEEN[data]
    hasher = T.word_hasher(seen)
    starts, ends, words = T.words(seen, edges)
    whole = T.hash_spans(hasher(starts, ends), words[:-1], words[1:])
    bare = np.diff(words) == 0
    if bare.any():  # marks alone, as they are
        raw, stops, first = T.words(data, edges)
        marks = T.mix(T.hash_spans(T.word_hashes(data, raw, stops), first[:-1], first[1:]) ^ np.uint64(3))
        whole[bare] = np.where(np.diff(first) > 0, marks, np.uint64(0))[bare]
    return seen, hasher, (starts, ends, words), whole


def lines_of(batches):
    """``row, number, whole, seen, hasher, words, edges`` of the lines in each run of texts (as ``hashed``): a line's row and number in it."""
    for batch in batches:
        for first, _, data, at in T.chunks(batch.column(batch.num_columns - 1)):
            edges = np.unique(np.r_[at, np.flatnonzero(data == 10), len(data)])
            row = np.searchsorted(at, edges[:-1], "right") - 1
            # edges hold each row's start and each line break; a row that starts with a break has one edge for both
            number = np.arange(len(edges) - 1) - np.searchsorted(edges, at)[row] + (data[np.minimum(at[row], max(0, len(data) - 1))] == 10)
            seen, hasher, words, whole = hashed(data, edges)
            yield batch, first + row, number.astype(np.int32), whole, seen, hasher, words, edges


def occurrences(docs: DataFrame) -> DataFrame:
    """``doc_id, row, line_no, node, sketch, keys`` of the lines that take part; line numbers start at 0, ``row`` is the text's hash.

    Of lines that are equal a task gives one its keys, as far as it remembers.
    """

    def run(batches):
        met: set[int] = set()
        for batch, row, number, whole, seen, hasher, words, edges in lines_of(batches):
            take = np.flatnonzero(whole)
            fresh = np.zeros(len(whole), bool)
            fresh[take[_new(whole[take], met)]] = True
            line, keys, sketch = block_keys(seen, edges, hasher, fresh, words)
            order = np.argsort(line, kind="stable")
            ends = np.r_[0, np.cumsum(np.bincount(line, minlength=len(whole))[take])]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[order]))
            of = pa.array(row[take])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(1).take(of), pa.array(number[take]), pa.array(whole[take].view(np.int64)), pa.array(sketch[take]), lists],
                ["doc_id", "row", "line_no", "node", "sketch", "keys"],
            )

    docs = T.plain(docs).where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("row"), "text")
    return docs.mapInArrow(run, "doc_id long, row long, line_no int, node long, sketch long, keys array<long>")


def _new(nodes, seen: set):
    """Places of nodes that a task meets for the first time, as far as it remembers."""
    first = np.sort(np.unique(nodes, return_index=True)[1])
    fresh = first[[x not in seen for x in nodes[first].tolist()]] if len(first) else first
    if len(seen) > 200_000:
        seen.clear()
    seen.update(nodes[fresh].tolist())
    return fresh


def wanted_lines(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, line`` (normalised) of the lines of ``nodes``, read from the documents once more.

    A bitmap of ``2**MAP_BITS`` bits over the nodes' hashes goes to the tasks; what it lets through besides is dropped by the join.
    """
    place = nodes.select(F.shiftrightunsigned("node", 64 - MAP_BITS).alias("place"))
    words = place.groupBy(F.shiftright("place", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 AS int)))").alias("bits")).toArrow()
    bitmap = np.zeros(1 << MAP_BITS - 6, np.uint64)
    bitmap[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        met: set[int] = set()
        for _, _, _, whole, seen, _, (starts, ends, first), edges in lines_of(batches):
            place = (whole >> np.uint64(64 - MAP_BITS)).astype(np.int64)
            here = np.flatnonzero((shared.value[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1) == 1) & (whole != 0))
            here = here[_new(whole[here], met)]
            size = np.diff(first)[here]
            words = np.r_[0, np.cumsum(size)]
            some = np.arange(words[-1]) + np.repeat(first[here] - words[:-1], size)
            text, offsets = spaced(seen, starts[some], ends[some], words)
            lines = [text[x:y].tobytes() for x, y in itertools.pairwise(offsets.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(whole[here].view(np.int64)), pa.array(lines, pa.binary()).cast(pa.string())], ["node", "line"])

    texts = T.plain(docs).where("doc_id is not null and text is not null").select("text")
    return texts.mapInArrow(run, "node long, line string").join(nodes.hint("merge"), "node", "left_semi").dropDuplicates(["node"])


def _gathered(batches):
    """The batches of pairs as tables, several in one while they are small."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= PAIRS or size >= PAIR_BYTES:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose lines, among ``texts(node, line)``, are similar in edits."""
    texts = texts.hint("merge")
    # the other lines come to the line they are held against, whose text isn't repeated
    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("line").alias("l_b")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), F.col("line").alias("l_a")), "a")

    def run(batches):
        for some in _gathered(batches):
            keep = pa.array(near_each(some.column(2).to_pylist(), some.column(3).to_pylist(), percent))
            yield from some.select(["a", "b"]).filter(keep).to_batches()

    return both.select("a", "b", "l_a", "l_b").mapInArrow(run, "a long, b long")


def _alike(a: str, b: str):
    """Whether two sketches can be those of linked lines."""
    return F.expr(f"abs(({a} & {LENGTH}) - ({b} & {LENGTH})) <= 2 and (({a} | {b}) & {IS_SHORT} > 0 or bit_count(shiftrightunsigned({a} ^ {b}, {LOW})) <= if(least({a} & {LENGTH}, {b} & {LENGTH}) < {LONGER}, {APART[0]}, {APART[1]}))")


def counted(lines: list[str]) -> np.ndarray:
    """A row for each line: how many characters it has, and as many bits for each kind as it has such characters."""
    data = np.frombuffer("".join(lines).encode(), np.uint8)
    data = data[(data & 0xC0) != 0x80]  # a character is its first byte
    size = np.array([len(x) for x in lines], np.int64)
    kinds = np.bincount(np.repeat(np.arange(len(lines)), size) * CHARACTERS + data % CHARACTERS, minlength=len(lines) * CHARACTERS)
    bits = np.packbits(kinds.reshape(-1, CHARACTERS)[:, :, None] > np.arange(COUNTED), axis=2)
    return np.c_[size, bits.reshape(len(lines), CHARACTERS * COUNTED // 8).view(np.int64)]


def _characters(texts: DataFrame) -> DataFrame:
    """``node, marks`` (as ``counted``) of ``texts(node, line)``."""

    def run(batches):
        for batch in batches:
            marks = counted(batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(marks) + 1) * marks.shape[1], pa.int32()), pa.array(marks.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "marks"])

    return texts.select("node", "line").mapInArrow(run, "node long, marks array<long>")


def _possible(a: str, b: str, percent: int):
    """Whether lines with these marks can be linked: each lacks a character of the other for an edit at most."""
    lacks = lambda x, y: " + ".join(f"bit_count({x}[{i}] & ~{y}[{i}])" for i in range(1, 1 + CHARACTERS * COUNTED // 64))
    return F.expr(f"greatest(abs({a}[0] - {b}[0]), {lacks(a, b)}, {lacks(b, a)}) <= greatest({a}[0], {b}[0]) * {100 - percent} div 100")


def linked(made: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """``node, component`` of the links between lines of ``docs`` that share a key in ``made`` (their occurrences)."""
    # most keys are those of one line alone: they go before the others are put in order
    among = Window.partitionBy("key")
    keyed = made.select(F.explode("keys").alias("key"), "node", "sketch")
    keyed = keyed.withColumns({"low": F.min("node").over(among), "high": F.max("node").over(among)}).where("low < high").drop("low", "high")
    under = Window.partitionBy("key").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    # several tasks may have given equal lines their keys: one of them is enough
    before = F.lag("node").over(Window.partitionBy("key").orderBy("node"))
    star = keyed.withColumns({"first": F.first(F.struct("node", "sketch")).over(under), "before": before}).where("node <> first.node and node <> before")
    star = cut(star.select("key", F.col("first.node").alias("a"), F.col("first.sketch").alias("a_sketch"), F.col("node").alias("b"), "sketch"))
    tried = cut(star.where(_alike("a_sketch", "sketch")).select("a", "b").distinct())
    texts = cut(wanted_lines(docs, star.select(F.col("a").alias("node")).union(star.select("b")).distinct()))
    links = cut(confirmed(tried, texts, percent))
    group = cut(components(links))
    # keys that still hold several components: a key's first line and all others
    to = lambda end: group.select(F.col("node").alias(end), F.col("component").alias(f"{end}_c")).hint("merge")
    placed = star.join(to("b"), "b", "left").join(to("a"), "a", "left")
    placed = placed.withColumns({"a_c": F.coalesce("a_c", "a"), "b_c": F.coalesce("b_c", "b")})
    held = placed.groupBy("key").agg(F.first(F.struct(F.col("a").alias("node"), F.col("a_sketch").alias("sketch"), F.col("a_c").alias("c"))).alias("one"), F.count("*").alias("n"), F.bool_or(F.col("a_c") != F.col("b_c")).alias("open"))
    held = held.where("open")
    some = placed.join(held.select("key", "n").hint("merge"), "key").select("key", "n", F.col("b").alias("node"), "sketch", F.col("b_c").alias("c"))
    some = some.union(held.select("key", "n", "one.*"))
    parts = [F.expr(f"xxhash64(key, {i}, ((sketch & {LENGTH}) + {2 * i}) div 4)") for i in range(2)]
    some = some.select(F.explode(F.when(F.col("n") <= LARGE, F.array("key")).otherwise(F.array(*parts))).alias("key"), "node", "sketch", "c")
    # a line knows all its open keys, so that a pair is made under the smallest one it shares, and not under each
    some = some.groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("c").alias("c"), F.collect_set("key").alias("keys"))
    some = cut(some.join(_characters(texts).hint("merge"), "node")).withColumn("key", F.explode("keys"))
    # a row for each key of a line, with all of its keys and marks, which Spark sizes as one of each: never broadcast
    other = some.select("key", *(F.col(c).alias(f"b_{c}") for c in ("node", "sketch", "c", "keys", "marks")))
    across = (F.col("node") < F.col("b_node")) & (F.col("c") != F.col("b_c")) & _alike("sketch", "b_sketch") & _possible("marks", "b_marks", percent)
    here = F.array_min(F.array_intersect("keys", "b_keys")) == F.col("key")
    more = some.join(other.hint("merge"), "key").where(across & here).select(F.col("node").alias("a"), F.col("b_node").alias("b"))
    more = cut(more.join(tried.hint("merge"), ["a", "b"], "left_anti"))
    if more.isEmpty():
        return group
    return components(links.union(cut(confirmed(more, texts, percent))))


def near_each(xs: list[str], ys: list[str], percent: int) -> np.ndarray:
    """``near_in_edits`` of each pair of lines, with the tables of many pairs worked out together."""
    size = np.array([(len(x), len(y)) for x, y in zip(xs, ys)], np.int64).reshape(-1, 2)
    most = size.max(axis=1)
    allowed = most * (100 - percent) // 100
    out = most <= allowed
    some = np.flatnonzero(~out & (most - size.min(axis=1) <= allowed))
    left = []
    for i in some.tolist():
        x, y = xs[i], ys[i]
        if most[i] > ALONE:
            out[i] = near_in_edits(x, y, percent)
            continue
        if most[i] > LONG:
            x, y = _differing(x, y)
            if max(len(x), len(y)) <= allowed[i] or within_words(x, y, allowed[i]):
                out[i] = True
                continue
        left.append((x, y, i) if len(x) >= len(y) else (y, x, i))
    left.sort(key=lambda pair: len(pair[0]))
    while left:
        # the longest, as many as have a column of the size
        group = left[-max(1, COLUMN // -(-len(left[-1][0]) // 64)) :]
        del left[-len(group) :]
        x, y, i = (list(part) for part in zip(*group))
        out[i] = _within(x, y, allowed[i])
    return out


def _codes(lines: list[str]):
    """The characters of lines as numbers, end to end, with the line of each and its place there."""
    size = np.array([len(x) for x in lines], np.int64)
    row = np.repeat(np.arange(len(lines)), size)
    return np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32), row, np.arange(len(row)) - (np.cumsum(size) - size)[row]


def _within(xs: list[str], ys: list[str], allowed) -> np.ndarray:
    """Whether the edit distance of each pair is ``allowed`` at most; no line is empty, and those of ``xs`` are as long as the others at least.

    The tables are those of ``edits``. A column of all pairs is one array of words of 64 bits, of which only those are
    worked out that a path of so few edits can touch; beyond them the table is taken to rise by one a step, which is never too little.
    """
    (x, x_row, x_at), (y, y_row, y_at) = _codes(xs), _codes(ys)
    kind = np.zeros(max(x.max(), y.max()) + 1, np.int64)
    kind[x] = 1
    kinds = np.flatnonzero(kind)
    kind[kinds] = np.arange(1, len(kinds) + 1)  # 0: those that no line of xs has
    n, kinds, words = len(xs), len(kinds) + 1, int(x_at.max()) // 64 + 1
    if n > 1 and n * kinds * words > MARKED:
        half = n // 2
        return np.r_[_within(xs[:half], ys[:half], allowed[:half]), _within(xs[half:], ys[half:], allowed[half:])]
    x, y = x_row * kinds + kind[x], y_row * kinds + kind[y]
    # an edit mends one missing and one spare character at most
    spare = (np.bincount(x, minlength=n * kinds) - np.bincount(y, minlength=n * kinds)).reshape(n, kinds)
    out = np.maximum(np.maximum(spare, 0).sum(axis=1), np.maximum(-spare, 0).sum(axis=1)) <= allowed
    # the pairs that are left by the length of the line that is gone through, so that those with characters left come first
    wide, length = np.bincount(x_row, minlength=n), np.bincount(y_row, minlength=n)
    order = np.flatnonzero(out)
    order = order[np.argsort(-length[order])]
    if not len(order):
        return out
    where = np.zeros(words * n * kinds, np.uint64)
    np.bitwise_or.at(where, (x_at >> 6) * (n * kinds) + x, np.uint64(1) << (x_at & 63).astype(np.uint64))
    where = where.reshape(words, n * kinds)
    place = np.full(n, -1)
    place[order] = np.arange(len(order))
    steps = np.zeros((length[order[0]], len(order)), np.int64)
    mine = place[y_row] >= 0
    steps[y_at[mine], place[y_row[mine]]] = y[mine]
    wide, length, most = wide[order], length[order], allowed[order]
    going = len(order) - np.cumsum(np.bincount(length))
    # how far a path can be before and behind the diagonal; it ends as far behind as the lengths differ
    ahead, behind = int(((most - wide + length) // 2).max()), int(((most + wide - length) // 2).max())
    rise, fall = np.full((words, len(order)), ~np.uint64(0)), np.zeros((words, len(order)), np.uint64)
    above, low = np.zeros(len(order), np.int64), 0
    for i, (step, m) in enumerate(zip(steps, going.tolist())):
        if low < (i - ahead) // 64:
            above[:m] += _sum(rise[low, :m], fall[low, :m])
            low += 1
        high = min(words, (i + behind) // 64 + 1)
        same, up, down = where[low:high].take(step[:m], axis=1), rise[low:high, :m], fall[low:high, :m]
        total = (same & up) + up
        over = total < up
        for w in range(1, high - low):
            total[w] += over[w - 1]
            over[w] |= over[w - 1] & (total[w] == 0)
        held = same | down
        level = (total ^ up) | held
        right_up, right_down = _twice(down | ~(level | up)), _twice(up & level)
        right_up[0] |= np.uint64(1)
        np.bitwise_or(right_down, ~(held | right_up), out=up)
        np.bitwise_and(right_up, held, out=down)
    # from the rise and fall along the last column
    first = np.maximum(0, (length - 1 - ahead) // 64)
    for w in range(words):
        bits = np.clip(wide - 64 * w, 0, 64)
        mask = np.where(bits > 0, ~np.uint64(0) >> np.minimum(64 - bits, 63).astype(np.uint64), np.uint64(0))
        above += np.where(w >= first, _sum(rise[w] & mask, fall[w] & mask), 0)
    out[order] = above + length <= most
    return out


def _sum(rise, fall):
    return np.bitwise_count(rise).astype(np.int64) - np.bitwise_count(fall)


def _twice(bits):
    """Numbers of some words each, the lowest first, times two."""
    out = bits << np.uint64(1)
    out[1:] |= bits[:-1] >> np.uint64(63)
    return out


def near_in_edits(x: str, y: str, percent: int) -> bool:
    """Whether one minus edit distance over the longer length is ``percent`` or more.

    What both begin and end with costs nothing; the rest costs its longer length at most.
    If that doesn't decide, the distance is worked out on bit vectors, a column at a time.
    """
    allowed = max(len(x), len(y)) * (100 - percent) // 100
    x, y = _differing(x, y)
    if max(len(x), len(y)) <= allowed:
        return True
    if abs(len(x) - len(y)) > allowed:
        return False
    if within_words(x, y, allowed):
        return True
    a, b = Counter(x), Counter(y)  # an edit mends one missing and one spare character at most
    if max((a - b).total(), (b - a).total()) > allowed:
        return False
    return edits(x, y, allowed) <= allowed


def _differing(x: str, y: str):
    """Both without what both begin and end with."""
    i = _common(x, y)
    x, y = x[i:], y[i:]
    i = _common(x[::-1], y[::-1])
    return x[: len(x) - i], y[: len(y) - i]


def _common(x: str, y: str) -> int:
    """How many characters both begin with."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        i = (low + high + 1) // 2
        low, high = (i, high) if x[low:i] == y[low:i] else (low, i - 1)
    return low


def within_words(x: str, y: str, allowed: int) -> bool:
    """Whether word by word the changes cost no more than ``allowed``: enough, as the edit distance is no greater."""
    one, other = x.split(" "), y.split(" ")
    if len(one) != len(other):
        return False
    return sum(max(len(a), len(b)) for a, b in zip(one, other) if a != b) <= allowed


def edits(x: str, y: str, most: int | None = None) -> int:
    """Edit distance, or some number above ``most`` if it is greater; a column of the table is two bit vectors: where it rises and where it falls."""
    if not x or not y:
        return len(x) + len(y)
    where: dict[str, int] = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << i
    every, top = (1 << len(x)) - 1, 1 << len(x) - 1
    rise, fall, distance = every, 0, len(x)
    # each column still to come takes one from the distance at most
    left = len(y) + (len(x) + len(y) if most is None else most)
    for c in y:
        same = where.get(c, 0)
        down = (((same & rise) + rise) ^ rise) | same | fall
        right_rise, right_fall = fall | (every & ~(down | rise)), rise & down
        if right_rise & top:
            distance += 1
        elif right_fall & top:
            distance -= 1
        left -= 1
        if distance > left:
            return distance - left + (most or 0)
        right_rise, right_fall = (right_rise << 1 | 1) & every, right_fall << 1 & every
        rise, fall = right_fall | (every & ~((same | fall) | right_rise)), right_rise & (same | fall)
    return distance


def groups(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, line_no, group_doc, group_line, kept``: each line that takes part, and the one that stays for it."""
    return _groups(docs, percent).drop("row")


def _groups(docs, percent):
    made = cut(occurrences(docs))
    placed = made.select("doc_id", "row", "line_no", "node").join(linked(made, docs, percent).hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = placed.groupBy("component").agg(F.min(F.struct("doc_id", "line_no", "row")).alias("best"))
    kept = (F.col("doc_id") == F.col("best.doc_id")) & (F.col("line_no") == F.col("best.line_no")) & (F.col("row") == F.col("best.row"))
    return placed.join(best.hint("merge"), "component").select("doc_id", "row", "line_no", F.col("best.doc_id").alias("group_doc"), F.col("best.line_no").alias("group_line"), kept.alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with repeated lines gone; a document of which nothing is left goes as well."""
    gone = _groups(docs, percent).where(~F.col("kept")).groupBy(F.col("doc_id").alias("i"), F.col("row").alias("h")).agg(F.collect_set("line_no").alias("gone"))
    # the columns of docs are in a struct of their own, so no name clashes
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"))
    text = F.col("d.text").cast("string")
    joined = whole.join(gone, (F.col("d.doc_id").cast("long") == F.col("i")) & (F.xxhash64(text) == F.col("h")), "left")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    changes = {"text": F.when(F.col("gone").isNull(), F.col("d.text")).otherwise(left)}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(F.col("gone").isNull(), F.col("d.n_chars")).otherwise(F.length(left)).cast(docs.schema["n_chars"].dataType)
    kept = joined.where(F.col("gone").isNull() | F.rlike(left, F.lit(r"[^\x20\x09-\x0D]")))
    return kept.select(*(changes.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns))
