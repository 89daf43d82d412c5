"""The operators against brute force on small tables with all kinds of odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from orbframe.llm import bpe, counts, fmindex, graph, licenses, lines, near, packing, quality, search, suffixes

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, node string, key string, span string, kept string, h string, a string, b string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base, other, long = prose(1, 120), prose(2, 90), prose(3, 3000)
    words = base.split()
    texts = [
        None, "", " \n\t ", "one", base, base, other, "Start " + " ".join(words[20:100]) + " end", " ".join([*words[:60], "changed", *words[61:]]), long,
        other.upper(), "é" * 70 + " " + "é" * 70, "a" * 400, "a" * 300, "x y " * 80, prose(4, 30) + "\n" + prose(5, 25) + "\nReleased under the MIT License.",
        prose(5, 25) + "\n" + prose(6, 40), "it's  what\n\n we'll <|endoftext|> do\r\n 12 ½ 中文 🙂", "Home | News | About | Terms | Contact\n" * 12, long[:9000] + " tail",
    ]
    return [(i * 3 + 1, t, "en", "s", None if t is None else len(t), "n", "k", "s", "t", "h", "a", "b") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Rows without doc_id and repeated ones."""
    return spark.createDataFrame([*rows[:6], rows[4], rows[4], (None, *rows[4][1:]), (None, *rows[0][1:])], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def windows_gone(rows, units, size):
    own, out = {}, {}
    for i, t, *_ in rows:
        u = units(t or "")
        for s in range(len(u) - size + 1):
            own[tuple(u[s : s + size])] = min(i, own.get(tuple(u[s : s + size]), i))
    for i, t, *_ in rows:
        u = units(t or "")
        gone = [False] * len(u)
        for s in range(len(u) - size + 1):
            if own[tuple(u[s : s + size])] < i:
                gone[s : s + size] = [True] * size
        out[i] = (u, gone)
    return out


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def test_bytes_repeated(docs, rows):
    got = {r.doc_id: r for r in suffixes.removed(docs).collect()}
    for i, (u, gone) in windows_gone(rows, lambda t: t.encode(), 50).items():
        kept = bytes(x for x, g in zip(u, gone) if not g)
        runs = sum(g and not p for g, p in zip(gone, [False, *gone]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256, bytes(got[i].kept)) == (len(u), sum(gone), runs, sha(kept), kept), i


def test_words_repeated(docs, rows):
    got = {r.doc_id: r for r in fmindex.removed(docs).collect()}
    whole = {r.doc_id: r.text for r in fmindex.deduplicated(docs).collect()}
    for i, (u, gone) in windows_gone(rows, WORD.findall, 50).items():
        kept = " ".join(w for w, g in zip(u, gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(u), sum(gone), sha(kept.encode())), i
        if any(gone):
            assert whole.get(i) == (kept or None)
        else:
            assert whole[i] == dict((r[0], r[1]) for r in rows)[i]


def test_rows_that_repeat_a_doc_id_with_other_texts(spark):
    """Each row is answered by its own text, be the other one shorter or longer."""
    shared, more = prose(100, 80), prose(101, 90)
    rows = [
        (1, f"{prose(102, 30)} {shared} {prose(103, 10)}"), (2, f"{prose(104, 200)} {more}"), (5, shared), (5, f"{prose(105, 60)} {shared} {prose(106, 60)}"),
        (5, prose(107, 70)), (5, f"{prose(108, 61)} {more} x"), (7, more), (7, more), (7, prose(109, 3)), (7, None), (9, f"{shared} {more}"), (9, f"{more} {shared}"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for units, size, join, got in (
        (lambda t: t.encode(), 50, bytes, [(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffixes.removed(df).collect()]),
        (WORD.findall, 50, lambda w: " ".join(w).encode(), [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in fmindex.removed(df).collect()]),
    ):
        least, want = {}, []
        for i, t in rows:
            u = units(t or "")
            for s in range(len(u) - size + 1):
                least[tuple(u[s : s + size])] = min(i, least.get(tuple(u[s : s + size]), i))
        for i, t in rows:
            u = units(t or "")
            gone = [False] * len(u)
            for s in range(len(u) - size + 1):
                if least[tuple(u[s : s + size])] < i:
                    gone[s : s + size] = [True] * size
            want.append((i, len(u), sum(gone), sha(join([x for x, g in zip(u, gone) if not g]))))
        assert Counter(got) == Counter(want)
    left = Counter(r.text for r in fmindex.deduplicated(df).collect())
    assert left[rows[3][1].replace(f" {shared} ", " ")] == 1 and left[prose(107, 70)] == 1 and left[None] == 1 and left[prose(109, 3)] == 1 and shared not in left


def test_matching_statistics_are_those_of_brute_force(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fmindex, "SHARD", 60)  # several indexes
    r = random.Random(4)
    for _ in range(20):
        texts = [" ".join(r.choice("ab") for _ in range(r.randint(1, 30))) for _ in range(8)]
        owner = np.array([r.randint(0, 4) for _ in texts])
        doc, start = fmindex.shard_windows(pa.array([t.encode() for t in texts], pa.binary()), owner, np.zeros(8, np.int64), 6)
        want = Counter()
        for i, t in enumerate(texts):
            w = t.split()
            for s in range(len(w) - 5):
                if any(owner[j] < owner[i] and " ".join(w[s : s + 6]) in f"{o}" for j, o in enumerate(texts)):
                    want[(owner[i], s)] += 1
        assert Counter(zip(doc.tolist(), start.tolist())) == want


def test_words_that_an_index_lacks_end_matches(monkeypatch):
    import pyarrow as pa

    def windows(texts, size):
        made = fmindex.shard_windows(pa.array([t.encode() for t in texts], pa.binary()), np.arange(len(texts)), np.zeros(len(texts), np.int64), size)
        return Counter(zip(made[0].tolist(), made[1].tolist()))

    def brute(texts, size):
        w = [t.split() for t in texts]
        own = [{tuple(x[s : s + size]) for s in range(len(x) - size + 1)} for x in w]
        return Counter((i, s) for i, x in enumerate(w) for s in range(len(x) - size + 1) if any(tuple(x[s : s + size]) in o for o in own[:i]))

    monkeypatch.setattr(fmindex, "SHARD", 10)
    assert windows(["a b c d e", "p q r s t u v w", "a b c d e zz"], 6) == Counter()  # at the end of a span
    assert windows(["a b c d e", "p q r s t u v w", "yy a b c d e"], 6) == Counter()  # at its start
    assert windows(["a b c d e f", "p q r s t u v w", "yy a b c d e f zz"], 6) == Counter({(2, 1): 1})
    r = random.Random(12)
    for _ in range(60):
        texts = [" ".join(r.choice(["a", "b", "a", "b", f"own{i // 3}"]) for _ in range(r.randint(1, 14))) for i in range(9)]
        for size in (2, 3, 5):
            assert windows(texts, size) == brute(texts, size)


def test_loser_tree_merges_in_order():
    r = random.Random(5)
    blocks, every = [], []
    for k in range(7):
        w = np.array([[r.choice(b"ab") for _ in range(9)] for _ in range(r.randint(1, 40))], np.uint8)
        doc, start = np.full(len(w), k), np.arange(len(w), dtype=np.int32)
        every += [(bytes(x), k) for x in w]
        blocks.append(suffixes.packed(*suffixes.front_coded(w, doc, start)))
    got = [(d, shared) for d, _, shared in suffixes.merged([suffixes.Run(b) for b in blocks], 9)]
    assert len(got) == len(every)
    assert sum(shared < 9 for _, shared in got) == len({w for w, _ in every})
    docs, _ = suffixes.repeated(blocks, 9)
    least = {w: min(k for x, k in every if x == w) for w, _ in every}
    assert Counter(docs) == Counter(k for w, k in every if k > least[w])


def shingles(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = WORD.findall(t)
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def test_near_duplicates(docs, rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    at = {i: i for i in sets}
    for _ in sets:
        for i, s in sets.items():
            for j, o in sets.items():
                if s and o and 100 * len(s & o) >= 80 * len(s | o):
                    at[i] = at[j] = min(at[i], at[j])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.linked(docs).collect()}
    assert got == {i: (len(s), at[i], i == at[i]) for i, s in sets.items()}
    assert {r.doc_id for r in near.deduplicated(docs).collect()} == {i for i in sets if at[i] == i}


@pytest.mark.parametrize("most,small", [(3, 16), (9, 2)])
def test_near_copies_of_a_large_family(spark, monkeypatch, most, small):
    monkeypatch.setattr(graph, "SMALL", small)
    r = random.Random(9)
    base = prose(11, 80).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        w = list(base)
        for _ in range(r.randint(0, most)):
            w[r.randrange(80)] = f"w{r.randint(0, 50)}"
        if most > 3:
            w = w[r.choice([0, 0, 0, 9]) :]
            if i % 3 == 0:  # a family in the family
                w[20], w[35], w[50], w[65] = "these", "are", "changed", "together"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    edges = [(i, j) for i in sets for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    at = {i: i for i in sets}
    for _ in range(20):
        for i, j in edges:
            at[i] = at[j] = min(at[i], at[j])
    got = {r.doc_id: r.component_id for r in near.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == at


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_encoding_is_the_libraries(docs, rows):
    t = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in bpe.digests(docs, PATH, words=64).collect()}
    full = {r.doc_id: r for r in bpe.encoded(docs, PATH, words=4).collect()}
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert full[i].ids == ids
        assert full[i].decoded == (text or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(t.decode(ids, skip_special_tokens=False).encode())), i


def test_transducer_shares_suffixes():
    import pyarrow as pa

    words = sorted([b"walking", b"talking", b"walked", b"talked", b"walk", b"a"])
    v = bpe.Vocabulary(bpe.raw_file(PATH))
    lexicon = bpe.compile_lexicon(words, *v.merged(words))
    assert len(lexicon["final"]) < len({w[:i] for w in words for i in range(len(w) + 1)}) - 5  # a trie has one for each prefix
    assert bpe.walk(lexicon, pa.array([*words, b"wal", b"walkings", b""], pa.binary())).tolist() == [0, 1, 2, 3, 4, 5, -1, -1, -1]


def test_packing(docs, rows):
    t = Tokenizer.from_file(PATH)
    got = packing.pack(docs, PATH, capacity=64).toPandas()
    for i, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        mine = got[got.doc_id == i].sort_values("piece")
        assert mine.piece.tolist() == list(range(len(mine)))
        assert mine.start.tolist() == [0, *mine.length.cumsum()[:-1]]
        assert set(mine.length[1:]) <= {64}
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert mine.length.sum() == len(ids)
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.sum() <= 64).all()
    assert (got.offset == got.groupby("sequence_id").length.cumsum() - got.length).all()


def test_reduction_keeps_the_best_packing():
    def best(items, capacity):
        def fits(bins, left):
            if not left:
                return True
            x, rest = left[0], left[1:]
            for b in sorted(set(bins)):
                if b >= x:
                    after = list(bins)
                    after.remove(b)
                    if fits([*after, b - x], rest):
                        return True
            return False

        items = sorted(items, reverse=True)
        return next(n for n in range(len(items) + 1) if fits([capacity] * n, items))

    r = random.Random(6)
    for _ in range(40):
        items = Counter(r.randint(1, 10) for _ in range(8))
        fixed, left = packing.dominant(sorted(items), [items[x] for x in sorted(items)], 10)
        used = Counter()
        for pattern, n in fixed:
            assert sum(pattern) <= 10
            for x in pattern:
                used[x] += n
        assert used + Counter(left) == items
        assert sum(n for _, n in fixed) + best(list(Counter(left).elements()), 10) == best(list(items.elements()), 10)


def test_search(spark):
    r = np.random.default_rng(1)
    v = [(i, [float(x) for x in r.normal(size=12) * r.uniform(0.1, 3)]) for i in range(300)]
    v += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 12), (303, [float("inf")] * 12), (304, v[0][1]), (305, v[0][1][:5]), (306, [])]
    got = search.top(spark.createDataFrame(v, "vec_id long, embedding array<float>").repartition(3), "vec_id % 50 = 0", k=7).collect()
    x = {i: np.floor(1024 * np.array(e, np.float32).astype(float)).astype(np.int64) for i, e in v if i < 300 or i > 303}
    x = {i: np.pad(e, (0, 12 - len(e))) for i, e in x.items()}
    for q in range(0, 300, 50):
        want = sorted(((-int(x[q] @ e), i) for i, e in x.items() if i != q))[:7]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_quality(docs, odd):
    got = {r.doc_id: r for r in quality.digest(docs).collect()}
    assert (got[1].n_words, got[1].kept, got[4].n_words) == (0, False, 0)
    assert got[13].kept and not got[13].base_failed
    assert not got[55].kept and got[55].n_dup_lines == 11  # navigation
    assert got[43].n_repeat_words == 160 and got[43].base_failed
    assert quality.cleaned(docs).columns == docs.columns
    assert quality.digest(odd).count() == 10


def test_phrases_with_wide_gaps_count(spark):
    words = prose(30, 21)
    texts = {i: f"{words}\n" + "\n".join(f"click{gap}here {prose(31 + j, 8)}" for j in range(5)) for i, gap in enumerate([" ", "  ", "\t", "\x0b ", "\n"])}
    texts[5] = texts[1] + " #"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality.digest(df).collect()} == {0: False, 1: False, 2: False, 3: False, 4: True, 5: False}
    some = spark.createDataFrame([(1, f"{words}\n{words[::-1]}\nPrivacy\tPolicy")], "doc_id long, text string")
    assert [r.text for r in quality.cleaned(some).collect()] == [f"{words}\n{words[::-1]}"]


def test_lines(docs, rows):
    got = {(r.doc_id, r.line_no): (r.group_doc, r.group_line) for r in lines.groups(docs).collect()}
    assert got[(49, 0)] == (46, 1)
    assert got[(46, 2)] == (46, 2)
    left = {r.doc_id: r.text for r in lines.deduplicated(docs).collect()}
    assert 16 not in left  # a whole copy
    assert left[49] == prose(6, 40)
    assert left[1] is None


def test_edit_similarity():
    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x):
            new = [i + 1]
            for j, b in enumerate(y):
                new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    r = random.Random(2)
    for _ in range(500):
        x, y = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(2))
        assert lines.edits(x, y) == distance(x, y)
        assert lines.near_in_edits(x, y, 80) == (distance(x, y) <= max(len(x), len(y)) * 20 // 100)


def test_fuzzy_lines_meet(spark):
    """The groups of all lines are those of all pairs of lines within 0.8, if one word differs at most."""
    r = random.Random(21)
    rows = []
    for g in range(25):
        base = prose(2000 + g, r.choice([3, 6, 9, 20, 55, 70])).split()
        for _ in range(r.randint(1, 6)):
            w = list(base)
            if (k := r.randrange(4)) < 2:
                w[r.randrange(len(w))] = "".join(r.choice("klmnop") for _ in range(r.randint(1, 9)))
            elif k == 2:
                w.insert(r.randrange(len(w)), "more")
            rows.append("  ".join(w).upper() if r.random() < 0.3 else " ".join(w))
    docs = [(i // 3, "\n".join(rows[i : i + 3])) for i in range(0, len(rows), 3)]
    at = [(i, n, x.lower().split()) for i, t in docs for n, x in enumerate(t.split("\n"))]
    best = {x[:2]: x[:2] for x in at}
    links = []
    for x in at:
        for y in at:
            one, other = Counter(x[2]), Counter(y[2])
            a, b = " ".join(x[2]), " ".join(y[2])
            if (one - other).total() <= 1 and (other - one).total() <= 1 and lines.edits(a, b) * 5 <= max(len(a), len(b)):
                links.append((x[:2], y[:2]))
    for _ in range(12):
        for x, y in links:
            best[x] = best[y] = min(best[x], best[y])
    got = {(x.doc_id, x.line_no): (x.group_doc, x.group_line) for x in lines.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(got) == set(best)
    assert {x for x, y in links if got[x] != got[y]} == set()
    # what is linked besides is within 0.8 as well, through others
    whole = {x[:2]: " ".join(x[2]) for x in at}
    for x, y in got.items():
        same = [z for z in got if got[z] == y and z != x]
        assert x == y or any(lines.edits(whole[x], whole[z]) * 5 <= max(len(whole[x]), len(whole[z])) for z in same)


@pytest.mark.parametrize("words,changes", [(12, 2), (30, 2), (60, 5), (100, 7)])
def test_lines_with_several_changed_words_meet(spark, words, changes):
    r = random.Random(words)
    rows = []
    for i in range(60):
        w = prose(3000 * words + i, words).split()
        changed = list(w)
        for k in r.sample(range(words), changes):
            changed[k] = w[k][::-1][:3] + "k"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(changed))]
    near = [i for i in range(0, 120, 2) if lines.near_in_edits(rows[i][1], rows[i + 1][1], 80)]
    got = {x.doc_id: x.group_doc for x in lines.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 20 and sum(got[i + 1] == got[i] for i in near) >= 0.9 * len(near)


def test_rows_that_repeat_a_doc_id_have_lines_each(spark):
    one, two = f"{prose(80, 9)}\n{prose(81, 9)}", f"{prose(82, 9)}\n{prose(81, 9)}\n{prose(83, 9)}"
    df = spark.createDataFrame([(1, one), (1, two), (1, one), (2, prose(82, 9))], "doc_id long, text string")
    assert Counter(lines.deduplicated(df).collect()) == Counter([(1, one), (1, one), (1, f"{prose(82, 9)}\n{prose(83, 9)}")]) or Counter(
        lines.deduplicated(df).collect()) == Counter([(1, prose(80, 9)), (1, prose(80, 9)), (1, two)])


def test_a_line_of_a_megabyte(spark):
    long = "-".join(prose(90, 500) for _ in range(400))
    df = spark.createDataFrame([(1, long), (2, long[:500_000] + "x" + long[500_001:]), (3, "x" * 1_000_000)], "doc_id long, text string")
    assert {r.doc_id: r.group_doc for r in lines.groups(df).collect()} == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("words", [6, 8, 12, 20, 50])
def test_lines_with_a_changed_word_meet(spark, words):
    r = random.Random(words)
    rows, near = [], []
    for i in range(150):
        w = prose(1000 * words + i, words).split()
        changed = list(w)
        changed[r.randrange(words)] = "".join(r.choice("klmnop") for _ in range(4))
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(changed))]
        x, y = rows[-2][1], rows[-1][1]
        if lines.edits(x, y) * 5 <= max(len(x), len(y)):
            near.append(2 * i)
    got = {x.doc_id: x.group_doc for x in lines.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) >= 100 and sum(got[i + 1] == got[i] for i in near) >= 0.98 * len(near)
    assert all(got[i + 1] != got[i] for i in range(0, 300, 2) if i not in near)


def test_short_lines_and_any_script_take_part(spark):
    chinese = "".join(chr(0x4E00 + random.Random(40).randrange(3000) + i) for i in range(60))
    texts = [f"Contact Us\n{chinese}\n----", f"contact us!\n\n  {chinese}\n----\n====\nx", f"{chinese[:20]}字{chinese[21:]}\n \t\nHome", "ok\nHome\nHomes and gardens"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.line_no): (r.group_doc, r.group_line) for r in lines.groups(df).collect()}
    assert got == {
        (0, 0): (0, 0), (0, 1): (0, 1), (0, 2): (0, 2), (1, 0): (0, 0), (1, 2): (0, 1), (1, 3): (0, 2), (1, 4): (1, 4), (1, 5): (1, 5),
        (2, 0): (0, 1), (2, 2): (2, 2), (3, 0): (3, 0), (3, 1): (2, 2), (3, 2): (3, 2),
    }
    assert {r.doc_id: r.text for r in lines.deduplicated(df).collect()} == {0: texts[0], 1: "\n====\nx", 2: " \t\nHome", 3: "ok\nHomes and gardens"}


def test_licenses(docs, spark):
    assert [(r.doc_id, r.license, r.matched) for r in licenses.scan(docs).collect()] == [(46, "MIT", 5)]
    text = prose(7, 40) + " this work is licensed under a Creative   Commons Attribution-4.0 International license! " + prose(8, 10)
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(x.license, x.matched, x.words) for x in r] == [("CC-BY-4.0", 13, 13)]
    assert text[r[0].from_byte : r[0].to_byte].startswith("this work") and text[r[0].from_byte : r[0].to_byte].endswith("license")


def test_templates_are_found_as_by_full_alignment():
    every = licenses.all_templates()
    ix = licenses.index(every)
    r = random.Random(50)
    for t, name in enumerate(ix["names"]):
        known = re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), every[name]))
        assert len(known) == len(ix["words"][t]), name
        for gone in (0, len(known) // 10, len(known) // 5):
            w = list(known)
            for i in r.sample(range(len(w)), gone):
                w[i] = "changed"
            text = f"{prose(51, 30)} {' '.join(w)} {prose(52, 30)}".encode()
            got = [m for m in licenses.matches(np.frombuffer(text, np.uint8), np.array([0, len(text)]), ix, 80) if m[1] == t]
            full, _, _ = licenses.align(known, text.decode().split())
            assert [m[2] for m in got] == [full], (name, gone)
    mit = [ix["names"].index("MIT")]
    for text, n in (("Released under MIT License", [4]), ("Released under the MIT License. a b c Released under the MIT License.", [5, 5])):
        made = [m for m in licenses.matches(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), ix, 80) if m[1] in mit]
        assert [m[2] for m in made] == n
        assert made[0][3] == 0


def test_counts(docs, rows):
    raw = bpe.raw_file(PATH)
    score = {p: s for p, s in zip(bpe.Vocabulary(raw).pieces.to_pylist(), counts.scores(50257).tolist()) if p}

    def brute(w):
        best = [(0, 0)]
        for e in range(1, len(w) + 1):
            best.append(max((best[s][0] + score[w[s:e]], best[s][1] - 1) for s in range(max(0, e - 130), e) if w[s:e] in score))
        return best[-1][0], -best[-1][1]

    r = random.Random(3)
    words = sorted({bytes(r.choice(b"abceth \xc3\xa9") for _ in range(r.randint(1, 12))) for _ in range(400)})
    r.shuffle(words)
    assert counts.best(words, raw) == [brute(w) for w in words]
    got = {r.doc_id: r for r in counts.counted(docs, PATH).collect()}
    assert (got[1].n_pretokens, got[1].n_tokens, got[10].n_tokens, got[10].score) == (0, 0, brute(b"one")[1], brute(b"one")[0])


def every(df):
    return [
        suffixes.removed(df), fmindex.removed(df), fmindex.deduplicated(df), near.linked(df), near.deduplicated(df), lines.groups(df), lines.deduplicated(df),
        bpe.digests(df, PATH), packing.pack(df, PATH), quality.digest(df), quality.cleaned(df), licenses.scan(df), counts.counted(df, PATH),
    ]


def test_empty_tables(empty, spark):
    for df in every(empty):
        assert df.count() == 0
    assert search.top(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id % 100 = 0").count() == 0


def test_null_ids_and_repeated_rows(odd):
    n = [df.count() for df in every(odd)]
    assert n[0] == n[1] == n[3] == n[7] == n[9] == n[12] == 10
    assert {(r.doc_id, r.component_id) for r in near.linked(odd).collect()} >= {(None, None), (13, 13), (16, 13)}


def test_pipeline_stages_keep_the_columns(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    made = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, made, str(tmp_path))
        assert made.columns == docs.columns, name
        made = spark.createDataFrame(made.collect(), SCHEMA)
    ids = {r.doc_id for r in made.collect()}
    assert 13 in ids and 16 not in ids and 1 not in ids
    last = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert last == ids


def test_pipeline_is_that_of_brute_force(spark, tmp_path):
    one, two, three, four = (prose(60 + i, 90) for i in range(4))
    passage, line = prose(70, 60), prose(71, 12)
    near_one = one.split()
    near_one[40] = "kkkk"
    swap = two.split()
    swap = " ".join(swap[45:] + swap[:45])
    texts = [
        (1, f"{one}\nclick\there {prose(72, 4)}"), (2, " ".join(near_one)), (3, f"{two}\n{line}"), (4, swap), (5, f"{three}\n{line.replace(line.split()[5], 'mnop')}\nTop"),
        (6, f"{prose(73, 20)} {passage} {prose(74, 20)}\nTop"), (7, f"{prose(75, 20)} {passage} {prose(76, 20)}"), (8, "too short"), (9, four), (9, four), (None, prose(77, 40)), (None, prose(77, 40)),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars int")
    df.write.parquet(f"{tmp_path}/documents.parquet")

    # quality: of these texts, short ones and one line fail
    docs = [(i, "\n".join(x for x in t.split("\n") if not x.startswith("click"))) for i, t in texts if len(t.split()) >= 20]
    # lines
    at = sorted({(i, n, x) for i, t in docs if i is not None for n, x in enumerate(t.split("\n"))})
    best = {x[:2]: x[:2] for x in at}
    for _ in at:
        for x in at:
            for y in at:
                a, b = x[2].lower(), y[2].lower()
                if lines.edits(a, b) * 5 <= max(len(a), len(b)):
                    best[x[:2]] = best[y[:2]] = min(best[x[:2]], best[y[:2]])
    docs = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if i is None or best[i, n] == (i, n))) for i, t in docs]
    docs = [x for x in docs if x[1].strip()]
    # near copies and repeated rows
    sets = {i: shingles(t) for i, t in docs if i is not None}
    gone = {i for i in sets for j in sets if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    docs = list({x for x in docs if x[0] not in gone})
    # passages
    covered = windows_gone([x for x in docs if x[0] is not None], WORD.findall, 50)
    kept = [(i, t if i is None or not any(covered[i][1]) else " ".join(w for w, g in zip(*covered[i]) if not g)) for i, t in docs]
    assert 2 not in dict(kept) and 4 in gone and any(covered[7][1]) and len(kept) == 7

    t = Tokenizer.from_file(PATH)
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in kept}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    made = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    assert made == Counter((i, 0, 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items())
    assert all(sum(r.length for r in got if r.sequence_id == s) <= 2048 for s in {r.sequence_id for r in got})
