"""Ranked search, importance resampling and merge rounds against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

from orbframe.llm import lexical, lines, pieces, resample
from orbframe.llm import text as T

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, score long, rank long, place long, digit int, block long, n_words long, term string"
EXTRA = ("en", 5, 6, 7, 8, 9, 10, "t")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def table(spark, texts):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in texts], SCHEMA)


def prose(seed: int, n: int, vocabulary: int = 60) -> str:
    r = random.Random(seed)
    return " ".join(f"w{int(vocabulary * r.random() ** 3)}" for _ in range(n))


# --- merge rounds -------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return pieces.Model(f.read())


def odd_texts(n: int):
    r = random.Random(1)
    kinds = ["abcdefgh", "thein rsa", "ab ", "▁ a", " ", "the and return<s>", "中文字é🙂 a\n\t\x00", "▁ 　 x", "<0x41></s><unk>s"]
    for i in range(n):
        yield "".join(r.choice(r.choice(kinds) if i % 3 == 0 else kinds[i % len(kinds)]) for _ in range(r.randint(1, 60 if i % 50 else 900)))
    for _ in range(n):
        yield "".join(chr(r.choice([r.randint(1, 127), r.randint(128, 0x7FF), r.randint(0x800, 0xD7FF), r.randint(0xE000, 0x10FFFF)])) for _ in range(r.randint(1, 30)))


def test_ids_are_the_librarys(model, library):
    texts = ["", None, " ", "  ", "\n", "\x00", " " * 300, "a" * 5000, "▁▁▁", " a  b   c", "<s>hello</s>", *odd_texts(1500)]
    for first, last, data, at in T.chunks(pa.array(texts, pa.string())):
        ids, ends = pieces.encode(data, at, model)
        shown, begin, end = pieces.decoded(model, ids, ends)
        for i in range(last - first):
            want = library.encode(texts[first + i] or "")
            assert ids[ends[i] : ends[i + 1]].tolist() == want, texts[first + i]
            assert shown[begin[i] : end[i]].tobytes().decode() == library.decode(want)


def test_heap_and_rounds_agree(model, library, monkeypatch):
    texts = [t.encode() for t in odd_texts(150)]
    segments = [s for t in texts for s in [b" " + t]]
    rounds = model.merged(segments)
    monkeypatch.setattr(pieces, "LONG", 1)
    heap = model.merged(segments)
    assert all((a == b).all() for a, b in zip(rounds, heap))


def test_texts_are_cut_only_where_no_piece_reaches(model):
    code = np.array([ord(c) for c in " the theory 中文 x"], np.uint32)
    begin = model.segments(code, [0])
    assert begin[0] == 0 and 4 in begin and set(range(1, 4)).isdisjoint(begin)


def test_a_long_text_without_blanks(model, library):
    r = random.Random(5)
    text = "".join(r.choice("etaoinshr") for _ in range(300_000))
    ids, ends = pieces.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), model)
    assert ids.tolist() == library.encode(text)


def test_the_memory_is_bounded(model, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    for k in range(5):
        words = [b" %d" % (i + k) for i in range(25)]
        slots = model.slots(words)
        assert [model.pool[model.start[s] : model.start[s] + model.length[s]].tolist() for s in slots] == [model.merged([w])[0].tolist() for w in words]
    model.forget()


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Model(bytes([0x12, 0x02, 0x18, 0x01]))  # a trainer of unigrams


def test_pieces_of_documents(spark, library):
    texts = [(1, None), (2, ""), (3, "it's  what\n\n we'll do\r\n 12 ½ 中文 🙂"), (None, "x y"), (3, "another row"), (3, "another row"), (4, " \t\n"), (5, "long " * 20_000)]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(table(spark, texts), PATH).collect())
    want = [(i, library.encode(t or "")) for i, t in texts]
    assert got == Counter((i, len(x), sha(",".join(map(str, x)).encode()), sha(library.decode(x).encode())) for i, x in want)
    full = [(r.doc_id, r.ids, r.decoded) for r in pieces.encoded(table(spark, texts).coalesce(1), PATH).collect()]
    assert full == [(i, x, t or "") for (i, x), (_, t) in zip(want, texts)]
    assert pieces.digests(table(spark, []), PATH).count() == 0


# --- importance resampling ----------------------------------------------------


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def runs(t):
    w = words(t)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def test_crcs_of_runs():
    texts = ["", "One TWO three", "é" * 40 + " b", "a" * 1000 + " c " + "d" * 70_000 + " e f", "x", "1 2", "a-b_c"]
    data, at = T.flat(pa.array(texts, pa.string()))
    bucket, row, n = resample.features(data, at, 10_000)
    for i, t in enumerate(texts):
        assert Counter(bucket[row == i].tolist()) == Counter(zlib.crc32(g.encode()) % 10_000 for g in runs(t))
        assert n[i] == len(words(t))


def brute_draw(docs, target):
    s, t = (Counter(zlib.crc32(g.encode()) % 10_000 for x in texts for g in runs(x)) for texts in ([x for _, x in docs], target))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 10_000) / ((s[b] + 1) * (sum(t.values()) + 10_000)))) for b in range(10_000)}
    out = []
    for i, x in docs:
        weight = sum(gain[zlib.crc32(g.encode()) % 10_000] for g in runs(x))
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(runs(x)), weight, score, len(words(x)) >= 20 and i is not None])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0]))
    rank = {id(r): n + 1 for n, r in enumerate(able[: 5 * len(able) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


def test_draw(spark):
    docs = [(3 * i - 50, prose(i, 10 + i % 40)) for i in range(130)] + [(500, None), (501, ""), (None, prose(7, 30)), (502, "A" * 5000 + " " + prose(1, 30))]
    docs += [(600, prose(8, 25))] * 3
    target = [prose(900 + i, 30, 25) for i in range(5)] + [None, ""]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.drawn(table(spark, docs).repartition(5), items).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got) == Counter(brute_draw(docs, target))
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4]
    none = items.where("item_id < 0")
    assert Counter((r.doc_id, r.weight, r["rank"]) for r in resample.drawn(table(spark, docs), none).collect()) == Counter((r[0], r[2], r[4]) for r in brute_draw(docs, []))
    assert resample.drawn(table(spark, []), items).count() == 0
    assert [r["rank"] for r in resample.drawn(table(spark, docs[:3]), items).collect()] == [None] * 3


def test_radix_sort(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK_BITS", 5)
    monkeypatch.setattr(resample, "DIGIT_BITS", 3)
    r = random.Random(3)
    rows = [(r.randint(-40, 40), r.randint(0, 9), i) for i in range(400)] + [(7, 1, 1000 + i) for i in range(150)]
    spark.createDataFrame(rows, "score long, doc_id long, n long").repartition(3).write.parquet(f"{tmp_path}/rows")
    read = spark.read.parquet(f"{tmp_path}/rows")
    order = {x.n: x.at for x in read.withColumn("at", resample.F.monotonically_increasing_id()).collect()}
    got = sorted(resample.ordered(read, [("score", True), ("doc_id", False)]).collect(), key=lambda x: x.place)
    assert [x.place for x in got] == list(range(len(rows)))
    assert [(x.score, x.doc_id, x.n) for x in got] == sorted(rows, key=lambda x: (-x[0], x[1], order[x[2]]))


def test_radix_sort_of_all_longs(spark, tmp_path):
    rows = [(v,) for v in (-(1 << 63), -5, 0, 1, 7, 7, (1 << 63) - 1)]
    spark.createDataFrame(rows[::-1], "v long").write.parquet(f"{tmp_path}/v")
    for highest in (False, True):
        got = sorted(resample.ordered(spark.read.parquet(f"{tmp_path}/v"), [("v", highest)]).collect(), key=lambda x: x.place)
        assert [(x.v,) for x in got] == (rows[::-1] if highest else rows)
    same = spark.read.parquet(f"{tmp_path}/v").where("v = 7")
    assert sorted(x.place for x in resample.ordered(same, [("v", True)]).collect()) == [0, 1]


# --- ranked search ------------------------------------------------------------


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_ranks(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    some, every = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    held = Counter(t for _, b in bags for t in b)
    out = set()
    for item, text in items:
        scores = []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * some // every if every else 0
            score = sum(math.floor(1000 * math.log((2 * some + 2) / (2 * held[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if t in b)
            if score > 0 and i is not None:
                scores.append((-score, i))
        out |= {(item, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize("shard,part", [(2_000_000, 1_000_000), (300, 400)])
def test_ranks(spark, monkeypatch, shard, part):
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "PART", part)
    docs = [(2 * i, prose(i, 3 + i % 50, 200)) for i in range(300)] + [(1, None), (3, ""), (None, prose(5, 60, 200)), (5, "Été W0 w0_W1-w2 中文"), (7, "z" * 50_000 + " w3")]
    docs += [(8, docs[4][1])] * 3 + [(9, docs[4][1])]
    items = [(i, prose(1000 + i, 12, 200)) for i in range(40)] + [(50, None), (51, ""), (52, "été w0 W0 nothing"), (53, docs[4][1]), (None, "w1")]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.ranked(table(spark, docs).repartition(3), df, k=7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert {tuple(r) for r in got.collect()} == brute_ranks(docs, items[:-1], 7)
    assert lexical.ranked(table(spark, []), df).count() == 0
    assert lexical.ranked(table(spark, docs), df.where("item_id < 0")).count() == 0
    assert lexical.ranked(table(spark, [(1, "?"), (2, None)]), df).count() == 0


def test_of_repeated_items_the_smallest_text_counts(spark):
    docs = [(1, "a b"), (2, "b c")]
    items = spark.createDataFrame([(1, "c"), (1, "a")], "item_id long, text string")
    assert [r.doc_id for r in lexical.ranked(table(spark, docs), items).collect()] == [1]


def test_accumulators_stop(monkeypatch):
    """Frequent terms update what exists and create nothing new; results stay those of all terms."""
    r = random.Random(4)
    docs = [(i, " ".join(["the"] * r.randint(1, 3) + [f"rare{i % 40}"] * (i % 3 == 0))) for i in range(400)]
    part = lexical.Part([(0, "rare0 the"), (1, "rare3 the the")])
    data, at = T.flat(pa.array([t for _, t in docs], pa.string()))
    row, term, tf, n = lexical.postings(data, at, part.terms)
    part.weigh(int((n > 0).sum()), int(n.sum()), np.bincount(term, minlength=len(part.terms)))
    shard = lexical._shard([(np.arange(400), row, term, tf, n)], part)
    best, made = lexical.Best(2), []
    old = best.add
    best.add = lambda item, score, doc: (made.append(len(doc)), old(item, score, doc))
    lexical.answer(shard, part, best)
    assert max(made) < 10
    got = {(i, k + 1, d, s) for i, (score, doc) in best.of.items() for k, (s, d) in enumerate(zip(score.tolist(), doc.tolist()))}
    assert got == brute_ranks(docs, [(0, "rare0 the"), (1, "rare3 the the")], 2)


def test_lines_that_can_be_linked_have_characters_that_allow_it():
    rng, letters = np.random.default_rng(5), list("etaoinshr  0éß漢😀")
    pairs, linked = [], 0
    for _ in range(600):
        x = list(rng.choice(letters, rng.integers(3, 90)))
        y = list(x)
        for _ in range(int(rng.integers(0, 2 + len(x) // 3))):
            i, kind = int(rng.integers(0, len(y) + 1)), rng.integers(0, 3)
            y[i : i + (kind > 0)] = rng.choice(letters, int(kind < 2)).tolist()
        pairs.append(("".join(x), "".join(y)))
    for marks, (x, y) in zip(zip(lines.counted([x for x, _ in pairs]), lines.counted([y for _, y in pairs])), pairs):
        a, b = ([int(v) & (1 << 64) - 1 for v in m] for m in marks)
        lacks = max(abs(a[0] - b[0]), *(sum((p & ~q).bit_count() for p, q in zip(u[1:], v[1:])) for u, v in ((a, b), (b, a))))
        linked += lines.near_in_edits(x, y, 80)
        assert a[0] == len(x) and (lacks <= max(len(x), len(y)) * 20 // 100 or not lines.near_in_edits(x, y, 80))
    assert 100 < linked < 600


def test_lines_with_common_words_alone_in_common_are_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))
    # eight words, two of them the same in all lines; and ten lines that differ from another in a letter
    texts = [" ".join(["of", "the", *(word() for _ in range(6))]) for _ in range(700)]
    texts += [t[:-1] + "!x" for t in texts[:10]] + [t[:-1] + ("q" if t[-1] != "q" else "p") for t in texts[:10]]
    tried, confirmed = [], lines.confirmed

    def counting(pairs, *rest):
        tried.append(pairs.count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(lines, "confirmed", counting)
    got = lines.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    group = {r.doc_id: r.group_doc for r in got}
    assert all(group[710 + i] == i for i in range(10))
    assert len(tried) == 1 or tried[1] < 700
