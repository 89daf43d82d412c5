"""Line dedup: a pair of lines is made once, and counts and distances that end early are right."""

import random

import numpy as np

from orbframe.llm import lines


def test_lines_that_many_tasks_have_are_one_line_under_a_key(spark, monkeypatch):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))
    base = [word() for _ in range(20)]
    # lines of twenty words that have some of them in common; each in eight documents of another task
    texts = [" ".join(base[:12] + [word() for _ in range(8)]) for _ in range(12)] + [" ".join([*base[:-1], word()]) for _ in range(6)]
    docs = spark.createDataFrame([(i * len(texts) + j, t) for i in range(8) for j, t in enumerate(texts)], "doc_id long, text string")
    stars, pairs, cut = [], [], lines.cut

    def seen(df):
        out = cut(df)
        if {"key", "a", "b"} <= set(out.columns):
            stars.append([(r.key, r.b) for r in out.collect()])
        elif out.columns == ["a", "b"]:
            pairs.append([(r.a, r.b) for r in out.collect()])
        return out

    monkeypatch.setattr(lines, "cut", seen)
    got = lines.groups(docs.repartition(8, "doc_id")).collect()
    assert len(stars) == 1 and len(stars[0]) > 10 and len(set(stars[0])) == len(stars[0])
    assert all(len(set(p)) == len(p) for p in pairs)
    same = {x: {y for y in range(len(texts)) if lines.near_in_edits(texts[x], texts[y], 80)} for x in range(len(texts))}
    assert all(r.group_doc == min(same[r.doc_id % len(texts)]) for r in got if r.doc_id % len(texts) >= 12)
    assert len(got) == 8 * len(texts) and sum(r.kept for r in got) == len({r.group_doc for r in got})


def test_bits_are_counted_in_runs_of_any_length():
    rng = np.random.default_rng(9)
    for most in (200, 255, 256, 2000):
        size = np.r_[rng.integers(1, most + 1, 9), 1, most]
        hashes = rng.integers(0, 1 << 64, size.sum(), np.uint64) | np.uint64(5)  # some bits are set in all
        want = [[int((run >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)] for run in np.split(hashes, np.cumsum(size)[:-1])]
        assert lines._ones(hashes, size).tolist() == want


def test_distances_that_end_early_decide_alike():
    r = random.Random(3)
    some = lambda: "".join(r.choice("abc ") for _ in range(r.randint(0, 30)))
    for _ in range(2000):
        x, y, most = some(), some(), r.randint(0, 30)
        assert (lines.edits(x, y, most) <= most) == (lines.edits(x, y) <= most)
        i = lines._common(x, y)
        assert x[:i] == y[:i] and (i == min(len(x), len(y)) or x[i] != y[i])


def test_many_distances_at_once_decide_as_one_by_one(monkeypatch):
    r = random.Random(4)
    pairs = []
    for alphabet, longest in (("ab ", 60), ("abcdefghijkl ", 500), ("aß日本語字€𝄞 " + "".join(map(chr, range(0x4E00, 0x4F00))), 200)):
        for _ in range(250):
            x = "".join(r.choice(alphabet) for _ in range(r.randint(0, longest)))
            y = list(x)
            for _ in range(r.randint(0, len(x) // 3 + 2)):
                i = r.randint(0, len(y))
                y[i : i + r.randint(0, 2)] = r.choice(["", alphabet[0], r.choice(alphabet)])
            pairs += [(x, "".join(y))]
    xs, ys = zip(*pairs)
    want = {percent: [lines.near_in_edits(x, y, percent) for x, y in pairs] for percent in (0, 50, 80, 95, 100)}
    assert 50 < sum(want[80]) < 700
    with monkeypatch.context() as m:
        m.setattr(lines, "near_in_edits", None)  # none of these is looked at alone
        for size in ((lines.COLUMN, lines.MARKED), (16, 1 << 10)):
            m.setattr(lines, "COLUMN", size[0])
            m.setattr(lines, "MARKED", size[1])
            assert all(lines.near_each(xs, ys, percent).tolist() == w for percent, w in want.items())
    monkeypatch.setattr(lines, "ALONE", 100)  # longer ones are
    assert lines.near_each(xs, ys, 80).tolist() == want[80] and lines.near_each([], [], 80).tolist() == []


def test_lines_met_before_cost_no_keys():
    rng = np.random.default_rng(10)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    for mark in ("", "日本"):
        data = np.frombuffer("\n".join(" ".join(word() for _ in range(n)) + mark for n in (3, 9, 12, 0, 30, 50, 90, 12)).encode(), np.uint8)
        edges = np.r_[0, np.flatnonzero(data == 10), len(data)]
        seen, hasher, words, _ = lines.hashed(data, edges)
        line, keys, sketch = lines.block_keys(seen, edges)
        wanted = np.arange(len(edges) - 1) % 3 != 1
        got = lines.block_keys(seen, edges, hasher, wanted, words)
        assert sorted(zip(got[0].tolist(), got[1].tolist())) == sorted((i, k) for i, k in zip(line.tolist(), keys.tolist()) if wanted[i])
        assert got[2][wanted].tolist() == sketch[wanted].tolist()
