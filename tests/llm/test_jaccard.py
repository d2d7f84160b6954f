import random

import numpy as np
import pytest

from weftline.llm import components, jaccard, shingles


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def sets_of(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            both = len(sets[i] & sets[j])
            if a is not None and b is not None and sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((k, len(s), None if k is None else find(k)) for (k, _), s in zip(rows, sets, strict=True)), key=str)


def corpus():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    rows = []
    passage = text(60)
    for _ in range(25):  # a passage that many share
        rows.append(text(rng.randint(30, 200)) + passage + text(20))
    for _ in range(8):  # groups of near copies, and chains of them
        base = text(rng.randint(20, 150))
        for _ in range(rng.randint(2, 12)):
            base = list(base)
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            rows.append(base[: len(base) - rng.randint(0, 3)])
    rows += [rows[40]] * 5 + [text(n) for n in range(1, 9)] + [["A", "b"], ["a", "B"], ["x"] * 300, ["x"] * 5]
    return [" ".join(r) for r in rows]


@pytest.mark.parametrize("small", [False, True])
def test_jaccard(spark, small, monkeypatch):
    if small:  # frequent columns are cut into parts
        levels = jaccard.sketch_levels
        monkeypatch.setattr(jaccard, "COLUMN", 3)
        monkeypatch.setattr(components, "ONE_TASK", 0)
        monkeypatch.setattr(jaccard, "sketch_levels", lambda first: np.maximum(levels(first), np.arange(jaccard.SKETCH) % 3 * 12).astype(np.uint8))
    texts = corpus()
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    rows = [*zip(ids, texts, strict=True), (1000, None), (1001, ""), (1002, " \t"), (None, texts[0]), (1003, "long words here " * 20_000), (1004, "é\x85b c")]
    docs = spark.createDataFrame([(*r, 1, "z", 2, 3) for r in rows], "doc_id long, text string, id int, name string, part int, n int").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()), key=str)
    assert got == brute(rows)


def test_repeated_ids_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "q r s t u v"), (2, "q r s t u v"), (3, "a b c d e f"), (2, "q r s t u v"), (4, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()), key=str) == brute(rows)
    assert jaccard.jaccard_components(docs.limit(0)).collect() == []


def test_repeated_ids_of_several_classes(spark):
    rows = [(3, "a b c d e f"), (5, "a b c d e f"), (5, "q r s t u v"), (6, "q r s t u v"), (5, ""), (5, None), (1, "x y"), (8, "x y"), (8, "k l m"), (7, "k l m"), (9, "k l m"), (9, "g h i j"), (10, "g h i j"), (11, "z"), (11, "z"), (None, "z"), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()), key=str) == brute(rows)


def thue_morse(n):
    """Two strings of n letters that polynomial hashes modulo 2^64 take for one, whatever their odd base."""
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def product(rows):
    """Components by the whole incidence matrix, for rows with unique ids and words in each."""
    number, sets = {}, [sets_of(t) for _, t in rows]
    m = np.zeros((len(rows), len(set().union(*sets))), dtype=np.float32)
    for i, s in enumerate(sets):
        m[i, [number.setdefault(g, len(number)) for g in s]] = 1
    n, common = m.sum(1), m @ m.T
    link = 100 * common >= 80 * (n[:, None] + n - common)
    label = np.array([k for k, _ in rows])
    while True:
        after = np.where(link, label, 1 << 60).min(1)
        if (after == label).all():
            return sorted((k, len(s), int(x)) for (k, _), s, x in zip(rows, sets, label, strict=True))
        label = after


@pytest.mark.parametrize(("count", "length", "small"), [(2000, 40, False), (400, 60, True)])
def test_large_groups_of_near_copies(spark, count, length, small, monkeypatch):
    if small:
        for name, value in (("LIST", 6), ("PART_SETS", 40), ("PART_SHINGLES", 1500), ("COLUMN", 10)):
            monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(count)
    base = [f"v{i}" for i in range(length)]
    texts = []
    for i in range(count):  # many pairs lie around the threshold; some sets are much smaller
        t = list(base)
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(length)] = f"u{rng.randrange(30)}"
        texts.append(" ".join(t[: length - rng.choice([0, 0, 0, 3, 12])]))
    x, y = thue_morse(1024)
    for w in (f"z{x}{'c' * 1027}", f"z{y}{'c' * 1027}"):
        texts += [w, f"x y {w} z w"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = product(rows)
    assert len({c for _, _, c in want}) > 5
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()) == want


@pytest.mark.parametrize("dense", [1, 10, 10_000])
def test_overlaps(dense, monkeypatch):
    monkeypatch.setattr(jaccard, "DENSE", dense)
    monkeypatch.setattr(jaccard, "COLUMNS", 3)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(40)]
    for left, right in ((np.arange(15), np.arange(15, 40)), (np.arange(40), np.arange(40))):
        assert jaccard._overlaps(sets, left, right).tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]
    links = rng.integers(0, 30, (2, 40))
    some = jaccard._joining(*links, 30)
    joined = [components.forest(*(x[some] for x in links)), components.forest(*links)]
    assert all((a == b).all() for a, b in zip(*joined, strict=True)) and len(some) == len(joined[0][0])


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, one_task, monkeypatch):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(1, 40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    forest = [(i, i // 2) for i in range(1, 50)]
    got = {r.node: r.root for r in components.roots(spark.createDataFrame(forest, "node long, parent long")).collect()}
    assert got == {i: 0 for i in range(1, 50)}


def test_shingles():
    texts = ["", None, "a", "A b\x0bc d", "a b c d e f a b c d e f", "É a b c d e", "x\x85y z", *(" ".join(map(str, range(n))) for n in range(40))]
    got = shingles.shingle_sets(texts)
    assert [len(s) for s in got] == [len(sets_of(t)) for t in texts]
    again = shingles.shingle_sets(texts[::-1])[::-1]
    assert all((a == b).all() for a, b in zip(got, again, strict=True))
    assert len(np.intersect1d(shingles.shingle_sets(["a b c d e f"])[0], got[4])) == 2
    assert [len(shingles.shingle_sets([" ".join("abcdef"[:n])])[0]) for n in range(7)] == [0, 1, 1, 1, 1, 1, 2]
    assert [len(shingles.word_shingles(t or "")) for t in texts] == [len(sets_of(t)) for t in texts]
    x, y = thue_morse(2048)
    assert len(np.unique(np.concatenate(shingles.shingle_sets([x, y])))) == 2
