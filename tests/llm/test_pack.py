import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftline.llm import lengths, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
REAL = Tokenizer.from_file(PATH)


def ids(text):
    return [*REAL.encode(text or "", add_special_tokens=False).ids, 1]


def pieces(rows, capacity):
    for doc_id, text in rows:
        all_ids = ids(text)
        for n, at in enumerate(range(0, len(all_ids), capacity)):
            part = all_ids[at : at + capacity]
            yield doc_id, n, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))


def test_best_fit():
    rng = random.Random(5)
    for _ in range(30):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(0, 200))]
        bins = pack.best_fit(sizes, 50)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 50 for b in bins)
        free = []
        for size in sorted(sizes, reverse=True):
            fits = [r for r in free if r >= size]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - size)
            else:
                free.append(50 - size)
        assert len(bins) == len(free)


def test_plan_by_size():
    rng = random.Random(8)
    for _ in range(60):
        sizes = [rng.choice([3, 7, 11, *range(1, 51)]) for _ in range(rng.randint(0, 400))]
        counts = {n: sizes.count(n) for n in set(sizes)}
        bins = defaultdict(list)
        for size, rank, ranks, first, each, base in pack.plan_by_size(counts, 50):
            for k in range(ranks):
                bins[first + k // each].append((base + size * (k % each), size, rank + k))
        assert sorted((size, rank) for b in bins.values() for _, size, rank in b) == sorted((n, r) for n, c in counts.items() for r in range(c))
        for spans in bins.values():
            spans.sort()
            assert spans[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(spans, spans[1:]))
            assert spans[-1][0] + spans[-1][1] <= 50
        assert len(bins) == len(pack.best_fit(sizes, 50))


@pytest.mark.parametrize(("task_items", "gain"), [(60, 0.02), (60, 1.0)])
def test_packing_of_many_tasks_is_near_the_least(spark, task_items, gain, monkeypatch):
    monkeypatch.setattr(pack, "TASK_ITEMS", task_items)
    monkeypatch.setattr(pack, "LEAST_GAIN", gain)
    rng = random.Random(7)
    rows = [(i, "word " * int(rng.paretovariate(1.1) * 12)) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = pack.best_fit_pack(docs, PATH, capacity=1024).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(pieces(rows, 1024))
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 1024
    assert len(bins) <= 1.02 * -(-sum(r.length for r in got) // 1024) + 1


@pytest.mark.parametrize(("task_items", "gain"), [(50_000, 0.02), (7, 0.02), (7, 1.0)])
def test_packing(spark, task_items, gain, monkeypatch):
    monkeypatch.setattr(pack, "TASK_ITEMS", task_items)
    monkeypatch.setattr(pack, "LEAST_GAIN", gain)
    rng = random.Random(3)
    rows = [(i, " ".join(["word"] * rng.randint(0, 40))) for i in range(120)] + [(500, None), (501, ""), (None, "two words"), (502, "long " * 300), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, members string").repartition(5)
    got = pack.best_fit_pack(docs, PATH, capacity=64).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(pieces(rows, 64), key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(bins) <= 1.25 * total / 64 + 3
    assert pack.best_fit_pack(docs.limit(0), PATH).collect() == []


def test_histogram(spark):
    texts = ["a b c", "a b c", None, "", "one", "x " * 1000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, docs int")
    counts = [len(ids(t)) - 1 for t in texts]
    hist = lengths.length_histogram(docs, PATH)
    rows = lengths.suffix_sums(hist).collect()
    assert {r.n_tokens for r in rows} == set(counts)
    for r in rows:
        n = r.n_tokens
        assert r.docs == counts.count(n) and r.docs_at_least == sum(c >= n for c in counts)
        assert r.tokens_at_least == sum(c for c in counts if c >= n)
        assert r.truncated_tokens == sum(min(c, n) for c in counts) and r.lost_tokens == sum(max(0, c - n) for c in counts)
        assert r.share_up_to == sum(c <= n for c in counts) / len(counts) and r.all_docs == len(counts)
    got = {r.context_limit: (r.truncated_tokens, r.docs_cut) for r in lengths.truncated_totals(hist, [0, 2, 10**6]).collect()}
    assert got == {n: (sum(min(c, n) for c in counts), sum(c > n for c in counts)) for n in (0, 2, 10**6)}
    quantiles = {r.share: r.n_tokens for r in lengths.quantile_lengths(lengths.suffix_sums(hist), [0.5, 1.0]).collect()}
    assert quantiles == {0.5: sorted(counts)[2], 1.0: max(counts)}
    empty = lengths.length_histogram(docs.limit(0), PATH)
    assert lengths.suffix_sums(empty).collect() == [] and lengths.truncated_totals(empty, [5]).first().truncated_tokens == 0
    assert lengths.quantile_lengths(lengths.suffix_sums(empty), [0.5]).collect() == []
