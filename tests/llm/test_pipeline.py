"""The pipeline against its stages by brute force."""

import random
import re
import zlib

import pytest
from test_jaccard import brute as components_brute
from test_pack import pieces
from test_rows import secrets_brute

import corpus_pipeline
from weftline.llm import linear


def masked(text):
    out, at = [], 0
    for s in secrets_brute(text):
        a, b = map(int, s.split(":")[1:])
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(240):
        kind = i % 6
        text = " ".join(rng.choice(words) for _ in range(rng.randint(8, 60)))
        if kind == 0:
            text = " ".join(w + "%%%" for w in text.split())  # junk
        elif kind == 1:
            text += " password: hunter2hunter2"
        elif kind == 2 and i > 20:
            text = docs[i - 11][1]  # copies
        elif kind == 3 and i > 20:
            text = docs[i - 1][1].rsplit(" ", 1)[0]  # near copies
        docs.append((i, text))
    docs += [(900, None), (901, ""), (902, "long words " * 4000)]
    folder = str(tmp_path_factory.mktemp("data"))
    rows = [(i, t, "en", "src0", len(t or ""), "extra") for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, name string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 6 != 0), 0) for i in range(240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs


def test_pipeline(spark, corpus):
    folder, docs = corpus
    model = linear.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), "quality", *linear.QUALITY)
    rows = [(i, t) for i, t in docs if model.score(t) >= corpus_pipeline.QUALITY]
    assert len(docs) - 60 <= len(rows) < len(docs)
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i, t))
    rows = sorted(min(g)[1:] for g in groups.values())
    rows = [(i, t) for (i, t), (_, _, c) in zip(rows, sorted(components_brute(rows), key=lambda r: r[0]), strict=True) if i == c]
    rows = [(i, t if t is None else masked(t)) for i, t in rows]
    got = corpus_pipeline.run(spark, folder)
    want = sorted(pieces(rows, 4096))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got.collect()) == want


def test_stages_keep_columns(spark, corpus):
    folder, docs = corpus
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, folder).columns == frame.columns
        assert stage(spark, frame.limit(0), folder).columns == frame.columns
    by_id = {r.doc_id: r for r in corpus_pipeline.mask_secrets(spark, frame, folder).collect()}
    assert len(by_id) == len(docs) and by_id[900].text is None
    assert by_id[1].text.endswith("[SECRET]") and by_id[1].n_chars == len(by_id[1].text)
    assert zlib.crc32(by_id[4].text.encode()) == zlib.crc32(docs[4][1].encode())


def test_run_with_nulls_and_repeated_ids(spark, corpus, tmp_path):
    """Where ids repeat or are null, rows are told apart: what is no copy stays."""
    rng = random.Random(4)
    folder, _ = corpus
    base = [f"w{rng.randrange(300)}" for _ in range(80)]
    other = " ".join(f"w{rng.randrange(300)}" for _ in range(60))
    near = " ".join([*base[:-1], "changed"])
    rows = [(3, " ".join(base)), (5, near), (5, other), (5, other), (None, near + " x"), (None, None), (7, None), (8, ""), (5, other + " password: hunter2hunter2 " + " ".join(f"v{i}" for i in range(40)))]
    made = [(i, t, "en", "src0", len(t or ""), "extra") for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, name string"
    for name, table in (("full", made), ("none", made[:0])):
        spark.createDataFrame(table, schema).repartition(2).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = sorted(((r.doc_id, r.ids_crc32) for r in corpus_pipeline.run(spark, f"{tmp_path}/full").collect()), key=str)
    want = [(3, rows[0][1]), (5, other), (5, masked(rows[-1][1])), (None, near + " x"), (7, None)]
    assert got == sorted(((i, p[4]) for i, t in want for p in pieces([(i, t)], 4096)), key=str)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
