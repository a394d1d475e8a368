"""The pipeline, stage by stage, against plain versions; and its registration."""

import hashlib
import random

import numpy as np
import pytest
from llm_data import DOCS, prose
from pyspark.sql import functions as F
from test_operators import plain_classes, plain_cut
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import compression, rules, similar, simhash
from graphloom.llm.queries import TOKENIZER, tokenizer_path


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rng = random.Random(11)
    passage = prose(rng, 90)
    docs, labels = [], []
    for i in range(300):
        t = prose(rng, rng.randint(60, 200))
        good = i % 4 > 0
        if not good:
            t = " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in t.split())
        elif i % 10 == 1:
            t = t + "\n" + passage + "\n" + prose(rng, 60)
        docs.append((i, t, "en", f"s{i % 5}", len(t)))
        labels.append((i, int(good), 0))
    docs += [(400 + i, docs[i][1], "en", "copy", docs[i][4]) for i in (1, 2, 3, 5, 6, 7, 9)]
    docs += [(500, "too short", "en", "s1", 9), (501, None, None, None, None), (502, "", "en", "s1", 0)]
    spark.createDataFrame(docs, DOCS).withColumn("kept", F.lit("clash")).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    now = {r["doc_id"]: r for r in docs.collect()}
    names = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        names.append(name)
        out = stage(spark, docs, sf)
        got = out.collect()
        if k < 4:
            assert out.columns == columns
            after = {r["doc_id"]: r for r in got}
            assert len(after) == len(got)
        if k == 0:
            want = {d for d, r in now.items() if (x := rules.features(r["text"] or ""))[0] >= 50 and 100 * x[4] <= 50 * x[0]}
            assert set(after) == want and 500 not in after
        elif k == 1:
            model = compression.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
            scores = dict(zip(now, compression.Scorer(model).scores([r["text"] for r in now.values()]), strict=True))
            assert set(after) == {d for d, s in scores.items() if s >= 0.3}
            assert not any(d < 300 and d % 4 == 0 for d in after) and sum(d < 300 for d in after) > 200
        elif k == 2:
            classes = plain_classes([(d, simhash.fingerprint(r["text"])) for d, r in now.items()])
            assert set(after) == {d for d, _, c in classes if d == c} and not any(400 <= d < 410 for d in after)
        elif k == 3:
            want = {d: (n, h) for d, n, _, _, h in plain_cut([(d, r["text"].encode()) for d, r in now.items()], 240, 50, 400)}
            assert set(after) == set(want)
            for d, r in after.items():
                assert hashlib.sha256(r["text"].encode()).hexdigest() == want[d][1] and r["n_chars"] == len(r["text"])
                assert now[d].asDict() | {"text": 0, "n_chars": 0} == r.asDict() | {"text": 0, "n_chars": 0}
            assert any(len(after[d]["text"]) < len(now[d]["text"]) for d in after)
        else:
            tok = Tokenizer.from_file(tokenizer_path(TOKENIZER))
            assert sum(r["n_tokens"] for r in got) == sum(len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in now.values())
            assert {r["doc_id"] for r in got} == set(now)
        if k < 4:
            now = after
            path = f"{sf}/stage{k}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
    assert names == ["quality_rules", "quality_classifier", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]


def test_run_and_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in __spark_entry__.queries() if q.startswith("op") and q[2].isdigit()}
    assert corpus_pipeline.run(spark, sf).count() > 150


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_cut_characters_vanish(spark):
    """Bytes left of a character whose other bytes went are no text."""
    shared = "é" * 200  # 400 bytes
    rows = [(1, "aé" + shared[:-1] + "ê", "en", "s", 0), (2, "bè" + shared[:-1] + "ê", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, df, "").collect()}
    assert out[1] in ("a", "aé") and out[2] in ("b", "bè") and all("�" not in t for t in out.values())


def plain_near(rows, words=5):
    """The smallest id of each component of texts whose shingle sets have a Jaccard similarity of 0.8 or more."""
    sets = {d: set(zip(*((t or "").lower().split()[i:] for i in range(words)), strict=False)) for d, t in rows}
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return root


def test_passages_of_fifty_words_go(spark):
    """A passage of over 50 words, shorter than 400 bytes, goes from every text; one of 40 words stays."""
    rng = random.Random(31)
    long, short = (" ".join(x[:4] for x in prose(rng, n).split()) for n in (53, 40))
    assert 240 < len(long) < 400
    rows = [(i, f"{prose(rng, 70)} {long if i < 3 else short} {prose(rng, 70)}") for i in range(6)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DOCS)
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert all(long not in out[i] and len(out[i]) > 500 for i in range(3)) and all(out[i] == dict(rows)[i] for i in range(3, 6))


def test_variants_cover_the_radius():
    """Whatever bits differ, some variant's key agrees and its piece differs in one bit at most."""
    rng = random.Random(3)
    for n in (10, 600_000, 10**7, 10**9, 10**11):
        cut = similar.variants(9, n)
        assert sum(bits for *_, bits, _ in cut) == 64
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a ^ sum(1 << i for i in rng.sample(range(64), 9))
            met = [(a ^ b) >> at & ((1 << bits) - 1) for k, mask, at, bits, _ in cut if (a >> k & mask) == (b >> k & mask)]
            assert any(x.bit_count() <= 1 for x in met)


def test_bitmaps_never_drop_a_similar_pair():
    rng = random.Random(5)
    for _ in range(300):
        a = {rng.getrandbits(64) for _ in range(rng.randint(1, 400))}
        b = set(rng.sample(sorted(a), rng.randint(0, len(a)))) | {rng.getrandbits(64) for _ in range(rng.randint(0, 60))}
        x, y = (int.from_bytes(similar.parity(np.array(sorted(s), np.uint64)), "big") for s in (a, b))
        assert (x ^ y).bit_count() <= len(a ^ b)


@pytest.mark.parametrize(("whole", "block"), [(1500, 1 << 14), (4, 1 << 14), (4, 5)])
def test_near_copies_of_a_few_edits_go(spark, monkeypatch, whole, block):
    monkeypatch.setattr(similar, "WHOLE", whole)
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(17)
    rows = []
    for k in range(12):
        base = prose(rng, 240).split()
        rows.append((100 * k, " ".join(base)))
        for edits in (1, 2, 3, 4, 5, 9, 20):
            t = list(base)
            for i in rng.sample(range(len(t)), edits):
                t[i] = f"edit{rng.randrange(10**6)}"
            rows.append((100 * k + edits, " ".join(t)))
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DOCS)
    root = plain_near(rows)
    want = {d for d, r in root.items() if d == r}
    assert all({100 * k, 100 * k + 20} <= want and 100 * k + 4 not in want for k in range(12))
    out = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in out) == sorted(want)


def test_one_row_of_repeated_rows_and_null_ids(spark):
    rng = random.Random(23)
    a, b, c, d, e = (prose(rng, 150) for _ in range(5))
    near = c.replace(c.split()[70], "edit", 1)
    rows = [(1, a, "en", "s", 0)] * 5 + [(None, b, "en", "s", 0)] * 3 + [(None, c, "en", "s", 0), (None, near, "en", "s", 0)]
    rows += [(9, d, "en", "s", 0), (None, d, "en", "s", 0), (4, e, "en", "x", 0), (4, e, "en", "y", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    kept_c = [t for _, t in got if t in (c, near)]
    assert len(kept_c) == 1
    assert got == sorted([(1, a), (None, b), (None, kept_c[0]), (9, d), (4, e)], key=str)
    whole = {r["text"] for r in corpus_pipeline.repeated_passages(spark, out, "").collect()}
    assert {a, b, d, e} <= whole  # the next stage finds no repetition to cut


def test_near_duplicates_of_strange_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    out = [(r["doc_id"], r["text"] or "") for r in corpus_pipeline.near_duplicates(spark, odd, "").collect()]
    folded = lambda t: tuple(t.encode().lower().split())
    assert len(out) == len({folded(t) for _, t in rows}) == len({folded(t) for _, t in out})
    assert corpus_pipeline.near_duplicates(spark, none, "").count() == 0
