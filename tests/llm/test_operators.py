"""Every operator on strange rows and none, and against a plain version of what it promises."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from llm_data import DOCS, prose
from pyspark.sql import functions as F

from graphloom.llm import compression, hamming, packing, pieces, rules, runindex, simhash, spans, warc, wavelet
from graphloom.llm.components import components
from graphloom.llm.queries import PIECES, TOKENIZER, tokenizer_path


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# 1: wavelet
def test_wavelet_queries(tmp_path):
    rng = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 1), (7, 2), (1000, 49407), (600_000, 300)):
        ids = rng.integers(0, top, n)
        uri = f"file://{tmp_path}/{n}.wm"
        wavelet.put_file(uri, wavelet.build(ids, [None, 4], [n // 2, n - n // 2]))
        s = wavelet.Shard(uri)
        assert (s.ids() == ids).all() and s.doc_ids == [None, 4]
        for i in {0, n // 3, n - 1} if n else ():
            t = int(ids[i])
            at = np.flatnonzero(ids == t)
            assert s.access(i) == t and s.count(t) == len(at) and s.count(t, 3, n // 2) == ((at >= 3) & (at < n // 2)).sum()
            assert [s.occurrence(t, k) for k in (0, len(at) - 1)] == [at[0], at[-1]]
        assert s.count(10**6) == 0
        with pytest.raises(IndexError):
            s.access(n)
        s.close()
    (tmp_path / "bad").write_bytes(b"GLWM0001" + bytes(40))
    with pytest.raises(ValueError):
        wavelet.Shard(f"file://{tmp_path}/bad")


def test_tokens_are_the_librarys(odd):
    from tokenizers import Tokenizer

    path = tokenizer_path(TOKENIZER)
    tok = Tokenizer.from_file(path)
    got = [tuple(r) for r in wavelet.read_shards(wavelet.encode_shards(odd, path, shard_tokens=500)).collect()]
    want, start = [], 0
    for d, t in sorted(texts_of(odd), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode())):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_chunks_are_exact():
    from tokenizers import Tokenizer

    path = tokenizer_path(TOKENIZER)
    tok, chunks, rng = Tokenizer.from_file(path), wavelet._Chunks(path, 50), random.Random(3)
    parts = ["The", "don't", "'S", "a.b", "x.,", "..", "!.", "_.", "É", "İ", "Σας", "12.5", "²", "<|endoftext|>", "<|ENDOFTEXT|>", "\t", "\x1c", "　", "é", "😀", ",", ".", "naïve", "\n", "\r\n", "ﬁ", "½."]
    for _ in range(3000):
        t = "".join(rng.choice(parts) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(0, 8)))
        assert np.frombuffer(next(wavelet.tokens_of([t], chunks, 1)), "<u4").tolist()[:-1] == tok.encode(t, add_special_tokens=False).ids, t


# 2: spans
def test_spans(spark, odd):
    rng = random.Random(2)
    shared = prose(rng, 70)
    docs = [(i, prose(rng, 80) + "\n" + (shared + "\n" if i % 3 == 0 else "") + prose(rng, 40), "en", "s", 0) for i in range(12)]
    docs += [(50, docs[1][1], "en", "s", 0), (51, "Short one. Two.", "en", "s", 0), (52, "Short one. Two.", "en", "s", 0)]
    for df in (spark.createDataFrame(docs, DOCS), odd):
        got = defaultdict(list)
        for r in spans.dedup(df).collect():
            got[r["doc_id"]].append((r["n_sentences"], r["n_removed"], r["kept"]))
        first, n = {}, Counter()
        rows = [(d if d is not None else (1 << 63) - 1, d, t, xxhash.xxh64_intdigest(t.encode(), 42)) for d, t in texts_of(df)]
        rows = [(k, d, t, h - (1 << 64) if h >> 63 else h) for k, d, t, h in rows]
        for k, _, t, h in rows:
            for pos, *x in spans.runs(t, 2, 14):
                x = tuple(x)
                n[x] += 1
                first[x] = min(first.get(x, (k, pos, h)), (k, pos, h))
        want = defaultdict(list)
        for k, d, t, h in rows:
            starts = {pos for pos, *x in spans.runs(t, 2, 14) if (k, pos, h) != first[tuple(x)]}
            kept, m, gone = spans.without(t, starts, 2, 14)
            want[d].append((m, gone, kept))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    out = {r["doc_id"]: r for r in spans.dedup(spark.createDataFrame(docs, DOCS)).collect()}
    assert all(shared.split(". ")[1] not in out[i]["kept"] for i in (3, 6, 9)) and out[50]["kept"].strip() == ""
    assert out[0]["n_removed"] == 0 and out[2]["n_removed"] == 0 and out[52]["n_removed"] == 0


def test_runs_of_sentences():
    t = "A b c. D e. F g h i j. K. L m n o p q r s t u v w x y."
    at = lambda span, words: [r[0] for r in spans.runs(t, span, words)]
    assert at(2, 1) == [0, 1, 2, 3] and at(2, 11) == [0, 1, 2, 3] and at(1, 14) == [0, 1, 2, 3, 4] and at(4, 1) == [0, 1]
    assert spans.without(t, {1}, 2, 1)[0] == "A b c. K. L m n o p q r s t u v w x y."
    assert spans.without(t, {0}, 2, 11)[0] == "L m n o p q r s t u v w x y."
    assert spans.without(t, set(), 2, 11) == (t, 5, 0)
    same = spans.runs("One two THREE.  four\tfive six.\nseven", 2, 3)
    assert same[0][1:] == spans.runs("x. one two three. Four five six. y", 2, 3)[1][1:]


def test_sentences_cover_the_text():
    for t in ("", "a", "A b. C d! E?\nF", "\n\n", "x.y z.  w", "e.g. this"):
        cuts = spans.sentences(t)
        assert "".join(t[a:b] for a, b in cuts) == t


# 3: WARC
PAGES = "page_id long, url string, html string, sha string, n string, first string"


def test_warc(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"http://{'www.' * (i % 2)}h{i % 4}.example.org:{80 + i % 2}/p/{i % 7}?q={i % 3}", rng.choice([None, "", "same", prose(rng, 30), "é" * 3000]), "x", "y", "z") for i in range(60)]
    rows += [(7, rows[7][1], rows[7][2], "x", "y", "z"), (None, "http://null.example.org/", "same", "x", "y", "z"), (99, None, "no url", "x", "y", "z"), (100, "not a url\r\nX: y", "bad url", "x", "y", "z"), (101, "http://[bad", "worse", "x", "y", "z")]
    df = spark.createDataFrame(rows, PAGES)
    files = warc.index(warc.write(df, f"file://{tmp_path}/a", file_bytes=3000), f"file://{tmp_path}/i", block_rows=5)
    first = {}
    for p, _, h, *_ in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = []
    for p, _, h, *_ in rows:
        raw = (h or "").encode()
        again = p is not None and p > first[h or ""]
        want.append((p, len(raw), warc.digest_of(raw), "revisit" if again else "response", first[h or ""] if again else None))
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted((tuple(r) for r in warc.read(files).collect()), key=key) == sorted(want, key=key)
    some = rows[5]
    hits = warc.lookup(files, some[1])
    assert {h["page_id"] for h in hits} == {r[0] for r in rows if warc.url_key(r[1]) == warc.url_key(some[1])}
    assert warc.lookup(files, "http://nowhere.example.org/") == []
    one = warc.IndexFile(files.orderBy("first_key").first()["uri"])
    if len(one.directory) > 3:
        one.find(one.directory[2][0])
        assert one.reads <= 3  # blocks that can hold the key, not all


def test_warc_empty(spark):
    df = spark.createDataFrame([], PAGES)
    assert warc.read(warc.index(warc.write(df))).count() == 0


def test_warc_record_damage():
    m = warc.record(1, "http://a.example/", b"payload", None, "1970-01-01T00:00:00Z")
    assert warc.parse(m)["payload"] == b"payload" and warc.url_key("https://B.a.Example:443/x?y") == "example,a,b)/x?y"
    raw = zlib.decompress(m, 31).replace(b"payload\r", b"pAyload\r")
    with pytest.raises(ValueError):
        warc.parse(zlib.compress(raw, wbits=31))


# 4: run index
def plain_cut(rows, length, least_words=0, sure=0):
    seen = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for d, t in rows:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        for a, e in zip(edges[::2], edges[1::2], strict=True):
            if least_words and e - a < sure and len(t[a:e].split()) < least_words:
                gone[a:e] = False
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((d, len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    for _ in range(40):
        ts = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 6))})
        s = b"".join(t + b"\0" for t in ts)
        n = len(s)
        lcp = lambda i, j: next((k for k in range(n) if i + k >= n or j + k >= n or s[i + k] != s[j + k]), n)
        want = [max((lcp(i, j) for j in range(n) if j != i), default=0) for i in range(n)]
        assert runindex.RunIndex(ts).statistics().tolist() == want


@pytest.mark.parametrize(("length", "index_bytes"), [(400, 1 << 19), (40, 200), (20, 60)])
def test_cut(spark, odd, length, index_bytes):
    """Small indexes drive hot minimizers through all levels."""
    rng = random.Random(length)
    base = prose(rng, 400)
    docs = []
    for i in range(40):
        t = list(prose(rng, 120))
        for _ in range(2):
            at, a = rng.randrange(len(t)), rng.randrange(len(base) - 700)
            t[at:at] = base[a : a + 700]
        docs.append((i, "".join(t)))
    docs += [(100, base), (101, base), (102, base[:-1] + "é"), (103, "ab" * 600), (104, "z" * 1500), (105, "Sich " * 130 + "q" + "Sich " * 100), (106, "")]
    small = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], DOCS)
    for df in (small, odd.where("length(text) < 20000 OR text IS NULL")):
        got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in runindex.cut(df, length, index_bytes=index_bytes).collect()]
        want = plain_cut([(d, t.encode()) for d, t in texts_of(df)], length)
        key = lambda r: tuple((x is not None, str(x)) for x in r)
        assert sorted(got, key=key) == sorted(want, key=key)


def test_cut_of_passages(spark, odd):
    """Short strings that occur twice go only in stretches of enough words or bytes."""
    rng = random.Random(12)
    shared = [prose(rng, n).split()[:n] for n in (20, 40, 53, 56, 60, 120)]
    docs = [(i, prose(rng, 60) + " " + " ".join(shared[i % 6]) + " " + prose(rng, 60)) for i in range(18)]
    docs += [(50, "x" * 399), (51, "y" + "x" * 399), (52, "z" * 899), (53, "z" * 900), (54, "")]
    small = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], DOCS)
    for df in (small, odd.where("length(text) < 20000 OR text IS NULL")):
        got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in runindex.cut(df, 120, least_words=50, sure=900).collect()]
        key = lambda r: tuple((x is not None, str(x)) for x in r)
        assert sorted(got, key=key) == sorted(plain_cut([(d, t.encode()) for d, t in texts_of(df)], 120, 50, 900), key=key)
    kept = {r["doc_id"]: r["kept"] for r in runindex.cut(small, 120, least_words=50, sure=900).collect()}
    assert all((" ".join(shared[i % 6]) in kept[i]) == (i % 6 < 2) for i in range(18)) and kept[50] == "x" * 399


def test_runs_are_what_the_index_keeps():
    """Its size follows the runs, not the text, where copies repeat."""
    t = prose(random.Random(1), 200).encode()
    one, many = runindex.RunIndex([t]), runindex.RunIndex([t] * 20)
    assert len(many.symbols) < 1.2 * len(one.symbols) + 40 and many.lengths.sum() == many.n and one.lengths.sum() == one.n
    assert len(many.sampled) <= 2 * len(many.symbols)


def test_segments_of_parts():
    rng = random.Random(9)
    raw = prose(rng, 3000).encode()
    for part in (1 << 20, 1000, 401):
        mh, start, n, _ = runindex.segments(raw, 100, 400, part)
        assert n.sum() == len(raw) - 399 and (start[1:] == start[:-1] + n[:-1]).all() and n.max() <= runindex.PIECE


# 5: Hamming
@pytest.mark.parametrize("k", [1, 10])
def test_search(spark, k):
    rng = np.random.default_rng(k)
    v = rng.standard_normal((700, 64))
    v[100:130] = v[0]  # equal codes, one of them a query
    v[130:160] = v[0] + rng.standard_normal((30, 64)) * 0.05
    rows = [(i, [float(x) for x in v[i]], "clash", "clash") for i in range(700)]
    rows += [(701, None, "", ""), (None, rows[0][1], "", ""), (0, rows[0][1], "", ""), (800, [None, *rows[3][1][1:]], "", "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, q string, code string")
    got = sorted(tuple(r) for r in hamming.search(df, df.where("vec_id % 100 = 0"), k).collect())
    codes = {i: sum(1 << j for j, x in enumerate(e) if x is not None and x > 0) for i, e, *_ in rows if i is not None and e is not None}
    want = []
    for q in (i for i in codes if i % 100 == 0):
        near = sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items() if i != q)[:k]
        want += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    assert got == sorted(want)


def test_search_small_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, -1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in hamming.search(df, df, 5).collect()) == [(1, 1, 2, 1), (2, 1, 1, 1)]
    assert hamming.search(df.limit(0), df.limit(0), 5).count() == 0


def test_search_of_many_queries_broadcasts_no_probes(spark, monkeypatch):
    """Probes are hundreds of times the queries, whatever Spark expects: a round of many is joined by shuffles."""
    rounds, stored = [], hamming.stored

    def noted(df, what):
        if what == "best":
            rounds.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, what)

    monkeypatch.setattr(hamming, "stored", noted)
    v = np.random.default_rng(3).standard_normal((3000, 64))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in hamming.search(df, df.where("vec_id % 3 = 0"), 10).collect())
    code = np.packbits(v > 0, axis=1).view(np.uint64)[:, 0]
    want = []
    for q in range(0, 3000, 3):
        d = np.bitwise_count(code ^ code[q]).astype(int)
        d[q] = 65
        want += [(q, r + 1, int(i), int(d[i])) for r, i in enumerate(np.argsort(d, kind="stable")[:10])]
    assert got == want
    assert "BroadcastHashJoin" not in rounds[2] and "SortMergeJoin" in rounds[2]  # 1,000 queries, 7 segments, 36 masks


# 6: rules
def test_rule_features():
    assert rules.features("") == (0, 0, 0, 0, 0)
    assert rules.features("a b c a b c x") == (7, 7, 0, 0, 6)
    assert rules.features("a a a a") == (4, 4, 0, 0, 4)
    assert rules.features("x# y\nx# y\n \nx# y\r") == (6, 9, 3, 1, 6)
    assert rules.features("a\xa0b c")[0] == 2 and rules.features("é\x1cß")[1] == 3


def test_judge(spark, odd, none):
    got = {(r["doc_id"], r["n_words"], r["base_failed"], r["kept"]) for r in rules.judge(odd).collect()}
    for d, t in texts_of(odd):
        n, _, _, _, r = rules.features(t)
        assert any(g[0] == d and g[1] == n and g[2] == (n < 50 or 100 * r > 50 * n) for g in got)
    assert rules.judge(odd).count() == odd.count() and rules.judge(none).count() == 0
    rng = random.Random(1)
    docs = [(i, prose(rng, 80) if i % 10 else "bad", "en", f"good{i % 4}", 0) for i in range(80)]
    docs += [(100 + i, "bad" if i % 10 else prose(rng, 80), "en", "awful", 0) for i in range(40)]
    docs += [(200, "bad", "en", "rare", 0), (201, prose(rng, 80), "en", "rare2", 0), (202, prose(rng, 80), "en", None, 0)]
    out = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(docs, DOCS)).collect()}
    assert not out[100]["kept"] and not out[100]["base_failed"]  # its host goes
    assert out[1]["kept"] and out[201]["kept"] and out[202]["kept"] and not out[200]["kept"]


# 7: classifier
def test_classifier(spark, odd, none):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        t = prose(rng, rng.randint(40, 200))
        if not good:
            t = " ".join(w + rng.choice(["###", "$$$", "***"]) for w in t.split())
        docs.append((i, t, "en", "s", 0))
        labels.append((i, int(good), 0))
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = compression.fit(d, lab)
    out = compression.score(d, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == labels[r["doc_id"]][1] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    strange_out = compression.score(odd, model).collect()
    assert len(strange_out) == odd.count() and all(0 <= r["score"] <= 1 for r in strange_out)
    assert compression.score(none, model).count() == 0
    # labels of the held-out fifth don't matter
    flipped = lab.withColumn("quality", F.when(F.expr(compression.HELD_OUT), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert [r["score"] for r in compression.score(d, compression.fit(d, flipped)).orderBy("doc_id").collect()] == pytest.approx([r["score"] for r in compression.score(d, model).orderBy("doc_id").collect()])
    assert compression.fit(d, lab.where("quality = 1")) is None
    unlearnt = compression.score(d, None).collect()
    assert len(unlearnt) == 400 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in unlearnt)


def test_classifier_learns_from_long_and_repeated_rows(spark):
    """Long labelled texts don't all go to the driver, and a row that is repeated is learnt from once."""
    rng = random.Random(29)
    rows = [(i, f"{prose(rng, 40)} {'good' if i % 2 else 'b#d'} {rng.randbytes(20_000).hex()}", "en", "s", 0) for i in range(400)]
    d = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    conf = spark.sparkContext._jsc.sc().conf()
    before = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "6m")  # the texts have 16 MB, those that are taken 2
    try:
        model = compression.fit(d, lab, most_bytes=1 << 20)
    finally:
        conf.set("spark.driver.maxResultSize", before)
    assert model == compression.fit(d.unionByName(d).unionByName(d), lab, most_bytes=1 << 20)


# 8: SimHash
def plain_classes(fps):
    """The smallest id reachable by links of at most two bits."""
    ids = list(fps)
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (ids[i][1] ^ ids[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, f, least.get(find(i))) for i, (d, f) in enumerate(ids)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("large", [256, 3])
def test_links(spark, large):
    """Chains and balls of fingerprints, with and without the way for large keys."""
    rng = random.Random(8)
    fps = [0, (1 << 64) - 1]
    for _ in range(6):
        x = rng.getrandbits(64)
        fps.append(x)
        for _ in range(12):
            x ^= (1 << rng.randrange(64)) ^ (rng.random() < 0.6) * (1 << rng.randrange(64))
            fps.append(x)
        fps += [fps[-1] ^ (1 << b) for b in rng.sample(range(64), 8)]
        fps.append(fps[-1] ^ 7 << rng.randrange(60))
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r["node"] & ((1 << 64) - 1): r["root"] for r in components(simhash.links(df, large)).collect()}
    want = defaultdict(set)
    for d, f, c in plain_classes([(i, f) for i, f in enumerate(fps)]):
        want[c].add(f)
    mine = defaultdict(set)
    for f in fps:
        mine[got.get(f, signed(f))].add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_classes(odd, none):
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    got = [tuple(r) for r in simhash.classes(odd).collect()]
    want = [(d, signed(f), c) for d, f, c in plain_classes([(d, simhash.fingerprint(t)) for d, t in texts_of(odd)])]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert simhash.classes(none).count() == 0


def test_fingerprint():
    assert simhash.fingerprint("") == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42) == simhash.fingerprint("a\tB")
    assert simhash.fingerprint("a b c") == xxhash.xxh64_intdigest(b"a b c", 42)
    h = [xxhash.xxh64_intdigest(x, 42) for x in (b"a b c", b"b c d")]
    assert simhash.fingerprint("a b c d") == h[0] & h[1]  # over half of two is both


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == got[500] == 500


# 9: packing
def test_pack(spark, none):
    rng = random.Random(6)
    rows = [(i, rng.choice([0, None, 1, 30, 64, 65, 200, rng.randint(1, 64)]), rng.choice(["hot", "hot", "a", "b", None]), rng.choice([1, 1, 2, None, 100 + i])) for i in range(900)]
    rows += [(None, 5, "a", 7), (3, 9, "b", 7), (3, 9, "b", 7)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster long")
    out = packing.pack(df, capacity=64, most_per_source=2, shard_rows=300).collect()
    assert sum(r["n_tokens"] for r in out) == sum(max(1, n or 1) for _, n, _, _ in rows)
    bins = defaultdict(list)
    for r in out:
        bins[r["bin_id"]].append(r)
    about = {d: (s, c) for d, _, s, c in rows}
    for rs in bins.values():
        rs.sort(key=lambda r: r["bin_offset"])
        at = 0
        for r in rs:
            assert r["bin_offset"] == at
            at += r["n_tokens"]
        assert at == rs[0]["bin_used"] <= 64
        if any(r["doc_id"] is None for r in rs):
            continue
        assert max(Counter(about[r["doc_id"]][0] for r in rs if about[r["doc_id"]][0]).values(), default=0) <= 2
        assert max(Counter(about[r["doc_id"]][1] for r in rs if about[r["doc_id"]][1] is not None and r["n_tokens"] < 64).values(), default=0) <= 1
    assert packing.pack(none.selectExpr("doc_id", "n_chars AS n_tokens", "source", "doc_id AS cluster", "1 AS h", "2 AS g")).count() == 0
    assert sorted(map(str, out)) == sorted(map(str, packing.pack(df.repartition(7), capacity=64, most_per_source=2, shard_rows=300).collect()))


@pytest.mark.parametrize("shard_rows", [400, 60])
def test_every_choice_of_a_group_is_the_best_fit(spark, shard_rows):
    """Each group is replayed against all its bins: the tightest compatible one, or none and a new bin."""
    rng = random.Random(shard_rows)
    rows = [(i, rng.choice([0, 1, 30, 64, 65, 200, *(rng.randint(1, 64) for _ in range(9))]), rng.choice(["hot", "hot", "a", "b", None]), rng.choice([1, 1, 2, None, 100 + i // 2])) for i in range(350)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster long"), 64, 2, shard_rows).collect()
    groups = defaultdict(dict)
    for r in out:
        groups[r["bin_id"] >> 32][r["doc_id"], r["piece"]] = (r["bin_id"], r["bin_offset"], r["n_tokens"])
    assert len(groups) == -(-350 // shard_rows)
    about = {d: (max(1, n), s, c) for d, n, s, c in rows}
    for placed in groups.values():
        docs = {d for d, _ in placed}
        used, sources, clusters = {}, defaultdict(list), defaultdict(set)
        for d in sorted(docs, key=lambda d: packing.order((d, *about[d]), 64)):
            n, s, c = about[d]
            for piece in range(-(-n // 64)):
                b, at, size = placed[d, piece]
                whole = size == 64
                fits = [x for x, u in used.items() if size <= 64 - u and (s is None or sources[x].count(s) < 2) and (whole or c is None or c not in clusters[x])]
                if b in used:
                    assert at == used[b] and b in fits and used[b] == max(used[x] for x in fits)
                else:
                    assert not fits and at == 0
                used[b] = at + size
                sources[b].append(s)
                if not whole:
                    clusters[b].add(c)


def test_sequences_hold_the_ids(spark):
    from tokenizers import Tokenizer

    rng, path = random.Random(13), tokenizer_path(TOKENIZER)
    docs = spark.createDataFrame([(i, prose(rng, rng.choice([0, 3, 40, 300])) if i % 9 else None, "en", f"s{i % 3}", 0) for i in range(60)], DOCS)
    placed = packing.pack(packing.measured(docs, path), 100, 2, 25)
    bins = {r["bin_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.sequences(docs, path, placed, 100).collect()}
    tok, back = Tokenizer.from_file(path), defaultdict(list)
    for r in sorted(placed.collect(), key=lambda r: (r["doc_id"], r["piece"])):
        assert r["bin_used"] == len(bins[r["bin_id"]]) <= 100
        back[r["doc_id"]] += bins[r["bin_id"]][r["bin_offset"] : r["bin_offset"] + r["n_tokens"]]
    assert dict(back) == {d: [*tok.encode(t, add_special_tokens=False).ids, 1] for d, t in texts_of(docs)}


def test_best_fit_is_tightest_compatible():
    p = packing.Packer(10, 1)
    assert [p.add(6, 0, None), p.add(5, 1, None), p.add(8, 2, None)] == [(0, 0), (1, 0), (2, 0)]
    assert p.add(2, 2, None) == (0, 6)  # the bin with room 2 holds source 2 already; room 4 is next
    assert p.add(2, 3, 0) == (2, 8) and p.add(2, 4, 0) == (0, 8) and p.add(3, 5, 0) == (1, 5)
    assert p.add(2, 6, 0) == (3, 0)  # cluster 0 is in bin 1
    assert p.add(10, 7, None) == (4, 0)


def test_measured(odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    got = packing.measured(odd, tokenizer_path(TOKENIZER)).collect()
    want = [(d, len(tok.encode(t, add_special_tokens=False).ids) + 1) for d, t in texts_of(odd)]
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=str) == sorted(want, key=str)
    of = defaultdict(set)
    for r in got:
        of[r["doc_id"]].add(r["cluster"])
    assert of[5] == of[6] == of[7] and of[5] != of[4] and None in of[None] and of[1] == of[2] == of[3] == {None}
    assert packing.measured(none, tokenizer_path(TOKENIZER)).count() == 0


# 10: SentencePiece
def test_pieces_are_the_librarys(odd, none):
    import sentencepiece

    path = tokenizer_path(PIECES)
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    got = [(r["doc_id"], r["n_pieces"], r["ids_crc32"], r["round_trip"]) for r in pieces.encode(odd, path).collect()]
    want = []
    for d, t in texts_of(odd):
        ids = lib.encode(t)
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert pieces.encode(none, path).count() == 0
    rng, codec = random.Random(2), pieces.Codec(path)
    for _ in range(3000):
        t = "".join(rng.choice("abcdeinorst étç ñ\n\t▁  .,!#@漢字😀 ΣAB'0129<>s") for _ in range(rng.randint(0, 30)))
        ids = codec.encode([t])[0]
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t)
        assert codec.decode(ids) == lib.decode(np.frombuffer(ids, "<u4").tolist())


def unigram_file(path, rng, fallback):
    """A unigram model written by hand: letters, and made-up pieces with scores that seldom tie."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    kinds = pb.ModelProto.SentencePiece
    add = lambda piece, score, kind: m.pieces.add(piece=piece, score=score, type=kind)
    add("<unk>", 0, kinds.UNKNOWN)
    add("<s>", 0, kinds.CONTROL)
    add("</s>", 0, kinds.CONTROL)
    for b in range(256 if fallback else 0):
        add(f"<0x{b:02X}>", 0, kinds.BYTE)
    names = {"▁", *"abcdé"}
    while len(names) < 150:
        names.add(rng.choice(["", "▁"]) + "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))))
    for x in sorted(names):
        add(x, -rng.uniform(2, 12) - (len(x) == 1), kinds.NORMAL)
    m.trainer_spec.model_type = 1
    m.trainer_spec.byte_fallback = fallback
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.add_dummy_prefix = True
    m.normalizer_spec.remove_extra_whitespaces = False
    m.normalizer_spec.escape_whitespaces = True
    path.write_bytes(m.SerializeToString())
    return str(path)


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_walk_is_the_best_path(spark, tmp_path, fallback):
    """Forward scores shared by prefixes give the library's ids and the score of a Viterbi over each whole text."""
    import sentencepiece

    rng = random.Random(14)
    path = unigram_file(tmp_path / "unigram.model", rng, fallback)
    lib, codec = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Codec(path)
    texts = ["".join(rng.choice("abcdé  ") for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", " ", "abz", "zz a", "漢b"]
    got = codec.encode(texts)
    for t, ids in zip(texts, got, strict=True):
        ids = np.frombuffer(ids, "<u4").tolist()
        assert ids == lib.encode(t) or "zz" in t, t
        if t and not set(t) - set("abcdé "):
            s = "▁" + t.replace(" ", "▁")
            best = [0.0] + [None] * len(s)
            for i in range(1, len(s) + 1):
                best[i] = max(best[j] + codec.scores[s[j:i]] for j in range(max(0, i - 7), i) if s[j:i] in codec.scores and best[j] is not None)
            assert sum(codec.scores[codec.names[x]] for x in ids) == pytest.approx(best[-1])
    shared = sorted({"▁" + "".join(rng.choice("ab") for _ in range(6)) for _ in range(60)})
    before = codec.states
    list(codec.walk(shared))
    assert codec.states - before == len({w[:k] for w in shared for k in range(1, len(w) + 1)})  # a state for each node of the trie
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    out = {r["doc_id"]: r["n_pieces"] for r in pieces.encode(rows, path).collect()}
    assert out == {i: len(x) // 4 for i, x in enumerate(got)}


def test_prefixes_are_shared():
    codec = pieces.Codec(tokenizer_path(PIECES))
    words = ["▁consider", "▁considerable", "▁considerably", "▁considered"]
    assert len(list(codec.walk(words))) == 4
    assert codec.states == len("▁considerable") + 1 + 2  # y after considerabl, ed after consider


def test_spans_of_few_words_and_whole_copies(spark):
    short = "En la. Des et. Ok now. Les."
    long = "This one sentence has more than fourteen words so that it can be found all by itself."
    rows = [(1, f"Alpha begins here. {short} Beta ends this."), (2, f"Gamma comes first. {short} Delta is the last."), (3, f"Some other words. {long} Nothing like it."), (4, f"Different start. {long} Different end.")]
    rows += [(5, "Tiny text. Two."), (6, "Tiny text. Two."), (7, "Single."), (8, "Single."), (9, "Aa bb. Cc dd. Ee."), (10, "Aa bb. Cc dd. Ee."), (11, "Quite new. So it. Is it. Bye now. Farewell."), (12, "An old one. So be. It is. Bye now. Farewell.")]
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOCS)
    out = {r["doc_id"]: r["kept"].split(".") for r in spans.dedup(df, fixed=3).collect()}
    text = {d: ".".join(t).strip() for d, t in out.items()}
    assert text[2] == "Gamma comes first. Delta is the last." and text[4] == "Different start. Different end."
    assert text[6] == text[8] == text[10] == "" and text[12] == "An old one. So be. It is."
    assert all(text[d] == dict(rows)[d] for d in (1, 3, 5, 7, 9, 11))


def test_left_out_runs_change_nothing():
    """Against all runs: fixed ones, those of enough words, single long ones and tails."""
    rng = random.Random(4)
    for _ in range(300):
        texts = [". ".join(rng.choice(("a", "b c", "d e f g h i j", "k l m n o p q", "r " * 14 + "s")) for _ in range(rng.randint(1, 8))) + "." for _ in range(3)]
        gone = []
        for plain in (False, True):
            seen, all_gone = {}, set()
            for d, t in enumerate(texts):
                keys = [spans.key(t[a:b]) for a, b in spans.sentences(t)]
                n = len(keys)
                size = lambda i, j, k=keys: sum(x.count(b" ") + 1 for x in k[i:j])
                which = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if j - i == 3 or (i, j) == (max(0, n - 2), n) or size(i, j) >= 14 and (j - i <= 2 or size(i, j - 1) < 14)] if plain else spans.every_run(keys, 3, 2, 14)
                for i, j in sorted(which):
                    if seen.setdefault(tuple(keys[i:j]), (d, i)) != (d, i):
                        all_gone |= {(d, x) for x in range(i, j)}
            gone.append(all_gone)
        assert gone[0] == gone[1], texts


def test_every_query_on_empty_tables(spark, tmp_path):
    from graphloom.llm.queries import queries

    kinds = {"documents": DOCS, "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string", "embeddings": "vec_id long, embedding array<float>, label int"}
    for name, kind in kinds.items():
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries().items():
        assert query(spark, str(tmp_path)).collect() == [], name
