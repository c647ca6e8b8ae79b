"""Mixing, vectors, classifiers, packing, archives and the pipeline."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaview.llm import embedding_dedup as ed
from deltaview.llm import packing as pk
from deltaview.llm import quality as ql
from deltaview.llm import toxicity as tx
from deltaview.llm import warc
from deltaview.llm._store import Scratch
from deltaview.llm.mixing import Target, exponent, mix, mixed_documents

DOCS = "doc_id long, text string, source string, tokens long, s string, blocks int, rank int, text_node string"


def docs(spark, items):
    return spark.createDataFrame([(i, t, s, 1, "s", 1, 1, "x") for i, t, s in items], DOCS)


# --- mixing ---


def corpus(n=300):
    rng = random.Random(1)
    return [(i, " ".join("w" for _ in range(rng.randrange(1, 40))), "hot" if i % 3 == 0 else rng.choice(["a", "b", None])) for i in range(n)] + [(n, None, "a"), (n + 1, "", "tiny")]


def test_exponent_meets_targets(spark):
    shares = spark.createDataFrame([(100.0,), (10.0,), (1.0,)], "tokens double")
    p = np.array([100.0, 10.0, 1.0]) / 111

    def entropy(a):
        q = p**a / (p**a).sum()
        return -(q * np.log(q)).sum()

    a = exponent(shares, Target(entropy=0.9))
    assert abs(entropy(a) - 0.9) < 1e-4 and entropy(a) >= 0.9 - 1e-9
    a = exponent(shares, Target(repetitions=4.0))
    assert abs(100 ** (1 - a) - 4.0) < 1e-3 and 100 ** (1 - a) <= 4.0 + 1e-9
    assert exponent(shares, Target(entropy=5.0)) == 0.0 and exponent(shares, Target(repetitions=1.0)) == 1.0
    assert exponent(shares.limit(0), Target(entropy=1.0)) == 1.0


def test_mixture_realises_the_weights(spark):
    items = corpus()
    d = docs(spark, items)
    got = mix(d, Target(repetitions=3.0), block_tokens=64).collect()
    size = {i: max(1, len((t or "").split())) for i, t, _ in items}
    total, read, reads = {}, {}, {}
    for i, _, s in items:
        total[s] = total.get(s, 0) + size[i]
    for r in got:
        assert r["_mix_tokens"] == size[r["_mix_id"]]
        read[r["_mix_source"]] = read.get(r["_mix_source"], 0) + r["_mix_tokens"]
        reads.setdefault(r["_mix_id"], []).append(r["_mix_epoch"])
    assert set(reads) == set(size), "every document is read"
    assert all(sorted(e) == list(range(len(e))) and len(e) <= 3 for e in reads.values())
    weight = {r["_mix_source"]: r["_mix_weight"] for r in got}
    assert abs(sum(weight.values()) - 1) < 1e-9
    scale = read["hot"] / weight["hot"]
    for s in total:
        assert abs(read[s] - weight[s] * scale) <= 41, "off by less than a document"
    again = mix(d, Target(repetitions=3.0), block_tokens=64)
    assert sorted((r["_mix_id"], r["_mix_epoch"]) for r in again.collect()) == sorted((r["_mix_id"], r["_mix_epoch"]) for r in got)
    out = mixed_documents(d, Target(repetitions=3.0))
    assert out.columns == d.columns and out.select("doc_id").distinct().count() == len(items)
    assert mix(d.limit(0), Target(repetitions=3.0)).count() == 0


# --- vectors ---

VECTORS = "vec_id long, embedding array<float>, label int, node long, unit string, copies int"


def brute_vectors(items, threshold):
    from collections import defaultdict

    good = []
    for k, (i, v, lab, *_) in enumerate(items):
        if v and None not in v and lab is not None:
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and np.linalg.norm(x) > 0:
                good.append((k, lab, x / np.linalg.norm(x)))
    links, parent = defaultdict(int), list(range(len(items)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            if good[a][1] == good[b][1] and len(good[a][2]) == len(good[b][2]) and good[a][2] @ good[b][2] >= threshold:
                links[good[a][0]] += 1
                links[good[b][0]] += 1
                parent[root(good[a][0])] = root(good[b][0])
    least = {}
    for k, it in enumerate(items):
        least[root(k)] = min(least.get(root(k), 1 << 60), it[0])
    return sorted((it[0], links[k], least[root(k)], it[0] == least[root(k)]) for k, it in enumerate(items))


@pytest.mark.parametrize("block", [1024, 8])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(ed, "BLOCK", block)
    rng = np.random.default_rng(0)
    items = []
    for c in range(12):
        base = rng.normal(size=16)
        for _ in range(20 if c == 0 else 4):
            items.append((len(items), [float(np.float32(x)) for x in base + rng.normal(scale=0.1, size=16)], c % 3, 1, "u", 1))
    items += [(len(items) + i, v, lab, 1, "u", 1) for i, (v, lab) in enumerate([(None, 0), ([], 0), ([0.0] * 16, 0), ([float("nan")] * 16, 0), ([1.0, None] * 8, 0), ([float("inf")] * 16, 1), (items[0][1], None), (items[0][1], 0), (items[0][1], 1), ([1.0, 2.0], 0), ([2.0, 4.0], 0)])]
    got = sorted(tuple(r) for r in ed.near_vectors(spark.createDataFrame(items, VECTORS)).collect())
    assert got == brute_vectors(items, ed.THRESHOLD)
    assert ed.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize("block", [1024, 8])
def test_chains_of_links_stay_whole(spark, monkeypatch, block):
    """Groups that only chains hold together, with ids in any order."""
    monkeypatch.setattr(ed, "BLOCK", block)
    at = [(1, 0), (2, 60), (3, 20), (4, 40)]
    chain = [x for x in range(0, 340, 20)]
    random.Random(3).shuffle(chain)
    at += [(10 + i, a) for i, a in enumerate(chain)]
    items = [(i, [math.cos(math.radians(a)), math.sin(math.radians(a))], int(i >= 10), 1, "u", 1) for i, a in at]
    got = sorted(tuple(r) for r in ed.near_vectors(spark.createDataFrame(items, VECTORS)).collect())
    assert got == brute_vectors(items, ed.THRESHOLD)
    assert {r[2] for r in got if r[0] < 10} == {1}


def test_index_recall_against_brute_force():
    """Recall of the candidate lists, on clusters about as tight as the threshold allows."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 64))
    x = np.repeat(base, 6, axis=0) + rng.normal(scale=0.22, size=(1800, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots = ed.choose_pivots(x[rng.permutation(len(x))], ed.PIVOTS)
    near = np.argsort(-(x @ pivots.T), axis=1)[:, : ed.PREFIX]
    names = [set(n) for n in ed.list_names(near, np.zeros(len(x), np.int64), ed.SHARED).tolist()]
    i, j = np.nonzero(np.triu(x @ x.T >= ed.THRESHOLD, 1))
    assert len(i) > 500
    assert np.mean([bool(names[a] & names[b]) for a, b in zip(i, j, strict=True)]) >= 0.9


def test_recall_near_the_threshold_on_isotropic_pairs():
    """Pairs at the threshold in no cluster at all, with as many pivots as a small and a large table get."""
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    assert ed.pivots_for(1000) == ed.PIVOTS and ed.pivots_for(10**9) == ed.MOST_PIVOTS
    for d in (16, 64, 256):
        for n in (ed.PIVOTS, ed.MOST_PIVOTS):
            pivots = unit(rng.normal(size=(n, d)))
            x = unit(rng.normal(size=(2000, d)))
            z = rng.normal(size=(2000, d))
            z = unit(z - (z * x).sum(1, keepdims=True) * x)
            for cosine in (0.932, 0.95):
                y = cosine * x + np.sqrt(1 - cosine**2) * z
                a, b = (ed.list_names(np.argsort(-(v @ pivots.T), axis=1)[:, : ed.PREFIX], np.zeros(2000, np.int64)) for v in (x, y))
                assert np.mean([bool(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist(), strict=True)]) >= 0.95


def test_exact_mode_and_null_ids(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    items = [(None if i < 3 else i, [float(np.float32(x)) for x in base + rng.normal(scale=0.1 if i < 8 else 3, size=16)], 0, 1, "u", 1) for i in range(16)]
    d = spark.createDataFrame(items, VECTORS)
    found, every = (sorted((tuple(r) for r in ed.near_vectors(d, exact=e).collect()), key=str) for e in (False, True))
    assert found == every and sum(r[2] == 3 for r in every) == 8, "three null ids belong to the smallest id of their component"


# --- quality ---


def test_cumulative_link_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.normal(size=3000)
    grades = np.digitize(x + rng.logistic(scale=0.3, size=3000), [-0.5, 0.8])
    rows = [(np.array([5]), np.array([v])) for v in x]
    m = ql.fit(rows, grades, 3, dims=8)
    assert m.theta[0] < m.theta[1] and m.weights[5] > 0
    t = m.tails(m.weights[5] * x)
    assert (t[:, 0] >= t[:, 1]).all() and np.corrcoef(t.sum(1), grades)[0, 1] > 0.75
    assert abs(t[:, 0].mean() - (grades >= 1).mean()) < 0.03, "tails are calibrated"


def test_classify_separates_and_takes_odd_rows(spark):
    rng = random.Random(0)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "of", "the"]) for _ in range(30)) for _ in range(60)]
    bad = [" ".join(rng.choice(["ALPHA!!", "BETA!!", "###", "the&&&"]) for _ in range(30)) for _ in range(60)]
    items = [(i, t, "s") for i, t in enumerate(good + bad + [None, "", "x" * 200000])]
    d = docs(spark, items)
    labels = spark.createDataFrame([(i, 1 if i < 60 else 0, 0) for i in range(0, 120, 2)] + [(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in ql.classify(d, labels).collect()}
    assert len(out) == len(items) and all(0 <= r["p_good"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in out.values())
    assert all(out[i]["accepted"] == (i < 60) for i in range(1, 120, 2)), "held-out rows"
    assert all(r["accepted"] for r in ql.classify(d, labels.limit(0)).collect())
    assert ql.classify(d.limit(0), labels).count() == 0


# --- toxicity ---


def test_block_max_search_is_exact():
    rng = np.random.default_rng(0)
    n, terms = 700, 30
    vectors = []
    for _ in range(n):
        at = rng.choice(terms, size=rng.integers(0, 5), replace=False)
        w = rng.random(len(at)) + 0.1
        vectors.append(dict(zip(at.tolist(), (w / np.linalg.norm(w)).tolist(), strict=True)) if len(at) else {})
    ids = rng.permutation(n)
    index = tx.BlockMaxIndex.build(ids, np.zeros(n), vectors, terms)
    order = np.argsort(ids)
    dense = np.zeros((n, terms))
    for k, i in enumerate(order):
        for t, w in vectors[i].items():
            dense[k, t] = w
    for q in range(0, n, 7):
        v = vectors[order[q]]
        if not v:
            continue
        who, cosine = index.nearest(v, 9, without=q)
        s = dense @ dense[q]
        s[q] = -1
        best = np.lexsort((np.arange(n), -np.round(s, 12)))[:9]
        best = best[s[best] > 0]
        assert who.tolist() == best.tolist() and np.allclose(cosine, np.minimum(s[best], 1))


def test_toxicity_held_out_and_odd_rows(spark):
    rng = random.Random(0)
    plain = [f"n{i}" for i in range(50)]
    items = []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(20)]
        if i % 4 == 0:
            w[rng.randrange(20)] = rng.choice(["Vile,", "nasty", "nastier"])
        items.append((i, " ".join(w), "s"))
    items += [(400, None, "s"), (401, "", "s"), (402, "vile " * 30000, "s")]
    d = docs(spark, items)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    fold = tx.in_fold(F.col("doc_id"), 4, 2)
    model = tx.train(d, labels.filter(~fold))
    got = {r["doc_id"]: r for r in tx.score(d, model).collect()}
    assert len(got) == 403 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i]["score"] >= tx.THRESHOLD) == (i % 4 == 0) for i in held]) > 0.97
    assert got[402]["score"] > 0.3 > got[401]["score"] == got[400]["score"] and got[402]["evidence"]
    none = tx.train(d, labels.limit(0))
    assert {r["score"] for r in tx.score(d, none).collect()} == {0.0}
    assert tx.score(d.limit(0), model).count() == 0


def test_all_terms_of_few_examples_count(spark):
    """A rare insult, and examples too few for any significance, still decide."""
    rng = random.Random(1)
    items = [(i, " ".join(rng.choice(["sun", "sea", "oak", "elm"]) for _ in range(6)) + (" vile" if i % 8 == 0 else ""), "s") for i in range(64)]
    items += [(64, "sun vile sea", "s"), (65, "sun oak sea", "s")]
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(64)], "doc_id long, quality int, toxic int")
    for few in (24, 64):
        model = tx.train(docs(spark, items), labels.filter(F.col("doc_id") < few))
        assert set(model.vocabulary) == {b"sun", b"sea", b"oak", b"elm", b"vile"} and (model.weight > 0).all()
        got = {r["doc_id"]: r for r in tx.score(docs(spark, items[-2:]), model).collect()}
        assert all(i % 8 == 0 for i in got[64]["evidence"][:3]) and got[64]["score"] > got[65]["score"]


# --- packing ---


def test_spfhp_keeps_every_piece_and_pads_little():
    rng = random.Random(0)
    histogram = {}
    for _ in range(20000):
        n = min(1024, int(rng.expovariate(1 / 300)) + 1)
        histogram[n] = histogram.get(n, 0) + 1
    patterns = pk.shortest_pack_first(histogram)
    used = {}
    for p, n in patterns:
        assert sum(p) <= 1024 and list(p) == sorted(p, reverse=True)
        for x in p:
            used[x] = used.get(x, 0) + n
    assert used == histogram
    padded = sum(pk.padding(sum(p)) * n for p, n in patterns)
    assert padded / sum(k * n for k, n in histogram.items()) < 0.01
    assert pk.shortest_pack_first({}) == [] and pk.padding(512) == 0 and pk.padding(1000) == 24


def test_spfhp_puts_pieces_of_a_dominant_length_together():
    for histogram, packs in (({300: 3000}, 1000), ({300: 10}, 4), ({600: 10, 300: 40}, 20), ({400: 4, 100: 4}, 2), ({1: 2048}, 2), ({1024: 3, 512: 3}, 5), ({700: 5, 300: 900}, 304)):
        patterns = pk.shortest_pack_first(histogram)
        used = {}
        for p, n in patterns:
            assert sum(p) <= 1024 and list(p) == sorted(p, reverse=True)
            for x in p:
                used[x] = used.get(x, 0) + n
        assert used == histogram and sum(n for _, n in patterns) == packs


def test_pack_places_all_ids(spark):
    rng = random.Random(2)
    texts = [None, "", "a<|endoftext|>b", "it's  two", "tab\tand\nline ", "日本 語 é", "word, word. " * 900] + [" ".join(rng.choice(["alpha", "Beta,", "don't", "x1"]) for _ in range(rng.randrange(1, 900))) for _ in range(40)]
    items = [(i, t, "s") for i, t in enumerate(texts)] + [(5, "日本 語 é", "s")]
    got = pk.pack(docs(spark, items)).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(pk.tokenizer_path())
    want = {}
    for i, text, _ in items:
        want.setdefault(i, []).append([*t.encode(text or "", add_special_tokens=False).ids, 0])
    pieces, places = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        ids = want[r["doc_id"]][0][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]][0])
    for i, w in want.items():
        assert sum(r["length"] for r in pieces[i]) == len(w) * len(w[0])
        assert len({r["start"] for r in pieces[i]}) == len(pieces[i]) // len(w)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert pk.pack(docs(spark, [])).count() == 0


# --- archive ---

PAGES = "page_id long, url string, html string, id long, digest string, body string, holder long"


def test_archive_round_trip(spark):
    big, small = "x" * 1500, "y" * 20
    items = [(1, "http://a", big), (2, None, big), (3, "u\r\nX: y", big), (4, "u", small), (5, "u", small), (6, "u", None), (7, "u", ""), (8, "u", "é\r\n\r\nz" * 400), (8, "u", "é\r\n\r\nz" * 400), (9, "u", "q" * 2_000_000)]
    pages = spark.createDataFrame([(*i, 0, "d", "b", 1) for i in items], PAGES)
    got = warc.archive_round_trip(pages).collect()
    assert len(got) == len(items)
    for r in got:
        body = (dict((i, h) for i, _, h in items)[r["page_id"]] or "").encode()
        assert bytes(r["body"]) == body and r["size"] == len(body) and r["declared"] == "sha1:" + hashlib.sha1(body).hexdigest()
    kind = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got}
    assert kind[1] == kind[2] == ("revisit", 3) and kind[3] == kind[4] == kind[5] == kind[6] == kind[8] == ("response", None)
    scratch = Scratch(spark, "t")
    warc.write_archive(pages, scratch)
    assert spark.read.parquet(scratch.path("payloads")).count() == 5, "each payload is stored once"
    record = bytes(warc.read_archive(scratch).filter("length(body) = 20").first()["record"])
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and record.endswith(small.encode() + b"\r\n\r\n")
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_a_damaged_payload_is_noticed(spark):
    scratch = Scratch(spark, "t")
    warc.write_archive(spark.createDataFrame([(1, "u", "good", 0, "d", "b", 1)], PAGES), scratch)
    p = spark.read.parquet(scratch.path("payloads")).withColumn("body", F.lit(b"bad")).collect()
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("body", T.BinaryType())])
    spark.createDataFrame(p, schema).write.mode("overwrite").parquet(scratch.path("payloads"))
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(scratch).collect()


# --- queries and pipeline ---

SF = "/root/testdata/sf0.001"


def test_queries_equal_their_sql(spark):
    import duckdb

    from deltaview.llm import queries as q

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in q.oracle_sql().items():
        got = q.queries()[name](spark, SF)
        want = c.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(got.columns) == sorted(names)
        assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want.fetchall())), name


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    scratch, now, before = Scratch(spark, "t"), docs_, docs_
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        now = scratch.save(stage(spark, now, SF), name)
        counts[name] = now.select("doc_id").distinct().count()
        if name != "packing":
            assert now.columns == docs_.columns
        if name == "quality":
            good = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").select("doc_id")
            assert before.join(good, "doc_id").join(now.select("doc_id"), "doc_id", "left_anti").count() <= 1, "clean documents stay"
        if name == "exact_dedup":
            texts = now.select(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " "))
            assert texts.count() == texts.distinct().count()
        before = now
    assert counts["quality"] >= counts["exact_dedup"] >= counts["near_dedup"] == counts["mixing"] == counts["packing"] > 0
    assert math.isclose(sum(1 for _ in corpus_pipeline.STAGES), 5)


def test_the_tokenizer_takes_over_where_ranks_differ():
    right = pk.ChunkEncoder(pk.tokenizer_path())
    wrong = pk.ChunkEncoder(pk.tokenizer_path())
    wrong.one = lambda chunk: [1, 2, 3]
    texts = ["the first text, with words", "another one of them", "", "  spaces  "]
    assert wrong.encode(texts) == right.encode(texts) and wrong.one is None
    fast = pk.ChunkEncoder(pk.tokenizer_path(), pk.tokenizer_path(pk.RANKS))
    assert fast.encode(texts) == right.encode(texts) and fast.one is not None


def test_the_encoder_holds_a_bounded_cache(monkeypatch):
    monkeypatch.setattr(pk, "CACHE", 100)
    enc = pk.encoder(pk.tokenizer_path())
    enc.known.clear()
    rng = random.Random(5)
    texts = [f"the {'x' * 300_000}, of words", "unit\x1f separators \x1f in it", "zero\x00 bytes \x00in it"] + [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) + " the" for _ in range(600)]
    want = [np.array(e.ids, "<u4").tobytes() for e in enc.t.encode_batch(texts, add_special_tokens=False)]
    got = []
    for at in range(0, len(texts), 20):
        got += enc.encode(texts[at : at + 20])
        assert len(enc.known) <= 100 + 2 * 20 * 41, "it holds more than its limit and the last texts' chunks"
        assert max(map(len, enc.known)) <= 64, "long chunks stay"
    assert got == want
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    out = list(pk.pieces_of(pk.tokenizer_path(), 1024)(iter([batch])))
    assert sum(n for b in out for n in b.column(2).to_pylist()) == sum(len(x) // 4 + 1 for x in want)
    assert max(map(len, enc.known)) <= 64, "an idle worker holds long chunks"


def test_texts_are_encoded_in_groups_of_bounded_size():
    texts = ["a" * 400_000] * 10 + [None] + ["b"] * 300
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    groups = list(pk._groups(iter([batch])))
    assert [i for ids, _ in groups for i in ids] == list(range(len(texts))) and [t or None for _, g in groups for t in g] == texts
    assert max(sum(map(len, g)) for _, g in groups) <= (1 << 20) + 400_000 and max(len(ids) for ids, _ in groups) == 256
