"""Operators on texts against brute force, on small tables with every odd row."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deltaview.llm import jaccard_join as jj
from deltaview.llm import lm_scoring as lm
from deltaview.llm import suffix_dedup as sd
from deltaview.llm._components import components
from deltaview.llm._store import Scratch
from deltaview.llm.exact_dedup import MergeIndex, exact_dedup, keep_first, sha256_digest

WORDS = [f"w{i}" for i in range(60)]
SCHEMA = "doc_id long, text string, name string, id long, uid string, digest string"  # clashing extra columns


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "n", 7, "u", "d") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def near_copies(seed=3, groups=4):
    """Families whose members differ by a few words, short texts, blanks and nulls."""
    rng, out = random.Random(seed), [None, "", " \t\n", "one", "One", "one two three", "a b c d e", "A  b\tc d\ne"]
    for _ in range(groups):
        base = [f"{rng.choice(WORDS)}{rng.randrange(99)}" for _ in range(rng.choice([8, 30, 120]))]
        for _ in range(7):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(w))
    return out + out[-3:]


# --- exact dedup ---


def brute_exact(ids, texts):
    import re

    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for t in texts]
    groups = defaultdict(list)
    for i, t in zip(ids, norm, strict=True):
        groups[t].append(i)
    return {(i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in zip(ids, norm, strict=True)}


TEXTS = ["a b", "a\t\tb", None, "", " ", "\n", "a b ", "é x", "é x", "long " * 20000, "long " * 20000, "a b"]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    digest = (lambda t: F.lit(b"same")) if weak else sha256_digest
    got = exact_dedup(table(spark, TEXTS), digest=digest)
    assert {tuple(r) for r in got.collect()} == brute_exact(range(len(TEXTS)), TEXTS), "equal digests of different texts are told apart"


def test_exact_dedup_of_repeated_rows_keeps_one(spark):
    d = table(spark, ["x", "x", "y"], [5, 5, 4])
    assert sorted((r["doc_id"], r["kept"]) for r in exact_dedup(d).collect()) == [(4, True), (5, False), (5, True)]
    assert sorted(r["doc_id"] for r in keep_first(d).collect()) == [4, 5] and keep_first(d).columns == d.columns
    assert exact_dedup(d.limit(0)).count() == 0


def test_merge_index_looks_up_and_merges_runs(spark):
    index = MergeIndex(Scratch(spark, "t"), memtable_rows=4)
    for lo in (0, 5):
        index.flush(spark.range(lo, lo + 10).select(F.col("id").alias("uid"), "id", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest")))
    level = index.compact()
    assert level.count() == 15 and level.filter("n = 2").count() == 5
    assert [r["first"]["id"] for r in index.lookup([hashlib.sha256(b"7").digest()]).collect()] == [7]


# --- components ---


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(80)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    assert got == {v: root(v) for v in parent}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


# --- Jaccard join ---


def brute_jaccard(ids, texts, words=5, similarity=75):
    sets = [set(jj.shingle_set(t, words).tolist()) for t in texts]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= similarity * (len(sets[i]) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: 1 << 60)
    for i in range(len(sets)):
        least[root(i)] = min(least[root(i)], ids[i])
    return sorted((ids[i], len(sets[i]), least[root(i)]) for i in range(len(sets)))


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_join(spark, seed):
    texts = near_copies(seed)
    got = jj.jaccard_join(table(spark, texts))
    assert sorted(tuple(r) for r in got.collect()) == brute_jaccard(list(range(len(texts))), texts)


def test_jaccard_join_of_empty_and_repeated(spark):
    assert jj.jaccard_join(table(spark, []).limit(0)).count() == 0
    d = table(spark, ["p q r s t u", "p q r s t u", None], [2, 2, 3])
    assert sorted(tuple(r) for r in jj.jaccard_join(d).collect()) == [(2, 2, 2), (2, 2, 2), (3, 0, 3)]
    assert sorted(r["doc_id"] for r in jj.one_of_each(d).collect()) == [2, 2, 3]


def test_shingles_follow_the_words():
    words = "The QUICK brown \x0b fox É x y".encode().lower().split()
    assert len(words) == 6 and len(jj.shingle_set("The QUICK brown \x0b fox É x y")) == 2
    assert set_of("A b c d e f") == set_of("a  B\tc d e f") and set_of("É b c d e") != set_of("é b c d e")
    assert len(jj.shingle_set("a b")) == 1 and set_of("a b") != set_of("a b c")


def set_of(t):
    return set(jj.shingle_set(t).tolist())


def test_signatures_lose_no_link():
    """Every pair at or above the similarity shares a signature, at all sizes and with any frequent set."""
    rng = np.random.default_rng(0)
    bands = jj.Bands()
    levels = set()
    for _ in range(1500):
        n = int(rng.integers(1, 300)) if rng.random() < 0.7 else int(rng.integers(1, 12))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = set(x.tolist())
        for _ in range(int(rng.integers(0, max(1, n // 3) + 1))):
            r = rng.random()
            if r < 0.5 and len(y) > 1:
                y.discard(next(iter(y)))
            else:
                y.add(int(rng.integers(0, 2**63)))
        y = np.sort(np.array(list(y), np.uint64))
        frequent = np.sort(rng.choice(x, size=min(len(x), int(rng.integers(0, 8))), replace=False))
        levels.add(bands.layout(bands.of(len(x)))[1])
        if jj.linked(x, y):
            a, b = set(jj.signatures(x, frequent, bands).tolist()), set(jj.signatures(y, frequent, bands).tolist())
            assert a & b, (len(x), len(y))
    assert levels == {0, 1}, "both kinds of index were in use"


def test_differences_give_exact_similarity():
    rng = random.Random(5)
    centre = np.unique(np.array([rng.randrange(2**60) for _ in range(90)], np.uint64))
    sets_, rows_ = [], []
    for i in range(40):
        keep = [v for v in centre.tolist() if rng.random() < 0.9] or [1]
        extra = [rng.randrange(2**60) for _ in range(rng.randrange(12))] + ([7, 8, 9] if i % 3 == 0 else [])
        x = np.unique(np.array(keep + extra, np.uint64))
        at = np.isin(centre, x)
        sets_.append(x)
        rows_.append((i, i, len(x), len(centre), np.packbits(~at).tobytes(), x[~np.isin(x, centre)].tobytes()))
    d = jj.Differences(rows_)
    for i in range(40):
        assert d.differ(d.bits[i], d.besides[i]).tolist() == [len(set(sets_[i].tolist()) ^ set(y.tolist())) for y in sets_]
    links = jj.joining_links(d, d, 75, own=True)
    assert all(jj.linked(sets_[a], sets_[b]) for a, b in links)


# --- long repeats ---


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def repetitive(seed):
    rng = random.Random(seed)
    passage = prose(rng, 60)
    texts = [None, "", "short", "ab" * 300, prose(rng, 300), passage, passage, "é" * 250]
    for _ in range(6):
        cut = rng.randrange(0, 120)
        texts.append(prose(rng, rng.randrange(5, 80)) + passage[cut:] + prose(rng, rng.randrange(5, 80)) + (passage if rng.random() < 0.4 else ""))
    return texts


@pytest.mark.parametrize("length", [64, 100])
def test_remove_repeats(spark, length):
    texts = repetitive(length)
    got = sorted(tuple(r) for r in sd.remove_repeats(table(spark, texts), length=length).collect())
    assert got == [(i, *r) for i, r in enumerate(brute_repeats(texts, length))]
    assert sd.remove_repeats(table(spark, []).limit(0)).count() == 0


def brute_shared(texts, passage):
    docs = [(t or "").encode().split() for t in texts]
    owners = defaultdict(set)
    for i, d in enumerate(docs):
        for p in range(len(d) - passage + 1):
            owners[tuple(d[p : p + passage])].add(i)
    return [len({q for p in range(len(d) - passage + 1) if len(owners[tuple(d[p : p + passage])]) > 1 for q in range(p, p + passage)}) for d in docs]


@pytest.mark.parametrize("passage", [2, 7, 20])
def test_words_of_shared_passages(spark, passage):
    rng = random.Random(passage)
    texts = [t for seed in range(4) for t in repetitive(seed)] + ["\n\t".join(prose(rng, 90).split())] * 2
    line = [f"common{i}" for i in range(passage + 3)]
    for i in range(30):  # a line with other words around it, twice in some texts, with other blanks in some
        own = lambda n: [f"own{i}x{rng.randrange(10**6)}" for _ in range(n)]  # noqa: E731, B023
        w = own(rng.randrange(9)) + line[rng.randrange(5) :] + own(rng.randrange(40)) + (line if i % 3 else [])
        texts.append((" \r\n " if i % 2 else " ").join(w) + (" " if i % 4 else ""))
    texts += [" ".join(["x"] * (passage + 5)), " ".join(["y"] * 200 + ["x"] * passage), "  " + texts[-1], "z" * 9000 + " " + prose(rng, 60), "z" * 9000 + " " + texts[-2], " ".join(["solo"] * 200)]
    got = {r["doc_id"]: r for r in sd.remove_repeats(table(spark, texts), passage=passage).collect()}
    want = brute_shared(texts, passage)
    assert [got[i]["n_shared_words"] for i in range(len(texts))] == want
    assert want[-1] == 0 and max(want) > 60, "a repeat inside one text is not shared"
    plain = {r["doc_id"]: r for r in sd.remove_repeats(table(spark, texts)).collect()}
    assert all(tuple(plain[i]) == tuple(got[i])[:-1] for i in plain), "what is cut stays as it was"


def test_op4_tells_passages_that_are_too_short_to_cut(spark, tmp_path):
    from deltaview.llm.queries import op4_suffix_dedup

    rng = random.Random(6)
    passage = prose(rng, 55)
    assert len(passage) < sd.LENGTH
    own = lambda i: " ".join(f"d{i}w{j}" for j in range(200))
    texts = [own(0) + " " + passage + " " + own(1), own(2) + "\n" + passage, own(3), " ".join(passage.split()[:50]), None]
    table(spark, texts).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["n_removed"], r["n_shared_words"]) for r in op4_suffix_dedup(spark, str(tmp_path)).collect())
    assert got == [(0, 0, 55), (1, 0, 55), (2, 0, 0), (3, 0, 0), (4, 0, 0)]


def test_words_of_long_texts_are_segmented():
    rng = random.Random(7)
    words = [(rng.choice("abc") * rng.choice([1, 3, 40, 5000])).encode() for _ in range(400)]
    data = b"\n " + b" \t".join(words) + b" "
    for size in (100, 1000, 3000):
        pieces = list(sd.word_pieces(1, data, 9, size))
        assert len(pieces) > 3
        whole, parts = sd.word_regions([(1, 0, data)], 10)[0], sd.word_regions(pieces, 10)[0]
        each = np.concatenate([sd.word_regions([p], 10)[0] for p in pieces])
        starts = lambda r: sorted(s for x in r for s in range(x["start"], x["start"] + x["span"] + 1))
        assert starts(whole) == starts(parts) == starts(each) == list(range(391))
        hashes = [sd.word_hashes([p[2]])[0] for p in sd.word_pieces(1, data, 0, size)]
        assert (np.concatenate(hashes) == sd.word_hashes([data])[0]).all()
    h = sd.word_hashes([data])[0]
    assert len(h) == 400 and len(set(h.tolist())) == len(set(words))


def test_long_texts_are_segmented():
    data = bytes(random.Random(2).randrange(97, 123) for _ in range(3000))
    whole = sd.regions([(1, 0, data)], 64)
    parts = sd.regions(list(sd.segments(1, data, 64, size=500)), 64)
    starts = lambda r: sorted(s for x in r for s in range(x["start"], x["start"] + x["span"] + 1))
    assert starts(whole) == starts(parts) == list(range(3000 - 63))


def test_run_length_index_match_lengths():
    rng = random.Random(4)
    bodies = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 60))) for _ in range(12)]
    index = sd.RunLengthIndex(bodies)
    got = index.match_lengths()
    for i, b in enumerate(bodies):
        for p in range(len(b)):
            best = 0
            for j, c in enumerate(bodies):
                for q in range(len(c)):
                    if (i, p) != (j, q):
                        n = 0
                        while p + n < len(b) and q + n < len(c) and b[p + n] == c[q + n]:
                            n += 1
                        best = max(best, n)
            assert got[index.begin[i] + p] == best
    runs = len(index.run_heads)
    assert runs < len(index.symbols)


# --- language model ---


def test_lm_counts_and_normalisation(spark):
    rng = random.Random(8)
    texts = [None, "", "The the THE x", "é É"] + [prose(rng, rng.randrange(1, 200)) for _ in range(60)] + ["same words here"] * 2
    ids = [*range(len(texts) - 1), len(texts) - 2]
    got = sorted((tuple(r) for r in lm.lm_scores(table(spark, texts, ids)).collect()), key=lambda r: (r[0], r[2], r[5]))
    docs = [((t or "").encode().lower().split() + [b" end"]) for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in ids]
    c = Counter(w for d, h in zip(docs, held, strict=True) if not h for w in d)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, h, len(d), sum(c[w] > 0 for w in d), n, sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in d)) for i, h, d in zip(ids, held, docs, strict=True)), key=lambda r: (r[0], r[2], r[5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want]) and all(np.isfinite(r[6]) and r[6] < 0 for r in got)
    assert lm.lm_scores(table(spark, []).limit(0)).count() == 0


def test_lm_learns_and_stays_normalised():
    rng = np.random.default_rng(0)
    # w follows w-1 as (w-1 + 1) mod 20 nearly always
    one = rng.integers(0, 20, 5000)
    w = np.where(rng.random(5000) < 0.9, (one + 1) % 20, rng.integers(0, 20, 5000))
    two = np.full(5000, 3)
    unigram = np.bincount(w, minlength=22) + 0.5
    model = lm.LogBilinear.start(unigram / unigram.sum())
    lm.Trainer(model, unigram).learn(one, two, w, passes=200)
    norm = model.log_normaliser(np.arange(22))
    every = [model.scores(np.full(22, a), np.full(22, 3), np.arange(22)) - norm[a, 3] for a in range(22)]
    assert np.allclose(np.exp(every).sum(1), 1, atol=1e-4)
    p = model.scores(one, two, w) - norm[one, two]
    assert p.mean() > np.log(1 / 20) + 1, "better than the unigram"


def test_lm_averages_tasks_by_row():
    change = lambda rows, weight, x: ("q", 0, np.array(rows, "<i4").tobytes(), np.array(weight, np.float32).tobytes(), np.array(x, "<f2").tobytes())
    rows = [change([0, 2], [1, 5], [[1, 1], [2, 2]]), change([0], [3], [[5, 9]])]
    batch = lm.pa.RecordBatch.from_arrays([lm.pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (lm.pa.string(), lm.pa.int32(), *[lm.pa.binary()] * 3), strict=True)], ["part", "block", "rows", "weights", "change"])
    (out,) = [b.to_pylist()[0] for b in lm._average(iter([batch]))]
    assert np.frombuffer(out["rows"], "<i4").tolist() == [0, 2], "a row that one task met keeps its whole change"
    assert np.frombuffer(out["change"], "<f2").tolist() == [4, 7, 2, 2]


def test_lm_beats_the_unigram_on_held_out_texts(spark):
    rng = random.Random(2)
    nxt = {w: rng.sample(WORDS, 2) for w in WORDS}

    def chain():
        w, out = rng.choice(WORDS), []
        for _ in range(80):
            w = rng.choice(nxt[w])
            out.append(w)
        return " ".join(out)

    got = lm.lm_scores(table(spark, [chain() for _ in range(300)], range(300))).filter("held_out").collect()
    gain = sum(r["score"] - r["base_score"] for r in got) / sum(r["n_tokens"] for r in got)
    assert gain > 0.5, "of log10(60 / 2) = 1.48 a token"


def test_sketches_lose_no_link():
    rng = random.Random(9)
    for _ in range(3000):
        x = np.unique(np.array([rng.getrandbits(64) for _ in range(rng.choice([1, 2, 4, 20, 64, 65, 130, 300]))], np.uint64))
        kept = [v for v in x.tolist() if rng.random() > 0.12]
        y = np.unique(np.array(kept + [rng.getrandbits(64) for _ in range(rng.randrange(1 + len(x) // 6))] or [1], np.uint64))
        sx, sy = (np.frombuffer(jj.sketch(v), np.uint8)[None] for v in (x, y))
        may = jj.may_link(np.array([len(x)]), sx, np.array([len(y)]), sy, 75)[0]
        assert may or not jj.linked(x, y)


def test_one_of_each_with_null_ids_and_clashing_columns(spark):
    long = " ".join(f"t{i}" for i in range(60))
    data = [(None, long + " a"), (4, long + " b"), (3, long + " c"), (None, "p q r s t u"), (None, "p q r s t u v w x"), (None, None), (8, "")]
    d = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in data], "doc_id long, text string, own_key int, hit int, `gone.id` int")
    kept = jj.one_of_each(d)
    assert kept.columns == d.columns
    got = sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=str)
    assert got == sorted([(3, long + " c"), (None, "p q r s t u"), (None, "p q r s t u v w x"), (None, None), (8, "")], key=str)
    assert jj.one_of_each(d.limit(0)).count() == 0


def test_toxicity_search_with_and_without_bounds(monkeypatch):
    """Opening all blocks and opening the best give equal neighbours; short runs take the former."""
    import numpy as np

    from deltaview.llm import toxicity

    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(400):
        t = np.sort(rng.choice(3000, 40, replace=False))
        w = rng.random(40)
        vectors.append((t, w / np.sqrt((w * w).sum())))
    index = toxicity.BlockMaxIndex.of(np.arange(400), np.zeros(400), vectors, 3000)
    dense = index.dense_scores(vectors)
    opened = []
    bounded = toxicity.BlockMaxIndex._opened
    monkeypatch.setattr(toxicity.BlockMaxIndex, "_opened", lambda *a: opened.append(1) or bounded(*a))
    got = [index.search(*v, d, 5, without=i) for i, (v, d) in enumerate(zip(vectors, dense, strict=True))]
    assert not opened
    monkeypatch.setattr(toxicity, "FEW", 0)
    for (who, cosine), (i, v) in zip(got, enumerate(vectors), strict=True):
        a, b = index.search(*v, dense[i], 5, without=i)
        assert list(who) == list(a) and np.allclose(cosine, b)
    assert len(opened) == 400


def test_toxicity_terms_stay_in_a_worker():
    from deltaview.llm import toxicity

    kept = toxicity.terms_of([b"one", b"two"])
    kept.of("two one two three")
    assert toxicity.terms_of([b"one", b"two"]) is kept and toxicity.terms_of([b"one"]) is not kept


def test_toxicity_terms_of_many_texts_at_once(monkeypatch):
    """Words are looked up by slices of texts, each distinct one once, with the terms and counts of single texts."""
    from collections import Counter

    from deltaview.llm import toxicity

    rng = random.Random(8)
    texts = [None, "", " .,", "A", "a\x00b\nc", "abcd abcde ABCDEFGH abcdefg ^abcd", "über straße Straßen 5", "x " * 300]
    texts += [" ".join("".join(rng.choice("abé1") for _ in range(rng.randrange(1, 10))) for _ in range(rng.randrange(40))) for _ in range(200)]
    vocabulary = sorted({t for text in texts[::3] for t in toxicity.terms(text)} | {b"^abcd", b"abcd"})
    known = toxicity.Terms(vocabulary)
    asked = []
    rows = toxicity.Terms._rows
    monkeypatch.setattr(toxicity.Terms, "_rows", lambda self, words: asked.append(words.to_pylist()) or rows(self, words))
    for size in (1, 500, 1 << 20):
        monkeypatch.setattr(toxicity, "SLICE", size)
        asked.clear()
        got = list(known.of_all(iter(texts)))
        assert len(got) == len(texts) and list(known.of_all([])) == []
        for text, (found, times) in zip(texts, got, strict=True):
            want = Counter(t for t in toxicity.terms(text) if t in set(vocabulary))
            assert {vocabulary[i]: n for i, n in zip(found, times, strict=True)} == want and (np.diff(found) > 0).all()
    assert len(asked) == 1 and len(asked[0]) == len(set(asked[0]))


def test_worker_gives_memory_back_before_the_next_operator(monkeypatch):
    from deltaview.llm import _store

    given = []
    monkeypatch.setattr(_store, "_HELD", {})
    monkeypatch.setattr(_store, "give_back", lambda: given.append(dict(_store._HELD)))
    _store.worker_cache("one")["x"] = 1
    assert _store.worker_cache("one") == {"x": 1} and not given
    assert _store.worker_cache("two") == {} and given == [{}]


def test_anchors_of_a_buffer_are_hashed_by_blocks():
    import tracemalloc

    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefgh ", k=20_000)) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    tracemalloc.start()
    try:
        out = list(sd._anchors(4, 400)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(b.num_rows for b in out) == 4
    assert peak < 120 << 20, f"a worker holds {peak >> 20} MB for 4 MB of text"


def test_batches_on_their_way_to_a_worker_are_bounded_by_bytes(spark):
    from deltaview.llm._store import BATCH_BYTES

    scratch = Scratch(spark, "batches")
    texts = scratch.save(spark.range(0, 6000, 1, 1).selectExpr("id", "repeat(cast(id as string), 2000) text"), "texts")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "size"])

    got = texts.mapInArrow(sizes, "rows long, size long").collect()
    assert sum(r["rows"] for r in got) == 6000
    assert max(r["size"] for r in got) < 2 * BATCH_BYTES, "a worker gets its task's rows at once"
