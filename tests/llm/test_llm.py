"""The ten operators and the pipeline: SQL, brute force, round trips, held-out accuracy and edge cases."""

import hashlib
import itertools
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import compare  # noqa: E402

from keyloom.llm import backoff, components, decontaminate, jaccard_join, langid, mixing, outliers, paragraphs, quality_fm, queries, rans, sieve, stats, text, tokens, toxicity  # noqa: E402

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
#: More columns than usual, with names that operators might use themselves.
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("key", T.StringType()), ("size", T.LongType()), ("__key", T.IntegerType()))])
LONG = " ".join(f"word{i % 977}" for i in range(30000))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None, "k", 1, 2) for i, t, lang, src in rows], SCHEMA)


def edge_rows():
    one = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    return [
        (1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", "a"), (4, one, "en", "a"), (4, one, "en", "a"), (5, one + "\n" + one, "de", None), (6, LONG, "en", "b"),
        (None, "no id here at all in this row of words", "en", "b"), (8, "x", None, "b"), (9, "... !!! ???", "fr", "c"), (10, "é́ ñandú <|endoftext|> It's DON'T", "fr", "c"), (11, one, "en", "é"),
    ]


@pytest.fixture(scope="module")
def edges(spark):
    return frame(spark, edge_rows()).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    compare(queries.QUERIES[name](spark, SF), queries.SQL[name], SF)


# words


def test_words_and_hashes():
    col = pa.array([t for _, t, _, _ in edge_rows()] + ["a\x00b \x1cc d", "A1 a1"])
    for classes, pattern in ((text.SPACE_WORDS, r"[^\x20\x09-\x0D]+"), (text.ALNUM_WORDS, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        W = text.words(col, classes)
        want = [[w.encode() for w in re.findall(pattern, t or "")] for t in col.to_pylist()]
        assert [W.word(i) for i in range(len(W.start))] == [w for ws in want for w in ws]
        assert W.count.tolist() == [len(ws) for ws in want]
        seen = {}
        for i, h in enumerate(W.hashes().tolist()):
            assert seen.setdefault(h, W.word(i)) == W.word(i)
    short = [bytes(x).decode() for n in (1, 2, 3) for x in itertools.product(range(0x21 if n > 2 else 0, 0x40, 1 if n < 3 else 3), repeat=n)]
    short = [x for x in dict.fromkeys(short) if not set(x) & set(" \t\n\x0b\x0c\r")]
    assert len(set(text.words(pa.array(short)).hashes().tolist())) == len(short)
    assert len(set(text.words(pa.array(["A1 a1"]), text.ALNUM_WORDS).hashes(lower=True).tolist())) == 1
    n = sum(b.num_rows for b in text.slices([pa.RecordBatch.from_pydict({"text": col})], limit=10))
    assert n == len(col)


# 1 language


def test_language(spark, edges, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = langid.train(docs)
    got = langid.identify(docs, m).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    rows = langid.identify(edges, m).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.score <= 1 for r in rows)
    und = [r.lang_pred == "und" for r in sorted(rows, key=lambda r: (r.doc_id or 0))]
    assert und == [not re.search(r"[^\W\d_]", t or "") for _, t, _, _ in sorted(edge_rows(), key=lambda r: r[0] or 0)]
    assert langid.identify(none, m).count() == 0
    assert {r.lang_pred for r in langid.identify(edges, langid.train(none)).collect()} == {"und"}


def test_every_language_is_learned(spark):
    # 70 languages, each of its own two letters; the last has the fewest texts
    own = lambda i: (chr(97 + i % 10), chr(107 + i // 10))
    rng = random.Random(2)
    word = lambda i: "".join(rng.choice(own(i)) for _ in range(3)) + "".join(own(i))
    rows = [(100 * i + j, " ".join(word(i) for _ in range(30)), f"l{i:02}", "a") for i in range(70) for j in range(16 if i < 69 else 12)]
    docs = frame(spark, rows)
    m = langid.train(docs)
    assert m.labels == [f"l{i:02}" for i in range(70)]
    want = {r[0]: r[2] for r in rows}
    got = langid.identify(docs, m).where("held_out").collect()
    assert {want[r.doc_id] for r in got if want[r.doc_id] == r.lang_pred} >= {f"l{i}" for i in range(64, 70)}
    assert sum(r.lang_pred == want[r.doc_id] for r in got) >= 0.95 * len(got)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    m = langid.Model(["a", "b", "c"], rng.normal(0, 1, (langid.FEATURES, 3)), rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3))
    col = pa.array(["one two three one", "", "four", "six seven eight nine ten eleven", None])
    total, n = langid.label(col, m)
    for i, t in enumerate(col.to_pylist()):
        ws = (t or "").split()
        assert n[i] == len(ws)
        if ws:
            W = text.words(pa.array([t]))
            f, k = langid.word_features(W, np.arange(len(ws)))
            e = np.add.reduceat(m.weight[f], np.cumsum(k) - k)
            paths = {}
            for path in itertools.product(range(3), repeat=len(ws)):
                paths[path] = np.exp(m.first[path[0]] + sum(e[j, c] for j, c in enumerate(path)) + sum(m.step[a, b] for a, b in zip(path, path[1:])))
            z = sum(paths.values())
            want = [sum(p * path.count(c) for path, p in paths.items()) / z for c in range(3)]
            np.testing.assert_allclose(total[i], want, rtol=1e-3)


def test_crf_gradient():
    rng = np.random.default_rng(11)
    n, words_, k = 3, 4, 3
    score, step, first, gold = rng.normal(0, 1, (n, words_, k)), rng.normal(0, 1, (k, k)), rng.normal(0, 1, k), rng.integers(0, k, (n, words_))

    def value():
        def total(i, path):
            return first[path[0]] + sum(score[i, j, c] for j, c in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:]))

        return np.mean([total(i, gold[i]) - math.log(sum(math.exp(total(i, p)) for p in itertools.product(range(k), repeat=words_))) for i in range(n)])

    for x, g in zip((score, step, first), langid.gradient(score, step, first, gold)):
        flat, g = x.reshape(-1), g.reshape(-1)
        for i in range(len(flat)):
            ends = []
            for e in (1e-6, -1e-6):
                flat[i] += e
                ends.append(value())
                flat[i] -= e
            assert (ends[0] - ends[1]) / 2e-6 == pytest.approx(g[i], abs=1e-6)


# 2 outliers


def brute_base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(zip(w, w[1:], w[2:]))
    rep = {j for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


def test_base_statistics(spark, edges):
    for docs in (edges, spark.read.parquet(f"{SMALL}/documents.parquet")):
        got = sorted(tuple(r)[1:7] for r in outliers.judged(docs).collect())
        assert got == sorted(brute_base(r.text) for r in docs.collect())


def test_outliers_spare_clean_and_find_junk(spark, none):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = outliers.judged(docs).join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = [r.kept for r in got if r.quality], [r.kept for r in got if not r.quality]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)
    assert outliers.judged(none).count() == 0


def direct_mcd(x, h, starts=40, seed=0):
    """The least determinant over concentration steps to the end from many random subsets, on all rows in memory."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(starts):
        at = rng.choice(len(x), 3 * x.shape[1], replace=False)
        det = np.inf
        while True:
            scatter = np.cov(x[at].T, bias=True) + np.eye(x.shape[1]) * outliers.RIDGE
            now, mu = np.linalg.slogdet(scatter)[1], x[at].mean(0)
            if now >= det - 1e-9:
                break
            det, y = now, x - mu
            at = np.argsort(((y @ np.linalg.inv(scatter)) * y).sum(1))[:h]
        if best is None or det < best[0]:
            best = det, mu, scatter
    return best


def test_estimates_agree_with_direct_mcd(spark):
    """Location, scatter and determinant, with a fifth of the rows in a far cluster, and with correlated coordinates."""
    rng, d = np.random.default_rng(0), outliers.D
    mixing_ = rng.normal(0, 1, (d, d)) / 2 + np.eye(d)
    x = np.concatenate((rng.normal(0, 1, (2400, d)) @ mixing_, rng.normal(7, 0.3, (600, d))))
    df = spark.createDataFrame([("g", len(x), *map(float, r)) for r in x], "g STRING, n_g BIGINT, " + ", ".join(f"{c} DOUBLE" for c in outliers._X))
    r = outliers.estimates(df.repartition(5)).first()
    e = np.frombuffer(bytes(r.est))
    det, mu, scatter = direct_mcd(x, math.ceil(outliers.H * len(x)))
    assert abs(e[0] - det) < 0.05 and np.abs(e[1 : d + 1] - mu).max() < 0.08
    got = np.linalg.inv(e[d + 1 :].reshape(d, d))
    assert np.abs(got - scatter).max() < 0.1 * np.abs(scatter).max()
    y = x - mu
    d2 = ((y @ np.linalg.inv(scatter)) * y).sum(1)
    assert r.scale == pytest.approx(np.median(d2) / outliers.chi2_quantile(0.5, d), rel=0.1)


def test_concentration_lowers_the_determinant(spark):
    rng, d = np.random.default_rng(4), outliers.D
    x = np.concatenate((rng.normal(0, 1, (900, d)), rng.normal(4, 1, (100, d))))
    df = spark.createDataFrame([("g", len(x), *map(float, r)) for r in x], "g STRING, n_g BIGINT, " + ", ".join(f"{c} DOUBLE" for c in outliers._X)).cache()
    est = outliers._starts(df)
    first = outliers._total(outliers._passed(df, est, outliers._by_distance, outliers._SUMS)).groupBy("g").applyInPandas(outliers._concentrate, outliers._ESTIMATES).cache()
    second = outliers._total(outliers._passed(df, first, outliers._by_distance, outliers._SUMS)).groupBy("g").applyInPandas(outliers._concentrate, outliers._ESTIMATES)
    a, b = np.array(first.first().dets), np.array(second.first().dets)
    assert len(a) == 1 + outliers.SUBSETS and (b <= a + 0.05).all() and len(set(np.round(a, 6))) > 1


def test_outlier_verdicts_against_brute_force(spark):
    """kept, from the base rule and the distance under the group's estimate, worked out again row by row."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = outliers.grouped(outliers.measure(docs)).cache()
    est = {r.g: r for r in outliers.estimates(rows).collect()}
    got = {r.doc_id: r for r in outliers.judged(docs).collect()}
    assert len(got) == rows.count()
    for r in rows.collect():
        e = np.frombuffer(bytes(est[r.g].est))
        y = np.array([r[c] for c in outliers._X]) - e[1 : outliers.D + 1]
        d2 = y @ e[outliers.D + 1 :].reshape(outliers.D, -1) @ y / est[r.g].scale
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert got[r.doc_id].distance == pytest.approx(d2, rel=1e-6, abs=1e-9)
        assert got[r.doc_id].kept == (not failed and d2 <= outliers.TAIL * outliers.chi2_quantile(outliers.QUANTILE, outliers.D))


# 3 quality


def test_quality_held_out(spark, edges, none):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    m = quality_fm.train(docs, labels)
    got = quality_fm.score(docs, m).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    rows = quality_fm.score(edges, m).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert quality_fm.score(none, m).count() == 0
    assert quality_fm.score(edges, quality_fm.train(none, labels.where("false"))).count() == len(edge_rows())


def test_scores_without_labels_of_both_kinds():
    x, s = np.zeros((4, quality_fm.WORDS), np.float32), np.ones((4, 3))
    assert (quality_fm.fit(x, s, np.ones(4)).score(x, s) > 0.99).all() and (quality_fm.fit(x, s, np.zeros(4)).score(x, s) < 0.01).all()
    assert (quality_fm.fit(x[:0], s, np.zeros(0)).score(x, s) == 0.5).all()


def test_pair_identity():
    rng = np.random.default_rng(2)
    x, w, v = rng.normal(size=(5, 7)), rng.normal(size=7), rng.normal(size=(7, 3))
    want = [0.3 + r @ w + sum(v[i] @ v[j] * r[i] * r[j] for i in range(7) for j in range(i + 1, 7)) for r in x]
    np.testing.assert_allclose(quality_fm._raw(x, 0.3, w, v), want)


# 4 and 7 near copies


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1 if w else 0))}


def brute_classes(sets):
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(sets)
    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(sets))], links


def near_copies(n=60, seed=4):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        t = list(base)
        for _ in range(rng.randint(0, 12)):
            t[rng.randrange(400)] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(t), "en", "a"))
    return rows


@pytest.mark.parametrize(("block", "small"), [(4, 2), (256, 32), (16, 7)])
def test_near_copies_against_all_pairs(spark, monkeypatch, block, small):
    monkeypatch.setattr(components.blocks, "__defaults__", (block, block, components.BLOCK_SHINGLES))
    monkeypatch.setattr(components.near, "__defaults__", (small,))
    rows = near_copies() + [(1000 + i, t, lang, s) for i, t, lang, s in edge_rows() if i not in (None, 4)] + [(2000, None, None, None)]
    got = {r.doc_id: r for r in jaccard_join.classes(frame(spark, rows)).collect()}
    root, links = brute_classes([shingles(t) for _, t, _, _ in rows])
    assert len(got) == len(rows)
    for (i, *_), r, n in zip(rows, root, links):
        assert (got[i].class_id, got[i].n_links, got[i].is_first) == (rows[r][0], n, rows[r][0] == i)


def test_join_edges(spark, edges, none):
    assert jaccard_join.classes(edges).count() == len(edge_rows())
    kept = jaccard_join.first_of_each(edges)
    assert kept.columns == edges.columns
    ids = sorted((r.doc_id or 0) for r in kept.collect())
    assert ids == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10]  # the repeated row and the copy are gone
    assert jaccard_join.classes(none).count() == 0 and jaccard_join.first_of_each(none).count() == 0


def test_pruning_bounds():
    least = components.least_matches(jaccard_join.K, jaccard_join.THRESHOLD, jaccard_join.TOLERANCE, jaccard_join.STEP)
    assert list(least) == sorted(least) and least[-1] < jaccard_join.K * jaccard_join.THRESHOLD
    assert components.beta_tail(1, 1, 0.8) == pytest.approx(0.2)


def test_joins_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(i % 2 and i, i) for i in range(40)], "k INT, v INT")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert sorted((r.k, r.v, r.n) for r in components.meet(rows, facts, "k", "n").collect()) == sorted((i % 2 and i, i, 1 if i % 2 else 20) for i in range(40))


def batched(table, n):
    return [b for i in range(0, table.num_rows, n) for b in table.slice(i, n).to_batches()]


@pytest.mark.parametrize("n", [1, 3, 1000])
def test_buckets_over_batches(n):
    """Small buckets keep their rows, large ones tie theirs to the least, wherever batches end."""
    rng = random.Random(3)
    rows = sorted({(b, rng.randrange(1000)) for b in range(40) for _ in range(rng.choice((1, 2, 4, 5, 30)))})
    t = pa.table({"bucket": pa.array([b for b, _ in rows], pa.int64()), "key": pa.array([k for _, k in rows], pa.int64()), "hub": pa.array([None] * len(rows), pa.int64())})
    got = sorted((r["bucket"], r["key"], r["hub"]) for b in components.shared(4)(batched(t, n)) for r in b.to_pylist())
    by = {b: [k for c, k in rows if c == b] for b, _ in rows}
    want = [(b, k, None) for b, ks in by.items() if 1 < len(ks) <= 4 for k in ks] + [(b, k, ks[0]) for b, ks in by.items() if len(ks) > 4 for k in ks[1:]]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_sieve(spark):
    a = spark.range(3000).select(F.xxhash64("id").alias("h"))
    bits = sieve.bitmap(a.limit(700))
    assert a.limit(700).where(sieve.passes(F.col("h"), bits)).count() == 700
    assert spark.range(10**6, 10**6 + 3000).where(sieve.passes(F.xxhash64("id"), bits)).count() < 30
    assert spark.range(9).where(sieve.passes(F.xxhash64("id"), sieve.bitmap(a.where("false")))).count() == 0


def brute_paragraphs(t):
    """(line, piece, words) of the paragraphs that are compared."""
    out = []
    for k, line in enumerate((t or "").split("\n")):
        sentences, now = [], []
        for w in re.findall(r"[^\x20\x09-\x0D]+", line):
            now.append(w)
            if w[-1] in ".!?":
                sentences.append(now)
                now = []
        pieces, held = [], []
        for s in [*sentences, now] if now else sentences:
            held += s
            if s[-1][-1] in ".!?" and len(s) >= paragraphs.LONG_SENTENCE:
                pieces.append(held)
                held = []
        pieces += [held] if held else []
        out += [(k, i, tuple(p)) for i, p in enumerate(pieces) if len(p) >= paragraphs.MIN_WORDS]
    return out


def test_paragraph_cuts(spark):
    texts = [t for _, t, _, _ in edge_rows()] + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(50).collect()] + ["a.\n\n" + "b c. " * 30 + "\n" + "w " * 12 + "x! " + "y " * 17]
    W = text.words(pa.array(texts))
    doc, line, piece, first, n = paragraphs._paragraphs(W)
    got = [(d, a, b, tuple(W.word(i).decode() for i in range(f, f + m))) for d, a, b, f, m in zip(doc.tolist(), line.tolist(), piece.tolist(), first.tolist(), n.tolist())]
    assert got == [(d, *x) for d, t in enumerate(texts) for x in brute_paragraphs(t)]


def test_passages_inside_longer_lines(spark):
    """A passage of some sentences is found wherever it stands; texts that share short lines only are left alone."""
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(n)) + "."
    passage = " ".join(say(k) for k in (4, 14, 3, 20, 18))
    rows = [(i, f"{say(30)[:-1]} {passage} {say(25)}", "en", "a") for i in range(5)] + [(10 + i, f"All rights are reserved here and there.\n{say(40)}", "en", "a") for i in range(5)]
    got = paragraphs.repeated(frame(spark, rows)).collect()
    assert {r.doc_id for r in got} == set(range(5)) and {r.doc_id for r in got if not r.removed} == {0}
    cut = {r.doc_id: r.text for r in paragraphs.without_repeats(frame(spark, rows)).collect()}
    texts = {r[0]: r[1] for r in rows}
    assert all(cut[i] == texts[i] for i in (0, *range(10, 15))) and all(len(cut[i].split()) == len(texts[i].split()) - 41 for i in range(1, 5))  # 3 + 20 and 18 words


def test_paragraph_edges(spark, none):
    one = " ".join(f"alpha{i}" for i in range(20))
    rows = edge_rows() + [(20, one, "en", "a"), (20, one, "en", "a"), (20, "x", "en", "a"), (21, one + "\n" + one, "de", None), (22, one, "en", "a"), (None, one + " ", "en", "b")]
    extra = T.StructType([*SCHEMA.fields, *(T.StructField(n, T.LongType()) for n in ("__gone", "__d", "__t", "th", "para"))])
    df = spark.createDataFrame([(i, t, lang, src, None, "k", 1, 2, 1, 2, 3, 4, 5) for i, t, lang, src in rows], extra)
    got = Counter((r.doc_id, r.para, r.removed) for r in paragraphs.repeated(df).collect())
    assert got == Counter({(None, 0, False): 1, (20, 0, True): 2, (21, 0, True): 1, (21, 1, True): 1, (22, 0, True): 1})
    got = Counter((r.doc_id, r.removed) for r in paragraphs.repeated(df.where("doc_id IN (20, 22)")).collect())
    assert got == Counter({(20, False): 1, (20, True): 1, (22, True): 1})  # of the repeated row, one stays
    assert paragraphs.repeated(none).count() == 0 and paragraphs.without_repeats(none).count() == 0
    cut = paragraphs.without_repeats(df.where("doc_id IS NOT NULL"))
    assert cut.columns == df.columns
    left = Counter((r.doc_id, r.text) for r in cut.where("doc_id >= 20 OR doc_id IN (1, 6)").collect())
    assert left == Counter([(1, None), (6, LONG), (20, one), (20, ""), (20, "x"), (21, ""), (22, "")])


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a INT, b INT")).collect()}
    up = {x: x for p in pairs for x in p}
    for _ in range(len(up)):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {x: r for x, r in up.items() if any(x in p and p[0] != p[1] for p in pairs)}


# 5 token ids


def test_rans_round_trip():
    rng = np.random.default_rng(3)
    blocks = [rng.zipf(1.3, n).clip(0, 49000).astype(np.uint32) for n in (0, 1, 31, 32, 33, 5000, rans.BLOCK)]
    freq = rans.frequencies(np.bincount(np.concatenate(blocks)))
    assert int(freq.sum()) == 1 << rans.BITS
    done = rans.encode(blocks, rans.Table.of(freq))
    back = rans.decode([(len(b), s, w) for b, (s, w) in zip(blocks, done)], rans.Table.of(freq, decode=True))
    assert all((a == b).all() for a, b in zip(blocks, back))
    one = rans.frequencies(np.array([0, 5]))
    assert rans.decode([(3, *rans.encode([np.ones(3, np.uint32)], rans.Table.of(one))[0])], rans.Table.of(one, decode=True))[0].tolist() == [1, 1, 1]
    many = rans.frequencies(np.concatenate((np.ones(49000, np.int64), [10**12])))
    assert int(many.sum()) == 1 << rans.BITS and many.min() == 1


@pytest.mark.parametrize("which", ["edges", "small"])
def test_tokens(spark, edges, tmp_path, monkeypatch, which):
    docs = edges if which == "edges" else spark.read.parquet(f"{SMALL}/documents.parquet")
    tokens.write(docs, f"file://{tmp_path}/t")
    tok = tokens.WordEncoder.get(tokens.tokenizer_path()).tok
    rows = sorted(docs.collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id)
    at, want = 0, []
    for r in rows:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [1]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    key = lambda r: r[1]
    assert sorted((tuple(r) for r in tokens.digests(spark, f"file://{tmp_path}/t").collect()), key=key) == want
    raw = sorted((tuple(r) for r in tokens.read(spark, f"file://{tmp_path}/t").collect()), key=key)
    assert [(r[0], r[1], r[2], zlib.crc32(bytes(r[3]))) for r in raw] == want


def test_tokens_of_tails_after_other_than_ascii_letters():
    enc = tokens.WordEncoder.get(tokens.tokenizer_path())
    heads = ["stop\u201d", "wait\u2026", "100\u20ac", "fin\u00bb", "\U0001f600", "\u0939\u093f\u0928\u094d\u0926\u0940", "\u0130", "a\x01", "x\u200b", "\u00e9", "e\u0301", "\u4e2d", "\u0663", "A1", "it's", "<|endoftext|>", "\u00d7", "\u2014", ""]
    texts = [h + t for h in heads for t in (".", "!!", ",\u201d.", "'", "')")] + [" ".join(h + "!" for h in heads)]
    ids, n = tokens.encode_texts(pa.array(texts), enc)
    got = np.split(ids, np.cumsum(n)[:-1])
    for t, g in zip(texts, got):
        assert g.tolist() == enc.tok.encode(t, add_special_tokens=False).ids + [1], ascii(t)


def odd_texts(n, seed=1):
    """Texts that mix letters, marks, symbols, NULs, spaces of all kinds, added tokens and ASCII punctuation."""
    rng = random.Random(seed)
    some = [*"aAzZ09'.,!?;:-_()[]<|>\"#$%&*+/=@\\^`{}~ \t\n\x00\x01\x0b\x1c\x7f", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", " ", "  ", "\u0301", "\u0323", "\u0345", "\u0378", "\u093f", "\u0939", "\u200b", "\u200d", "\ufe0f", "\u00a0", "\u2028", "\u0085", "\u3000", "\u201d", "\u2026", "\u20ac", "\u00b0", "\u00df", "\u0130", "\u1e9e", "\u03a3", "\u4e2d", "\u0663", "\u00bd", "\u2167", "\U0001f600", "\U0001f3fd", "\uac00", "\u1100\u1161", "\u00e9", "e\u0301", "\u212b", "the", "Word", "x1"]
    return ["".join(rng.choice(some) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_tokens_of_odd_texts():
    enc = tokens.WordEncoder.get(tokens.tokenizer_path())
    assert enc.by_words
    texts = odd_texts(50_000)
    ids, n = tokens.encode_texts(pa.array(texts), enc)
    got = np.split(ids, np.cumsum(n)[:-1])
    wrong = [t for t, g, w in zip(texts, got, enc.whole(texts)) if g.tolist() != [*w, 1]]
    assert not wrong, [ascii(t) for t in wrong[:5]]


def test_tokens_of_other_tokenizers():
    enc = tokens.WordEncoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    assert not enc.by_words
    texts = [*odd_texts(500), None]
    ids, n = tokens.encode_texts(pa.array(texts), enc, 7)
    assert [g.tolist() for g in np.split(ids, np.cumsum(n)[:-1])] == [[*enc.tok.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]


def test_tokens_of_text_ids_and_repeated_ids(spark, tmp_path):
    rows = [("b", "one two"), ("a", "three"), ("b", "four"), (None, "x"), ("b", "one two")] + [("c", f"text {i}") for i in range(40)]
    got = []
    for k, n in enumerate((1, 7)):
        tokens.write(spark.createDataFrame(rows, "doc_id STRING, text STRING").repartition(n), f"file://{tmp_path}/{k}")
        got.append(sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.digests(spark, f"file://{tmp_path}/{k}").collect()))
    assert got[0] == got[1] and [r[1] for r in got[0]] == [None, "a", *"bbb", *"c" * 40]


def test_tokens_empty_and_damaged(spark, edges, none, tmp_path):
    tokens.write(none, f"file://{tmp_path}/e")
    assert tokens.digests(spark, f"file://{tmp_path}/e").count() == 0
    tokens.write(edges, f"file://{tmp_path}/d")
    b = spark.read.parquet(f"file://{tmp_path}/d/blocks").withColumn("words", F.expr("concat(words, X'00000000')"))
    b.write.parquet(f"file://{tmp_path}/x/blocks")
    spark.read.parquet(f"file://{tmp_path}/d/table").write.parquet(f"file://{tmp_path}/x/table")
    with pytest.raises(Exception, match="damaged"):
        tokens.digests(spark, f"file://{tmp_path}/x").collect()


# 6 backoff


def test_backoff_edges(spark, edges, none, monkeypatch):
    monkeypatch.setattr(backoff, "CHUNK_BYTES", 1 << 16)  # several chunks and hash ranges
    many = {(r.doc_id, r.n_words): r.log_score for r in backoff.scored(edges).collect()}
    monkeypatch.setattr(backoff, "CHUNK_BYTES", 1 << 30)
    once = {(r.doc_id, r.n_words): r.log_score for r in backoff.scored(edges).collect()}
    assert many == pytest.approx(once) and once[1, 0] == 0 and once[2, 0] == 0 and once[4, 10] > once[6, 30000]
    assert backoff.scored(none).count() == 0


def backoff_by_hand(rows, order):
    """(doc_id, log_score) for each row, counting in dictionaries."""
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    own = [Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in texts]
    every = sum(own, Counter())
    out = []
    for (doc, _), w, mine in zip(rows, texts, own):
        rest, total = sum(map(len, texts)) - len(w), 0.0
        for i in range(len(w)):
            factor = 1.0
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                if others := every[gram] - mine[gram]:
                    total += math.log(factor * others / ((every[gram[:-1]] - mine[gram[:-1]]) if n > 1 else rest))
                    break
                factor *= backoff.BACKOFF if n > 1 else 1.0
            else:
                total += math.log(factor / (rest + 1))
        out.append((str(doc), total))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("chunk_bytes", [1 << 11, 1 << 30])
def test_backoff_by_hand(spark, edges, monkeypatch, order, chunk_bytes):
    """Requests for long n-grams that are left out must not change a count, with one chunk or many."""
    monkeypatch.setattr(backoff, "CHUNK_BYTES", chunk_bytes)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(60).union(edges.select("doc_id", "text")).cache()
    got = sorted((str(r.doc_id), r.log_score) for r in backoff.scored(docs, order=order).collect())
    want = sorted(backoff_by_hand([tuple(r) for r in docs.collect()], order))
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], abs=1e-5)
    docs.unpersist()


# 8 mixing


def test_mix(spark, edges, none):
    got = mixing.plan(edges).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
    assert all(abs(t - n) <= 20 and t <= 2 * s for t, n, s in by.values())
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixing.mix(edges).columns == edges.columns
    words = lambda df: df.select(F.sum(mixing.size_of(F.col("text")))).first()[0]
    plan = mixing.plan(docs)
    assert words(mixed) == plan.agg(F.sum("taken")).first()[0]
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, mixing.plan(docs.repartition(5)).collect()))


def test_mix_plan_is_native(spark):
    plan = mixing.mix(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 9 toxicity


def test_toxicity(spark, edges, none):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet").withColumnRenamed("toxic", "y")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    m = toxicity.train(docs, labels.withColumnRenamed("y", "toxic").where(~part))
    got = toxicity.grade(docs, m).join(labels.where(part), "doc_id").collect()
    assert sum(r.toxic for r in got if r.y) >= 0.9 * sum(r.y for r in got)  # of some 300 toxic rows to learn from
    assert sum(not r.toxic for r in got if not r.y) >= 0.995 * sum(not r.y for r in got)
    assert all(0 <= r.severity <= 3 and (r.p_toxic >= 0.5) == r.toxic for r in got)
    assert (np.diff(m.theta) >= 0).all()
    assert not any(r.toxic for r in toxicity.grade(edges, m).collect())
    kept = toxicity.without_toxic(edges, m)
    assert kept.columns == edges.columns and kept.count() == len(edge_rows())
    assert toxicity.grade(none, m).count() == 0
    assert not any(r.toxic for r in toxicity.grade(edges, toxicity.train(none, labels.withColumnRenamed("y", "toxic"))).collect())


def test_ordinal_gradient():
    rng = np.random.default_rng(6)
    n, m = 40, 9
    row, col = np.nonzero(rng.random((n, m)) < 0.4)
    grade, w, theta = rng.integers(0, 4, n), rng.normal(0, 1, m), np.array([-0.7, 0.2, 1.5])
    each = rng.random(n)
    value, dw, dt = toxicity.log_likelihood(w, theta, row, col, grade, each)
    # the likelihood by its definition
    x = np.array([w[col[row == i]].sum() for i in range(n)])
    cdf = lambda k, z: 0.0 if k < 0 else 1.0 if k > 2 else 1 / (1 + math.exp(z - theta[k]))
    assert value == pytest.approx(sum(e * math.log(cdf(g, z) - cdf(g - 1, z)) for g, z, e in zip(grade.tolist(), x.tolist(), each.tolist())) - toxicity.PENALTY / 2 * (w @ w))
    for v, g in ((w, dw), (theta, dt)):
        for i in range(len(v)):
            ends = []
            for e in (1e-6, -1e-6):
                v[i] += e
                ends.append(toxicity.log_likelihood(w, theta, row, col, grade, each)[0])
                v[i] -= e
            assert (ends[0] - ends[1]) / 2e-6 == pytest.approx(g[i], abs=1e-6)


def test_severity_is_graded_by_the_other_half():
    rng = np.random.default_rng(8)
    y, half = rng.integers(0, 2, 120), np.arange(120) % 2
    doc = np.repeat(np.arange(120), 6)
    code = np.where((rng.random(720) < 0.5 * y[doc]), rng.integers(0, 5, 720), rng.integers(5, 50, 720))
    g = toxicity.severity(code, doc, y, half, 50)
    assert (g[y == 0] == 0).all() and set(g[y == 1].tolist()) == {1, 2, 3}
    worst = [np.isin(code[doc == i], range(5)).mean() for i in range(120)]
    assert np.mean([worst[i] for i in range(120) if g[i] == 3]) > np.mean([worst[i] for i in range(120) if g[i] == 1])


# 10 decontamination


def lowered(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_leaks(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = lowered(t), set(), set()
        for item, it in items:
            v = lowered(it)
            k = min(13, len(v))
            for o in range(len(v) - k + 1 if v else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[o : o + k]:
                        hit |= set(range(p, p + k))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [16 << 20, 40])
def test_decontamination_against_brute_force(spark, edges, none, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    a = [f"w{i}" for i in range(30)]
    items = [(1, " ".join(a)), (2, "It's short"), (3, None), (4, "..."), (5, " ".join(a[5:25])), (10, "one"), (10, "one"), (1, " ".join(a[20:])), (6, "b b b b b b b b b b b b b b b")]
    docs = [(100, " ".join(["x", *a[3:22], "y", "It", "S", "short"])), (101, "b " * 20), (102, "ONE-two"), (103, " ".join(a[:12])), (104, " ".join(a + ["z"] + a))]
    rows = [(i, t, "en", "a") for i, t in docs] + edge_rows()
    bench = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    df = frame(spark, rows)
    got = decontaminate.report(df, bench)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=key) == sorted(brute_leaks([(r[0], r[1]) for r in rows], items), key=key)
    long = {r.doc_id: (r.longest_match, r.longest_item, r.longest_at) for r in got.collect()}
    assert long[100] == (19, "1", 1) and long[104] == (30, "1", 0) and long[103][0] == 0
    assert decontaminate.clean(df, bench).columns == df.columns
    assert sorted(r.doc_id for r in decontaminate.clean(df, bench).where("doc_id >= 100").collect()) == [103]
    assert decontaminate.report(edges, bench.where("false")).where("n_hit > 0").count() == 0 and decontaminate.report(none, bench).count() == 0


# pipeline


@pytest.mark.parametrize("block", [16 << 20, 40])
def test_decontamination_goes_by_row(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    leak, leak2 = (" ".join(f"{c}{i}" for i in range(20)) for c in "wv")
    rows = [(1, leak, "en", "a"), (1, "clean one", "en", "a"), (None, leak2, "en", "a"), (None, "clean two", "en", "a"), (None, None, "en", "a"), (2, leak, "en", "a"), (2, leak, "en", "a"), (3, None, "en", "a")]
    bench = spark.createDataFrame([(1, leak), (2, leak2), (3, "other")], "item_id BIGINT, text STRING")
    df = frame(spark, rows)
    got = decontaminate.clean(df, bench)
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, "clean one"), (None, "clean two"), (None, None), (3, None)])


def test_pipeline(spark, tmp_path):
    P = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    graded = toxicity.grade(docs, toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    spared = {r.doc_id for r in graded.where("NOT toxic").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out, tables = docs, {}
    for name, stage in P.STAGES:
        stage(spark, out, SF).write.parquet(f"file://{tmp_path}/{name}")
        before, out = out, spark.read.parquet(f"file://{tmp_path}/{name}")
        tables[name] = out.cache()
        if name != "token_ids":
            assert out.columns == docs.columns
    clean = tables["toxicity"].collect()
    assert {r.doc_id for r in clean} == spared and len(spared) < docs.count()
    rows = sorted(clean, key=lambda r: r.doc_id)
    root, _ = brute_classes([shingles(r.text) for r in rows])
    firsts = {rows[r].doc_id for r in root}
    assert {r.doc_id for r in tables["near_duplicates"].collect()} == firsts
    windows = {tuple(v[o : o + 13]) for _, t in items for v in [lowered(t)] for o in range(max(len(v) - 12, 0))}
    left = set()
    for r in rows:
        if r.doc_id in firsts:
            w = lowered(r.text)
            hit = {j for p in range(len(w) - 12) if tuple(w[p : p + 13]) in windows for j in range(p, p + 13)}
            if not hit:
                left.add(r.doc_id)
    assert {r.doc_id for r in tables["decontamination"].collect()} == left
    mixed = tables["source_mix"].collect()
    assert {r.doc_id for r in mixed} <= left and max(Counter(r.doc_id for r in mixed).values()) <= 2
    tok = tokens.WordEncoder.get(tokens.tokenizer_path()).tok
    want = Counter((r.doc_id, zlib.crc32(np.array(tok.encode(r.text, add_special_tokens=False).ids + [1], "<u4").tobytes())) for r in mixed)
    assert Counter((r.doc_id, r.ids_crc32) for r in tables["token_ids"].collect()) == want


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_on_edges(spark, edges, none, stage):
    P = pytest.importorskip("corpus_pipeline")
    name, f = P.STAGES[stage]
    assert f(spark, none, SMALL).count() == 0
    n = f(spark, edges, SMALL).count()
    assert n > 0 and (stage in (1, 3) or n == len(edge_rows()))


def test_vector_is_finite():
    s, _, _ = stats.structure(pa.array([t for _, t, _, _ in edge_rows()]))
    assert np.isfinite(stats.vector(s)).all()
