"""Fingerprints, Jaccard join, quality rules, classifier and mixing on small frames, against brute force."""

import collections
import hashlib
import itertools
import random
import statistics
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubline.llm import classifier, common, fingerprints, jaccard, links, mixing, rules, shingles

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, copies int, node string, row string"
LONG = " ".join(f"w{i * i % 977}" for i in range(60_000))


def words(text):
    return (text or "").encode().split()


def shingle_set(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, copies, near copies, repeated rows, an id used twice, and columns named like inner ones."""
    base = " ".join(f"word{i}" for i in range(200))
    near = [base.replace(f"word{k} ", f"other{k} ") for k in (3, 50, 120, 199)]
    texts = [base, base, *near, None, "", "  \n", "two words", "two\twords", LONG, LONG + " more", "a b c d e", "a b c d e", "ümlaut " * 12]
    rows = [(i, t, "en" if i % 3 else None, "s1" if i % 2 else None, i, "n", "r") for i, t in enumerate(texts)]
    rows += [(5, "another text under a used id", "en", "s1", 0, "n", "r"), (None, base, "de", "s2", 0, "n", "r"), (None, "alone without id", None, None, 0, None, None), rows[0]]
    return spark.createDataFrame(rows, DOCS)


def test_word_hashes_follow_words():
    texts = ["a b  c", " a\tb\nc ", "", "é é", "ab c", "x" * 300_000 + " y"]
    hashes, first = shingles.word_hashes([t.encode() for t in texts])
    own = [hashes[a:b].tolist() for a, b in itertools.pairwise(first)]
    assert [len(x) for x in own] == [3, 3, 0, 2, 2, 2] and own[0] == own[1] and own[3][0] == own[3][1] and own[0][0] != own[4][0]


def test_minhash_estimates_jaccard():
    rng, hasher = random.Random(1), shingles.MinHash(128)
    errors = []
    for _ in range(60):
        w = [f"t{rng.randrange(5000)}" for _ in range(rng.randrange(50, 400))]
        cut = rng.randrange(len(w))
        a, b = " ".join(w), " ".join(w[:cut] + [f"u{rng.randrange(5000)}" for _ in range(len(w) - cut)])
        x, y = hasher([a.encode(), b.encode()])
        errors.append(float((x == y).mean()) - similarity(a, b))
    assert abs(statistics.mean(errors)) < 0.02 and max(map(abs, errors)) < 0.2


def expected_successors(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    for (key, a), (_, b) in zip(rows, rows[1:] + rows[:1]):
        a, b = a or "", b or ""
        k = len(a) // 4
        yield key, len(a), hashlib.sha256((a[:len(a) - k] + b[:k]).encode()).hexdigest(), similarity(a, a[:len(a) - k] + b[:k]), similarity(a, b)


@pytest.mark.parametrize("source", ["odd", "table", "one"])
def test_successors(spark, odd, source):
    df = {"odd": odd, "table": spark.read.parquet(f"{SF}/documents.parquet"), "one": odd.where("doc_id = 3")}[source]
    expected = list(expected_successors([tuple(r) for r in df.select("doc_id", "text").collect()]))
    found = fingerprints.with_successor(df).collect()
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == collections.Counter(e[:3] for e in expected)
    by = {(e[0], e[2]): e for e in expected}
    for r in found:
        _, _, _, edited, after = by[r.doc_id, r.edited_sha256]
        assert abs(r.near_edited - edited) < 0.25 and abs(r.near_next - after) < 0.25


def test_fingerprints_of_equal_texts(odd):
    rows = fingerprints.fingerprints(odd.withColumn("fingerprint", F.lit(1))).select("text", "fingerprint").collect()
    of = collections.defaultdict(set)
    for r in rows:
        of[b" ".join(words(r.text))].add(r.fingerprint)
    # a long text and the same with one word more may well agree in all minima
    assert all(len(x) == 1 for x in of.values()) and len({next(iter(x)) for x in of.values()}) >= len(of) - 1


def brute_links(rows):
    """Per row number: the class's members and the number of linked rows."""
    n = len(rows)
    part, count = list(range(n)), [0] * n
    for i, j in itertools.combinations(range(n), 2):
        a, b = rows[i][1], rows[j][1]
        if words(a) == words(b) or shingle_set(a) and shingle_set(b) and similarity(a, b) >= 0.8:
            count[i] += 1
            count[j] += 1
            x, y = part[i], part[j]
            part = [min(x, y) if p in (x, y) else p for p in part]
    return part, count


@pytest.mark.parametrize("find", [jaccard.jaccard_join, fingerprints.near_duplicates])
def test_links_against_all_pairs(spark, odd, find):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    part, count = brute_links(rows)
    lowest = {p: min((r[0] for r, q in zip(rows, part) if q == p and r[0] is not None), default=None) for p in set(part)}
    expected = collections.Counter((r[0], lowest[p], c) for r, p, c in zip(rows, part, count))
    assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in find(odd).collect()) == expected


def test_links_of_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").orderBy("doc_id").collect()]
    part, count = brute_links(rows)
    expected = {r[0]: (rows[p][0], c) for r, p, c in zip(rows, part, count)}
    assert {r.doc_id: (r.class_id, r.n_links) for r in fingerprints.near_duplicates(df).collect()} == expected


def test_crowd_in_many_tiles(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(links, "CHUNK", 8)
    monkeypatch.setattr(links, "PAIRS", 50)
    part, count = brute_links(rows)
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {r[0]: (rows[p][0], c) for r, p, c in zip(rows, part, count)}


def test_tiles_without_survivors():
    rng = np.random.default_rng(2)
    members = [{"high_side": False, "node": bytes([i]), "signature": rng.integers(0, 1 << 16, 128).astype(np.uint16).tobytes()} for i in range(5)]
    for survive in (jaccard.pruner(128), None):
        assert links._forest([(0, 0, 0, members), (1, 0, 0, members[:1])], 4, survive).num_rows == 0


def test_parts_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 200)]
    found = {r.node: r.root for r in links.parts(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 140)}, 200: 200, 300: 200}


def test_pruning_keeps_what_may_reach_the_threshold():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (4000, 128)).astype(np.uint16)
    for s, low, high in ((0.8, 0.999, 1), (0.9, 0.999, 1), (0.3, 0, 0.01), (0.0, 0, 0)):
        b = np.where(rng.random(a.shape) < s, a, a ^ 1)
        kept = len(jaccard.pruner(128)(a, b)) / len(a)
        assert low <= kept <= high
    assert jaccard.least_agreements(16, Fraction(4, 5), 1e-6) < 16 * 0.5


def test_links_where_one_id_stands_for_many_texts(spark):
    """Different, near and repeated texts under one id: each text is looked up by itself, not by all of its id."""
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(40)]
    texts = base + [x + " more" for x in base[:20]] + base[:10] * 3 + [x.replace(" ", "  ") for x in base[5:15]]
    rows = [(7 if i % 3 else None if i % 2 else 7 + i, x) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    part, count = brute_links(rows)
    lowest = {p: min((r[0] for r, q in zip(rows, part) if q == p and r[0] is not None), default=None) for p in set(part)}
    expected = collections.Counter((r[0], lowest[p], c) for r, p, c in zip(rows, part, count))
    assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_join(df).collect()) == expected
    kept = jaccard.one_of_each(df.withColumn("own", F.lit(1)).withColumn("Said", F.lit("x")))
    assert kept.columns == ["doc_id", "text", "own", "Said"] and kept.count() == len(set(part))


def test_one_of_each_keeps_columns_and_one_row_a_class(odd):
    kept = jaccard.one_of_each(odd)
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    part, _ = brute_links(rows)
    assert kept.columns == odd.columns and kept.count() == len(set(part))


def test_one_of_each_keeps_different_texts_under_one_id(spark):
    near = " ".join(f"word{i}" for i in range(100))
    rows = [(1, "one text of its own"), (1, "and quite another one here"), (1, "one  text of its own"), (2, near), (2, near.replace("word50", "x")), (3, near)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [1, 1, 2] and {" ".join(r.text.split()) for r in kept if r.doc_id == 1} == {rows[0][1], rows[1][1]}


def test_rules_count_words_and_lines():
    text = "a a a a\nb # c|\n\n b\nb # c|\n" + "x\xa0y z"
    w = text.encode().split()
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    twice = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)}
    assert rules.count_text(text) == (len(w), sum(len(x.decode()) for x in w), 4, 5, 1, len(twice))
    assert rules.count_text("") == (0, 0, 0, 0, 0, 0) and rules.count_text("a b c") == (3, 3, 0, 1, 0, 0)
    rng = random.Random(2)
    for _ in range(50):
        w = [bytes([97 + rng.randrange(4)]) for _ in range(rng.randrange(40))]
        tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        assert rules.repeated_words(w) == len({i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)})


def test_rules_on_odd_rows(odd):
    found = rules.quality_rules(odd, keep=["doc_id", "copies"]).collect()
    assert len(found) == odd.count()
    for r in found:
        assert not (r.base_failed and r.kept) and r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert any(r.kept for r in found)


def test_sketches_are_near_quantiles_and_merge(spark):
    values = [int(10 ** (i % 50 / 10)) for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    for v, b in df.select("v", rules.sketch_bucket(F.col("v")).alias("b")).distinct().collect():
        assert b <= v and (v < 64 and b == v or v - b < v / 32)


def test_rules_reject_outliers_and_keep_the_rest(spark):
    rng = random.Random(5)
    clean = [(i, " ".join(f"{rng.choice('abcdefgh') * 3}{rng.randrange(10**6)}" for _ in range(80)), "en", f"s{i % 3}") for i in range(300)]
    junk = [(1000 + i, " ".join(f"w{rng.randrange(10**6)}***" for _ in range(80)), "en", f"s{i % 3}") for i in range(10)]
    kept = {r.doc_id for r in rules.quality_rules(spark.createDataFrame(clean + junk, "doc_id bigint, text string, lang string, source string")).where("kept").collect()}
    assert kept == set(range(300))


def plain_fence(own, lang, whole, slack, low):
    weights = collections.Counter({b: n * rules.UNIT for b, n in own.items()})
    for larger in (lang, whole):
        weights.update({b: n * rules.STEADY * rules.UNIT // sum(larger.values()) for b, n in larger.items()})
    total = sum(weights.values())
    q1, q3 = (next(b for b in sorted(weights) if 4 * sum(w for x, w in weights.items() if x <= b) >= k * total) for k in (1, 3))
    reach = (q3 - q1) * rules.SPREAD + slack
    return (q1 - reach if low else 0), q3 + reach


def test_fences_equal_plain_ones_at_every_size(spark):
    rng = random.Random(8)
    sizes = {("en", "a"): 499, ("en", "b"): 500, ("en", "c"): 501, ("de", "a"): 37, (None, "a"): 3, (None, None): 1}
    rows = [(lang, source, False, 50 + rng.randrange(200), rng.randrange(90), 900 + rng.randrange(500) * (i + 1)) for i, ((lang, source), n) in enumerate(sizes.items()) for _ in range(n)]
    df = spark.createDataFrame(rows, "lang string, source string, base_failed boolean, n_words bigint, n_symbols bigint, word_chars bigint")
    df = df.withColumns({c: F.lit(0).cast("bigint") for c in ("n_lines", "n_dup_lines", "n_repeat_words")})
    found = {(r.fence_lang, r.fence_source): r.fence for r in rules.fences(df).collect()}
    assert set(found) == set(sizes)

    def bucket(v):
        return v - v % (1 << max(v.bit_length() - 6, 0))

    for m, value in (("symbols", lambda r: 1000 * r[4] // r[3]), ("word_length", lambda r: 100 * r[5] // r[3])):
        _, slack, low = rules.MEASURES[m]
        for lang, source in sizes:
            own, by_lang, whole = (collections.Counter(bucket(value(r)) for r in rows if take(r)) for take in (
                lambda r: r[:2] == (lang, source), lambda r: r[0] == lang, lambda r: True))
            fence = found[lang, source]
            assert (fence[f"{m}_low"], fence[f"{m}_high"]) == plain_fence(own, by_lang, whole, slack, low)


@pytest.mark.parametrize("n", [40, 490, 510])
def test_a_text_is_judged_by_its_group_whatever_its_size(spark, n):
    def words(length):
        return " ".join("".join(rng.choices("abcdefgh", k=length)) for _ in range(60))

    rng = random.Random(9)
    rows = [(i, words(4), "en", "short") for i in range(n)] + [(10_000 + i, words(12), "en", "long") for i in range(n)]
    rows += [(-1, words(12), "en", "short"), (-2, words(4), "en", "long")]
    found = rules.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"))
    assert {r.doc_id for r in found.where("not kept").collect()} == {-1, -2}


def test_classifier_held_out(spark):
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = classifier.train(df, labels, teaches=~held)
    rows = classifier.score(df, model).join(labels, "doc_id").where(held).select("score", "quality").collect()
    good, poor = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert statistics.mean(g > p for g in good for p in poor) > 0.97
    assert statistics.mean((r.score >= 0.3) == r.quality for r in rows) > 0.95


def test_the_sample_is_a_bound_for_repeated_ids(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id % 2 as doc_id", "concat(if(id % 2 = 0, 'good word ', 'bad term '), id, ' more') as text")
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id bigint, quality int")
    given, own = [], classifier.fit
    monkeypatch.setattr(classifier, "fit", lambda ratio, drawn, n: given.append((drawn, n)) or own(ratio, drawn, n))
    model = classifier.train(rows, labels, sample=100)
    drawn, n = given[0]
    assert len(drawn) == 200 and n.tolist() == [1500, 1500]
    scores = classifier.score(rows, model).groupBy("doc_id").agg(F.avg("score").alias("s")).collect()
    assert {r["doc_id"]: r["s"] > 0.5 for r in scores} == {0: False, 1: True}


def test_classifier_counts_and_optimum_equal_a_plain_computation(spark):
    """Log-count ratios from sets of features, and the dual optimum of the same loss by plain projected steps."""
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"][: 3 + 3 * (i % 2)]) for _ in range(12)), i % 2) for i in range(60)]
    texts = [r[1] for r in rows]
    y = np.array([r[2] for r in rows])
    own = list(classifier.features([t.encode() for t in texts]))
    counts = np.zeros((2, classifier.BUCKETS))
    for label, f in zip(y, own):
        counts[label][f] += 1
    n = np.bincount(y)
    expected = np.log((counts[1] + 1) / (n[1] + 2)) - np.log((counts[0] + 1) / (n[0] + 2))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = classifier.train(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    np.testing.assert_allclose(model.ratio, expected, atol=1e-12)
    vectors = []
    for f in own:
        v = expected[f]
        vectors.append((f, v / np.sqrt(v @ v) if (v @ v) else v))
    sign, cost = 2 * y - 1, np.full(60, 0.7)
    w, bias = classifier.descend(vectors, sign, cost, classifier.BUCKETS)
    used = sorted({int(j) for f, _ in vectors for j in f})
    dense = np.zeros((60, len(used) + 1))
    for i, (f, v) in enumerate(vectors):
        dense[i, np.searchsorted(used, f)] = v
    dense[:, -1] = 1.0  # the bias is the weight of a constant
    gram = (dense @ dense.T) * np.outer(sign, sign)

    def dual(a):
        return a.sum() - 0.5 * a @ gram @ a
    a = np.zeros(60)
    for _ in range(20_000):
        a = np.clip(a + 0.01 * (1 - gram @ a), 0, cost)
    margins = np.array([w[f] @ v + bias for f, v in vectors]) * sign
    primal = 0.5 * (w @ w + (bias / dense[0, -1]) ** 2) + (cost * np.maximum(0, 1 - margins)).sum()
    assert primal == pytest.approx(dual(a), rel=0.02)


def test_classifier_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(0, 1), (0, 0), (3, 1), (9, 0), (None, 1), (6, None), (4, 7), (777, 0)], "doc_id bigint, quality int")
    found = classifier.score(odd.withColumn("score", F.lit("x")), classifier.train(odd, labels))
    assert found.count() == odd.count() and all(0 <= r.score <= 1 for r in found.select("score").collect())
    for some, share in ((labels.where("quality = 1"), 4 / 5), (labels.limit(0), 1 / 2)):
        taught = classifier.train(odd, some)  # id 0 has two rows, id 3 one
        assert {round(r.score, 6) for r in classifier.score(odd, taught).select("score").collect()} == {share}


def test_longest_runs():
    texts = ["a a b b b a", "", "b", "b b", "x y", " ", "a b a"]
    words, first = shingles.word_hashes([t.encode() for t in texts])
    assert classifier.longest_runs(words, first).tolist() == [3, 0, 1, 2, 1, 0, 1]


def test_descent_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 5))
    y = np.where(x[:, 0] - x[:, 1] > 0, 1, -1)
    w, b = classifier.descend([(np.arange(5), v) for v in x], y, np.full(80, 100.0), 5, 500)
    assert ((x @ w + b) * y > 0).mean() > 0.97
    for size in (3, 9000):
        own = np.sort(rng.choice(classifier.BUCKETS, size, replace=False))
        assert (classifier._unpack(classifier._pack(own)) == own).all()


def poured(sizes, weights, cap=3):
    left, among, out = dict(sizes), dict(weights), {}
    rest = sum(sizes.values())
    while True:
        full = [s for s in left if rest * among[s] / sum(among.values()) > cap * sizes[s]]
        if not full:
            return {**out, **{s: rest * among[s] / sum(among.values()) for s in left}}
        for s in full:
            out[s] = cap * sizes[s]
            rest -= out[s]
            del left[s], among[s]


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:02}": rng.choice([1, 10, 100, 1000, 10**6]) * rng.randrange(1, 9) for i in range(12)}
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    found = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size bigint")).collect()}
    assert found == pytest.approx(poured(sizes, weights))


def test_mix_comes_near_targets(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randrange(1, 40), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for weight in (None, "wt"):
        mixed = mixing.mix_sources(df.withColumn("wt", F.col("doc_id") % 5 + 1.0), weight=weight)
        by = mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
        assert len(by) == 4 and all(abs(r.taken - r.target) <= 40 and r.most <= 3 for r in by)
        again = mixing.mix_sources(df.repartition(7).withColumn("wt", F.col("doc_id") % 5 + 1.0), weight=weight)
        assert mixed.select("doc_id", "copies").exceptAll(again.select("doc_id", "copies")).isEmpty()
    more = [r.copies for r in mixed.where("source = 'a' and wt = 5").collect()], [r.copies for r in mixed.where("source = 'a' and wt = 1").collect()]
    assert statistics.mean(more[0]) > 2 * statistics.mean(more[1])


def test_mix_on_odd_rows(odd):
    mixed = mixing.mix_sources(odd)
    rows = mixed.collect()
    assert len(rows) == odd.count() and set(odd.columns) <= set(mixed.columns)
    assert all(r["size"] == len(words(r.text)) and 0 <= r.copies <= 3 for r in rows) and all(r.copies == 0 for r in rows if not r["size"])


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    for df in (fingerprints.with_successor(none), fingerprints.near_duplicates(none), jaccard.jaccard_join(none), jaccard.one_of_each(none),
               rules.quality_rules(none), mixing.mix_sources(none), classifier.score(none, classifier.train(none, labels))):
        assert df.count() == 0


def test_fraction_is_in_the_open_interval(spark):
    rows = spark.range(2000).select(common.fraction(F.lit("x"), F.col("id")).alias("f")).collect()
    assert all(0 < r.f < 1 for r in rows) and 0.45 < statistics.mean(r.f for r in rows) < 0.55
