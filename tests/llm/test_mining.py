"""Collocations, spelling variants and island packing on small frames, against brute force."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from scrubline.llm import collocations, islands, variants
from scrubline.llm.queries import word_tokenizer_path

DOCS = "doc_id bigint, text string, lang string, n bigint, word string, words string, length int, draw int, id int"


def frame(spark, rows):
    """Rows of (doc_id, text, lang), with columns named like inner ones."""
    return spark.createDataFrame([(*r, 7, "w", "x", 1, 2, 3) for r in rows], DOCS)


def said(rng, words, n):
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!? "]) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    words = ["New", "york", "The", "the", "ha", "été", "x1", "日本", "a|b", "\x1c", "of"]
    rows = [(i, said(rng, words, rng.randrange(0, 60)), ["en", "de", None][i % 3]) for i in range(60)]
    rows += [(i, "ha ha ha ha ha ha ha ha ha ha ha ha, new york city hall", "en") for i in range(15)]
    rows += [(1, None, "en"), (1, "", None), (None, " \t\n", "en"), (None, "alone", "fr"), (3, said(rng, words, 6000), "en"), rows[0], rows[0], (None, None, None)]
    return rows


def brute_collocations(rows, max_words, least, inside, limit):
    f, total = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for size in range(1, max_words + 1):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i : i + size])] += 1
    out = []
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, p), a in candidates.items():
        if any(l == lang and len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (l, q), b in candidates.items()):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    ranked = []
    for lang, own in itertools.groupby(sorted(out), key=lambda r: r[0]):
        for rank, (_, score, a, phrase, left, right) in enumerate(itertools.islice(own, limit), 1):
            ranked.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return ranked


@pytest.mark.parametrize("max_words, least, inside, limit, chunk", [(3, 10, 50, 2000, 1 << 21), (3, 2, 80, 7, 50), (2, 1, 50, None, 100), (4, 3, 30, 40, 1000), (5, 2, 50, None, 300)])
def test_collocations_equal_brute_force(spark, odd, max_words, least, inside, limit, chunk):
    found = collocations.collocations(frame(spark, odd).repartition(5), max_words=max_words, least=least, inside=inside, limit=limit, chunk=chunk)
    assert sorted(map(tuple, found.collect())) == brute_collocations(odd, max_words, least, inside, limit)
    assert found.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *((c, "bigint") for c in ("a", "l", "r", "n", "score"))]


def test_collocations_of_nothing(spark):
    for rows in ([], [(1, None, None), (2, "", "en"), (3, ". , !", "en")]):
        assert collocations.collocations(frame(spark, rows)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(0, "aa bb", "en")] * 3
    found = collocations.collocations(frame(spark, rows), least=1).collect()
    assert [(r["phrase"], r["score"]) for r in found] == [("aa bb", 1000000)]
    big = spark.range(1).selectExpr("4000000000L as a", "5000000001L as l", "4000000003L as r")
    exact = big.selectExpr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as s").head()[0]
    assert exact == 1000000 * 4000000000**2 // (5000000001 * 4000000003)


def test_hashes_that_meet_lead_to_the_next_seed(spark, monkeypatch):
    texts = collocations.prepared(frame(spark, [(1, "a b c a", "en"), (2, "b", "de")]), "text", "lang")
    words, seed = collocations.dictionary(texts)
    assert seed == 0 and sorted(map(tuple, words.select("lang", "word").collect())) == [("de", "b"), ("en", "a"), ("en", "b"), ("en", "c")]

    class Meeting(collocations.Ids):
        def __missing__(self, word):
            number = super().__missing__(word)
            if self.seed == 0:
                self.hashes[number] = 5
            return number
    monkeypatch.setattr(collocations, "Ids", Meeting)
    words, seed = collocations.dictionary(texts)
    assert words.count() == 4 and seed in (0, 1)  # workers import the class anew unless it travels by value


def test_wide_rows_are_counted_exactly():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 1 << 20, 5000) % 40 + (1 << 20) for _ in range(6)]
    found, n = collocations.count_rows(columns, 1 << 21)
    expected = collections.Counter(zip(*(c.tolist() for c in columns)))
    assert dict(zip(zip(*(c.tolist() for c in found)), n.tolist())) == expected


def test_paths_hold_every_edge_once_and_cannot_grow(spark):
    rng = random.Random(3)
    edges = {tuple(w): rng.randrange(5, 9) for w in ([1, 2, 3], [2, 3, 4], [3, 4, 5], [4, 5, 6], [9, 2, 3], [4, 5, 7], [20, 20, 20], [30, 31, 30], [31, 30, 31])}
    chain = list(range(100, 2600))
    edges |= {tuple(chain[i : i + 3]): 4 for i in range(len(chain) - 2)}
    paths = collocations.compact(spark.createDataFrame([(list(w), n) for w, n in edges.items()], "words array<bigint>, n bigint")).collect()
    seen = collections.Counter()
    for p in paths:
        assert len(p["words"]) == len(p["weights"]) + 2
        for i, n in enumerate(p["weights"]):
            gram = tuple(p["words"][i : i + 3])
            assert edges[gram] == n
            seen[gram] += 1
    assert set(seen) == set(edges) and set(seen.values()) == {1}
    assert sorted(len(p["weights"]) for p in paths if p["words"][0] < 10) == [1, 1, 1, 1, 2]
    assert sorted(len(p["weights"]) for p in paths if 100 <= p["words"][0] < 2600) == [450, 1024, 1024]


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    form, out = {}, []
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
        out.append((w, n, len(near)))
    rows = []
    for w, n, n_near in out:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, n_near, counts[form[w]] if form[w] is not None else None))
    return sorted(rows)


@pytest.mark.parametrize("cuts, chunk, matrix", [(3, 256, 256), (1, 7, 5), (2, 3, 16), (5, 50, 1), (40, 256, 256)])
def test_variants_equal_brute_force(spark, cuts, chunk, matrix):
    rng = random.Random(cuts)
    counts = {"".join(rng.choices("ab日", k=rng.randrange(0, 8))): rng.randrange(1, 200) for _ in range(250)}
    counts |= {"aaaa\0": 3, "aaaa": 9, "a" * 60: 2, "a" * 61: 4, "a" * 59 + "b": 8, "\U0001f600aaaa": 1, "\U0001f600aaa": 5}
    words = spark.createDataFrame([*counts.items(), (None, 4)], "word string, n bigint")
    found = variants.spelling_variants(words, cuts=cuts, chunk=chunk, matrix=matrix)
    assert sorted(map(tuple, found.select("word", "form", "root", "n", "n_near", "form_n").collect())) == brute_variants(counts)


def test_a_hot_bucket_is_cut_into_tiles(spark):
    counts = {f"prefix{a}{b}suffix": 1 + ord(a) * ord(b) % 50 for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"}
    words = spark.createDataFrame([*counts.items()], "word string, n bigint")
    tiled = variants.tiles(variants.buckets(words), 16).groupBy("longer", "cut", "shared", "i", "j").count()
    assert tiled.agg({"count": "max"}).head()[0] < 80
    found = variants.spelling_variants(words, chunk=16)
    assert sorted(map(tuple, found.select("word", "form", "root", "n", "n_near", "form_n").collect())) == brute_variants(counts)


def test_words_of_texts(spark):
    rng = random.Random(8)
    texts = [(i, said(rng, ["Hello", "héllo×÷ÿ", "WORLD", "ÉTÉs", "worlds9worlds", "日helloĀhello", "aaaaaa", "it's"], 40), "en") for i in range(120)]
    texts += [(None, "hello hello", "en"), (1, None, "en"), (2, "", None), texts[3], (5, "hello " * 30_000, "en")]
    counts = collections.Counter()
    for key, text, _ in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    expected = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert any(w not in expected for w in counts) and any(len(w) == 4 for w in counts)
    assert {r["word"]: r["n"] for r in variants.word_counts(frame(spark, texts).repartition(4)).collect()} == expected


def test_variants_of_nothing(spark):
    empty = frame(spark, [])
    assert variants.spelling_variants(variants.word_counts(empty)).count() == 0


def test_word_encoder_equals_the_library():
    with open(word_tokenizer_path(), encoding="utf-8") as f:
        encode = islands.WordEnds(f.read())
    rng = random.Random(1)
    chars = [chr(i) for i in range(0x250)] + list(" \n\t'stredm'''  09") * 12
    texts = ["".join(rng.choices(chars, k=rng.randrange(0, 80))) for _ in range(1500)]
    texts += ["İ x", "ΑΣ Σ", "日本 ☕ a", "<|endoftext|> hi", "a" * 300 + " b", "'s'll 'RE don'T", "é ö", "x\x85y\xa0z", "x\x1cy", "", "  ", "☀ sun ☀", "stop... STOP!!! (what?)"]
    for batch in (texts, texts, texts[:7]):  # known parts the second time
        for text, ids in zip(batch, encode(batch)):
            assert np.frombuffer(ids, "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.fixture(scope="module")
def packed(spark):
    rng = random.Random(2)
    texts = [(i, said(rng, ["some", "Words", "42", "café", "日本"], rng.randrange(0, 400)), "en") for i in range(300)]
    texts += [(None, None, None), (None, "", "en"), (7, "a b c", "en"), (7, "a b c", "en"), (8, "word " * 20_000, "en")] + [(9, "same text", "en")] * 100
    cut = islands.pieces(frame(spark, texts).repartition(3), word_tokenizer_path(), length=512)
    return texts, islands.pack(cut, length=512, shard=50).toPandas()


def test_pieces_equal_the_library(packed):
    texts, found = packed
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(word_tokenizer_path())
    expected = []
    for key, text, _ in texts:
        ids = [*encode.encode(text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 512):
            own = ids[at : at + 512]
            expected.append((-1 if key is None else key, at // 512, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    rows = found.assign(doc_id=found.doc_id.fillna(-1).astype(int))[["doc_id", "piece", "start", "length", "ids_crc32"]]
    assert sorted(map(tuple, rows.values.tolist())) == sorted(expected)


def test_sequences_are_gapless_and_few(packed):
    _, found = packed
    for _, own in found.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        ends = own["length"].cumsum()
        assert ends.iloc[-1] <= 512 and (own["offset"] == ends - own["length"]).all()
    bound = -(-found["length"].sum() // 512)
    assert found["sequence_id"].nunique() <= 1.02 * bound + 1


def test_a_child_keeps_every_piece_and_whole_bins():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 60, 300)
    a, b = (islands.first_packing(sizes, 100, g) for g in (None, rng))
    for _ in range(30):
        child = islands.crossed(sizes, a, b, 100, rng)
        assert len(child) == 300 and child.min() == 0 and islands.loads_of(sizes, child).max() <= 100
        assert (np.bincount(child) > 0).all()
        whole = {frozenset(np.flatnonzero(b == k).tolist()) for k in range(b.max() + 1)}
        assert any(frozenset(np.flatnonzero(child == k).tolist()) in whole for k in range(child.max() + 1))


def test_evolution_finds_packings_that_best_fit_misses():
    rng = np.random.default_rng(0)
    gained = 0
    for _ in range(8):  # bins of three that fit exactly
        cuts = np.sort(rng.integers(260, 480, (40, 2)), axis=1)
        sizes = np.concatenate([cuts[:, 0], 1000 - cuts[:, 1] + 0, cuts[:, 1] - cuts[:, 0]])
        sizes = sizes[sizes > 0]
        first = islands.first_packing(sizes, 1000, None)
        population = [first, *(islands.first_packing(sizes, 1000, rng) for _ in range(7))]
        best = islands.evolve(sizes, population, 1000, 300, rng)[0]
        assert islands.loads_of(sizes, best).max() <= 1000
        assert islands.fitness(sizes, best, 1000) >= islands.fitness(sizes, first, 1000)
        gained += islands.fitness(sizes, best, 1000) > islands.fitness(sizes, first, 1000)
    assert gained >= 4


def test_elites_move_to_the_next_island(spark):
    rows = [(1, i, b"", [bytes([i]), b"x"], float(i), False) for i in range(3)] + [(2, 0, b"", [b"only", b"y"], 0.0, False)]
    moved = islands.migrated(spark.createDataFrame(rows, islands.STATE), 3).collect()
    assert {(r["shard"], r["island"]): bytes(r["packings"][1]) for r in moved} == {(1, 0): b"\x02", (1, 1): b"\x00", (1, 2): b"\x01", (2, 0): b"y"}


def test_packing_of_nothing(spark):
    assert islands.pack(islands.pieces(frame(spark, []), word_tokenizer_path())).count() == 0
