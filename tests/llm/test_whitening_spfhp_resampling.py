"""Whitening, shortest-pack-first packing and importance resampling against brute force, and on odd input."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import packing, resampling, spfhp, whitening

DIR = "/root/testdata/sf0.001"
ODD = [
    (1, None, "a", "x"), (2, "", None, None), (3, " \n\t ", "a", "x"), (4, "one", "a", "x"), (5, "same words here and there " * 20, "a", "x"), (5, "same words here and there " * 20, "a", "x"),
    (None, "no id at all", "b", None), (7, "long " * 30_000 + "word", "a", "x"), (8, "é漢字😀 A1-b2 " * 30, "c", "x"), (9, "<|endoftext|> in a text", "c", "x"),
]
SCHEMA = "doc_id long, text string, row string, rank string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


# ---- whitening


def exact(rows):
    """n, S and n X'X - S S' of distinct vectors, in plain whole numbers."""
    n, d = len(rows), len(rows[0])
    sums = [sum(r[i] for r in rows) for i in range(d)]
    return n, sums, [[n * sum(r[i] * r[j] for r in rows) - sums[i] * sums[j] for j in range(d)] for i in range(d)]


def test_products_of_any_size_are_exact():
    rng = np.random.default_rng(3)
    for bits in (3, 19, 20, 21, 40, 60):
        x = rng.integers(-(2**bits), 2**bits, (50, 4))
        x[0], x[1] = 2**bits, -(2**bits)
        s = whitening.Scatter(4)
        for at in range(0, 50, 7):
            s.add(x[at : at + 7])
        rows = [[int(v) for v in r] for r in x]
        assert s.sums.tolist() == [sum(r[i] for r in rows) for i in range(4)]
        assert s.products.tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(4)] for i in range(4)]


def test_whitening_against_fractions(spark):
    rng = np.random.default_rng(5)
    data = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 3).astype(np.float32)
    rows = [(k, [float(c) for c in r], 1, "y") for k, r in enumerate(data)]
    rows += [(k, rows[0][1], 1, "y") for k in range(1000, 1100)]  # a hot vector counts once
    rows += [(7, rows[3][1], 1, "y"), (None, rows[4][1], 1, "y"), (2000, None, 1, "y"), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, "y"), (2002, [float("nan")] * 6, 1, "y"), (2003, [float("inf")] * 6, 1, "y"), (2004, [], 1, "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, x string").repartition(5)
    got = defaultdict(list)
    for r in whitening.whiten(df).collect():
        got[r.vec_id].append(r)
    x = [[math.floor(256 * c) for c in r[1]] for r in rows[:300]]
    distinct = [list(v) for v in sorted({tuple(v) for v in x})]
    n, sums, scattered = exact(distinct)
    covariance = np.array([[float(Fraction(v, n * n)) for v in r] for r in scattered])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:4], vectors.T[::-1][:4]
    assert len(got[7]) == 8 and len(got[None]) == 4 and not {2000, 2001, 2002, 2003, 2004} & set(got) and len(got) == 401
    signs = None
    for k in range(300):
        mine = sorted(got[k], key=lambda r: r.component)[:: 2 if k == 7 else 1]
        assert [r.component for r in mine] == [1, 2, 3, 4] and {r.n for r in mine} == {n}
        if k != 7:
            assert {r.deviation for r in mine} == {sum((n * a - s) ** 2 for a, s in zip(x[k], sums))}
            want = vectors @ (np.array([float(Fraction(n * a - s, n)) for a, s in zip(x[k], sums)])) / np.sqrt(values)
            found = np.array([r.whitened for r in mine])
            signs = np.sign(found * want) if signs is None else signs
            assert np.allclose(found, want * signs, rtol=1e-9, atol=1e-9)
        assert np.allclose([r.explained for r in mine], values / np.trace(covariance), rtol=1e-9)
        assert all(r.identity_error < 1e-9 for r in mine)


def test_whitening_of_odd_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], schema)).collect()
    assert len(one) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    flat = whitening.whiten(spark.createDataFrame([(k, [k / 256, 2 * k / 256, 7.0]) for k in range(9)], schema)).collect()
    assert len(flat) == 27 and {r.component: r.whitened is None for r in flat} == {1: False, 2: True, 3: True}
    assert all(r.identity_error < 1e-9 for r in flat)
    mixed = whitening.whiten(spark.createDataFrame([(k, [float(k * k), float(k)][: 1 + k % 2]) for k in range(20)], schema)).collect()
    assert Counter(r.component for r in mixed) == {1: 20, 2: 10} and {r.n for r in mixed} == {10}
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1e15, 2.0])], schema)).collect()
    assert len(huge) == 6 and all(r.deviation is None for r in huge) and all(math.isfinite(r.whitened) for r in huge if r.whitened is not None)
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.scatter_entries(spark.createDataFrame([], schema)).count() == 0
    some = whitening.scatter_entries(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, -1.0])], schema)).collect()
    assert {(r.i, r.j): int(r.entry) for r in some} == {(1, 1): 65536, (2, 1): -3 * 65536, (2, 2): 9 * 65536}


# ---- packing


def sound(rows, texts, capacity=2048):
    """What holds of any packing: whole documents, their ids, gapless sequences; gives what is padded."""
    encode = packing.encoder(packing.tokenizer_path()).ids
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, (text, copies) in texts.items():
        ids = np.append(encode(text or ""), 1).astype("<u4")
        covered = np.zeros(len(ids), int)
        for r in by_doc[doc_id]:
            assert r.doc_tokens == len(ids) and r.length > 0 and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            covered[r.start : r.start + r.length] += 1
        assert (covered == copies).all()
    padded = 0
    for mine in by_sequence.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padded += spfhp.gap(at, capacity)
    return padded, sum(r.length for r in rows)


def test_packing_of_documents(docs):
    texts = {r.doc_id: (r.text, 1) for r in docs.collect()}
    rows = spfhp.pack(docs).collect()
    padded, tokens = sound(rows, texts)
    assert padded == 0
    cut = sum(n > -(-doc_tokens // 2048) for (_, doc_tokens), n in Counter((r.doc_id, r.doc_tokens) for r in rows).items())
    assert cut <= len(texts) / 4


def test_packing_of_odd_texts(spark, odd):
    texts = {}
    for doc_id, text, *_ in ODD:
        texts[doc_id] = (text, texts.get(doc_id, (None, 0))[1] + 1)
    padded, _ = sound(spfhp.pack(odd).collect(), texts)
    assert padded == 0
    assert spfhp.pack(odd.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "the same row", "a", "b")] * 500, SCHEMA)
    assert sound(spfhp.pack(same).collect(), {1: ("the same row", 500)})[0] == 0
    sound(spfhp.pack(odd, capacity=100).collect(), texts, 100)


def test_shortest_first_is_what_it_does_one_by_one():
    rng = random.Random(2)
    for _ in range(40):
        capacity = rng.choice((10, 64, 100))
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 80)))
        packs = []
        for length in sorted(counts.elements(), reverse=True):
            open_ = [p for p in packs if sum(p) + length <= capacity]
            if open_:
                min(open_, key=sum).append(length)
            else:
                packs.append([length])
        got = spfhp.shortest_first(counts, capacity)
        mine = [[length for length, times in pattern for _ in range(times)] for n, pattern in got for _ in range(n)]
        assert sorted(map(sum, mine)) == sorted(map(sum, packs))
        assert Counter(x for p in mine for x in p) == counts and all(sum(p) <= capacity for p in mine)


def test_runs_fill_gaps_once():
    plan = spfhp.Plan([(3, ((60, 1), (9, 3))), (2, ((64, 1),)), (4, ((99, 1),))], 100)
    assert plan.filled == 3 * 13 + 4
    total, seen = plan.filled + 257, {}
    for first in range(0, total, 10):
        for start, n, sequence, offset in plan.runs(first, min(10, total - first), total):
            for k in range(n):
                assert (sequence, offset + k) not in seen
                seen[sequence, offset + k] = first + start + k
    assert sorted(seen.values()) == list(range(total))
    ends = Counter(sequence for sequence, _ in seen if sequence >= 9)
    assert sorted(ends.values()) == [1, 8, 16, 32, 100, 100]


# ---- resampling


def brute(docs, target):
    def features(text):
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = "".join(c if c.isdigit() and c.isascii() or "a" <= c <= "z" or ord(c) >= 128 else " " for c in folded).split(" ")
        words = [w for w in words if w]
        return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]

    def bucket(f):
        return zlib.crc32(f.encode()) % 10_000

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    n, m = s.total(), t.total()
    rows = []
    for doc_id, text in docs:
        words, found = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (n + 10_000) / ((s[b] + 1) * (m + 10_000)))) for b in map(bucket, found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    order = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(order[: 25 * len(order) // 100])}
    return sorted(((r[0], *r[1:4], ranks.get(id(r))) for r in rows), key=repr)


def test_resampling_against_brute_force(spark, docs, odd, monkeypatch):
    target = spark.read.parquet(f"{DIR}/benchmark.parquet")
    goal = [r.text for r in target.collect()]
    for given, chunk, rows in ((docs, 3_000, 30), (odd, 100, 1), (docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")), 4_000_000, 500_000)):
        monkeypatch.setattr(resampling, "RANGE", rows)
        monkeypatch.setattr(resampling, "CHUNK", chunk)
        got = sorted((tuple(r) for r in resampling.resample(given, target).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
        want = brute([(r.doc_id, r.text) for r in given.collect()], goal)
        assert [r[:4] for r in got] == [r[:4] for r in want]
        assert sorted((r[3], r[4]) for r in got if r[4]) == sorted((r[3], r[4]) for r in want if r[4])


def test_resampling_of_nothing(spark, docs, odd):
    target = spark.read.parquet(f"{DIR}/benchmark.parquet")
    assert resampling.resample(odd.limit(0), target).count() == 0
    assert resampling.resample(odd, target.limit(0)).count() == len(ODD)
    assert resampling.resample(docs.where("n_chars < 40"), target.withColumn("text", F.lit(None).cast("string"))).where("rank is not null").count() == 0
    kept = resampling.drawn_documents(docs.withColumn("drawn_id", F.lit(1)), target)
    assert kept.columns == [*docs.columns, "drawn_id"] and kept.count() == resampling.resample(docs, target).where("rank is not null").count()


def test_resampling_moves_towards_its_target(spark):
    rng = random.Random(4)
    text = lambda words: " ".join(rng.choice(words) for _ in range(60))
    near, far = [f"law{k}" for k in range(40)], [f"ball{k}" for k in range(40)]
    rows = [(k, text(near if k % 10 == 0 else far)) for k in range(2000)]
    drawn = resampling.drawn_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(text(near),) for _ in range(50)], "text string"), percent=10)
    # a tenth of the documents, of which the noise of the draw leaves some out
    assert drawn.where("doc_id % 10 = 0").count() > 0.8 * drawn.count()


def test_states_are_crcs():
    rng = random.Random(8)
    words = ["".join(rng.choice("abz09é漢") for _ in range(rng.choice((1, 2, 5, 40, 3000)))).encode() for _ in range(60)]
    trie = resampling.Trie([b" ".join(words), None, b"", b"lone"])
    assert sorted(trie.states[0].tolist()) == sorted({zlib.crc32(w) for w in [*words, b"lone"]})
    assert sorted(trie.states[1].tolist()) == sorted({zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:])})
