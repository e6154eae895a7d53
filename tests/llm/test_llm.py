"""The operators against brute force, and their defined results for odd inputs."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import blocks, lm, mixing, packing, pii, quality, simhash, suffix, tokens, topk, toxicity

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, row string"
ODD = [
    (1, None, "en", "a", 1, "x", "y"), (2, "", None, None, None, None, None), (3, " \n\t ", "en", "a", 3, "x", "y"), (4, "one", "en", "a", 3, "x", "y"),
    (5, "same words here and there " * 20, "en", "a", 5, "x", "y"), (5, "same words here and there " * 20, "en", "a", 5, "x", "y"), (None, "no id at all", "de", "b", 2, None, "y"),
    (7, "long " * 60_000 + "word", "en", "a", None, "x", "y"), (8, "é漢字😀 " * 30, "fr", "c", 9, "x", "y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_codecs():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        v = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        from quire.llm.common import packed, packed_ints, unpacked, unpacked_ints

        assert (unpacked(packed(v)) == v).all()
        for top in (5, 1000, 2**40):
            c = rng.integers(0, top, n)
            assert (unpacked_ints(packed_ints(c)) == c).all()


# ---- quality rules


def test_quality_statistics(docs, texts):
    def brute(text):
        w = words(text)
        trip = Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i, t in enumerate(zip(w, w[1:], w[2:])) if trip[t] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
        return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))

    for r in quality.judge(docs).collect():
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_quality_keeps_clean_and_odd(spark, docs, odd):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    many = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = quality.judge(many).where("not base_failed").join(labels, "doc_id")
    assert judged.where("quality = 1 and not kept").count() == 0
    assert judged.where("quality = 0 and kept").count() == 0
    assert quality.judge(odd).count() == len(ODD)
    kept = quality.accepted(odd)
    assert kept.columns == odd.columns and kept.count() == 0
    assert quality.judge(odd.limit(0)).count() == 0 and quality.accepted(odd.limit(0)).count() == 0
    own = quality.accepted(docs)
    assert own.count() == quality.judge(docs).where("kept").count()


def test_sketches_merge(docs):
    a = quality.document_stats(docs)
    flat = a.select("lang", "source", "stats.*")
    one = {tuple(r) for r in quality.sketches(quality.with_metrics(flat)).collect()}
    other = {tuple(r) for r in quality.sketches(quality.with_metrics(flat.repartition(7))).collect()}
    assert one == other


def test_a_source_moves_its_own_threshold_only(spark):
    rng = random.Random(9)
    row = lambda s, k, high: ("en", s, 200, 1000, 0, 10, 0, 0, rng.randint(10, 30) + high)
    limits = {}
    for high in (0, 40):
        rows = [row(s, k, high * (s == "b")) for s in "abc" for k in range(200)]
        flat = spark.createDataFrame(rows, "lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_upper long")
        rng.seed(9)
        limits[high] = {r.group_source: r.limits.asDict() for r in quality.limits_of(flat, quality.BEYOND, quality.LEAST_DOCS).collect()}
    assert limits[0]["a"] == limits[40]["a"] and limits[0]["c"] == limits[40]["c"]
    assert limits[40]["b"]["hi_upper"] > limits[0]["b"]["hi_upper"] + 30 and limits[40]["b"]["hi_symbols"] == limits[0]["b"]["hi_symbols"] == 0
    assert len({r["hi_upper"] for r in limits[0].values()}) > 1


def test_capitals_are_those_of_the_category():
    assert quality.text_stats("ⅣⒶ ÀÉa Z")[-1] == 3


# ---- toxicity


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    scored = toxicity.score(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").toPandas()
    assert (scored.toxic == scored.predicted).mean() > 0.98
    assert scored.predicted[scored.toxic == 1].mean() > 0.88 and scored.predicted[scored.toxic == 0].mean() < 0.01


def test_toxicity_lexicon():
    lexicon = toxicity.Lexicon({"idiot": 1.0, "disgusting": 1.0, "scum": 1.0}, {"vequ": 0.8})
    s = lambda w: lexicon.strength(w)[0]
    assert s("idiot") == 1 and s("idoit") == 0.5 and s("idi0t") == 0.5 and s("idiott") == 0.5 and s("ideal") == 0
    assert s("disgustng") == 0.5 and s("disgutsnig") == 0.25 and s("scim") == 0 and s("vequelle") == 0.8
    abuse, quoted, bare, long, empty = toxicity.features(["you idiot, you scum", 'he said the word "idiot" once', '"idiot"', '"' + "so it goes on " * 100 + ' idiot"', None], lexicon)
    assert abuse[0] > 0 and quoted[0] == 0 and 0 < quoted[4] < bare[4] and long[0] == 0 < long[4] and not empty.any()


def test_toxicity_long_words():
    long = "donau" * 14
    lexicon = toxicity.Lexicon({long: 1.0, "idiot": 1.0}, {"x" * 61: 0.5})
    s = lexicon.strength
    assert s(long) == (1.0, toxicity.WHOLE) and s(long[1:]) == (0.5, toxicity.WHOLE + toxicity.NEAR) and s(long[3:]) == (0.0, 0)
    assert s("x" * 90)[0] == 0.5 and s("y" + "x" * 59 + "zzzz")[0] == 0.125 and s("idiot" * 20) == (0.0, 0)


def test_toxicity_equal_texts_and_ids(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "same"), (3, "same")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "doc_id long, toxic int")
    rows = toxicity.training_texts(docs, labels, 100).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(i, t) for i, t in ((1, "a"), (2, "same"), (3, "same")) if any(r.doc_id == i for r in rows)]


def test_toxicity_first_letters_and_stems():
    """Look-up against plain distances, of words and of the beginnings of words."""
    terms, stems = {"idiot": 1.0, "athletic": 0.9, "vequelling": 0.7}, {"vequ": 0.8, "mordan": 0.6}
    lexicon = toxicity.Lexicon(terms, stems)
    s = lexicon.strength
    assert s("ldiot") == s("1diot") == s("diiot") == (0.5, toxicity.WHOLE + toxicity.NEAR) and s("thletic") == (0.45, toxicity.WHOLE + toxicity.NEAR)
    assert s("vaquelle") == s("equelle") == s("evquelle") == (0.4, toxicity.PREFIX + toxicity.NEAR) and s("mordxn") == s("nordanic") == (0.3, toxicity.PREFIX + toxicity.NEAR)
    assert s("vequelling") == (0.8, toxicity.PREFIX) and s("vxqvelling") == (0.2, toxicity.PREFIX + toxicity.NEAR)

    def distance(a, b):
        rows = [list(range(len(b) + 1))]
        for i, x in enumerate(a, 1):
            rows.append([i])
            for j, y in enumerate(b, 1):
                swap = [rows[i - 2][j - 2] + 1] if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y else []
                rows[i].append(min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y), *swap))
        return rows[-1]

    rng = np.random.default_rng(5)
    for _ in range(1500):
        letters = list(rng.choice([*terms, *(f"{x}elle" for x in stems), "unrelated"]))
        for _ in range(rng.integers(1, 4)):
            at, letter = rng.integers(0, len(letters)), rng.choice(list("adeiqtuv"))
            letters[at : at + rng.integers(0, 2)] = [letter] * rng.integers(0, 2)
            letters = letters or ["x"]
        word = "".join(letters)
        edits = 0 if len(word) < toxicity.ONE_EDIT else 1 if len(word) < toxicity.TWO_EDITS else 2
        near = [(w, distance(t, word)[-1]) for t, w in terms.items()] + [(w, min(distance(t, word))) for t, w in stems.items()]
        exact = [w for w, d in near if not d]
        want = max(exact) if exact else max((w * 0.5**d for w, d in near if d <= edits), default=0)
        met = toxicity.Lexicon(terms, stems)
        met.meet({word, "another", "w" * 70})
        alone = max((w * 0.5**d for d, w, _ in met.within(word, edits)), default=0) if edits and not exact else want
        assert s(word)[0] == met.hits.get(word, (0,))[0] == alone == pytest.approx(want), word


def test_toxicity_keeps_words_beside_stems(spark):
    families = ["vequelle", "vequira", "vequous", "vequant"]
    rows = [(k, f"{a} you {families[k % 4]} {b}", 1, 0) for k, (a, b) in enumerate((f"a{x}", f"b{x}") for x in range(60))] + [(100 + k, f"all is well {k}", 0, 0) for k in range(200)]
    words, stems = toxicity.learned_lexicon(spark.createDataFrame(rows, "doc_id long, text string, toxic int, half int"))
    assert "vequ" in stems and set(families) <= set(words)


def test_toxicity_odd(spark, odd):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    out = toxicity.score(odd, labels)
    assert out.count() == len(ODD) and out.where("score is null or held_out is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(odd.limit(0), labels).count() == 0
    assert toxicity.score(odd, labels.limit(0)).where("score <> 0").count() == 0


# ---- language model


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_brute(docs, texts, order):
    own = {i: [w.decode() for w in (t or "").encode().translate(lm.LOWER).split()] for i, t in texts.items()}
    gram = lambda w, n: Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    total = [sum((gram(w, n) for w in own.values()), Counter()) for n in range(1, order + 1)]
    tokens_ = sum(map(len, own.values()))
    got = {r.doc_id: r for r in lm.score(docs, order=order, characters=40_000).collect()}
    for i, w in list(own.items())[::7]:
        mine = [gram(w, n) for n in range(1, order + 1)]
        left = lambda g: total[len(g) - 1][g] - mine[len(g) - 1][g]

        def s(g):
            if len(g) == 1:
                return (left(g) or lm.UNSEEN) / max(1, tokens_ - len(w))
            return left(g) / left(g[:-1]) if left(g) > 0 else lm.BACKOFF * s(g[1:])

        want = sum(math.log(s(tuple(w[max(0, k - order + 1) : k + 1]))) for k in range(len(w)))
        assert got[i].log_score == pytest.approx(want, abs=1e-6)


def test_lm_odd(odd):
    out = lm.score(odd).collect()
    assert len(out) == len(ODD) and all(r.mean_log_score is None for r in out if not r.n_words)
    assert lm.score(odd.limit(0)).count() == 0


# ---- top-k


def test_topk_brute_and_odd(spark):
    emb = spark.read.parquet(f"{DIR}/embeddings.parquet")
    rows = [(r.vec_id, np.floor(256 * np.array(r.embedding, float)).astype(int)) for r in emb.collect()]
    ids, data = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])

    def want(every, k):
        out = set()
        for i, v in rows:
            if i % every == 0:
                s = data @ v
                order = [x for x in np.lexsort((ids, -s)) if ids[x] != i][:k]
                out |= {(int(i), n + 1, int(ids[x]), int(s[x])) for n, x in enumerate(order)}
        return out

    for block in (16_384, 64):
        assert {tuple(r) for r in topk.search(emb, block=block).collect()} == want(50, 5)
    assert {tuple(r) for r in topk.search(emb, every=20, k=11, block=200).collect()} == want(20, 11)
    strange = spark.createDataFrame([(0, [1.0, 2.0], "x"), (50, [1.0, 2.0], "x"), (3, None, "x"), (4, [float("nan"), 1.0], "x"), (5, [float("inf"), 1.0], "x"), (6, [None, 1.0], "x"), (8, [0.0, 0.0], "x"), (None, [1.0, 1.0], "x")], "vec_id long, embedding array<double>, score string")
    assert {tuple(r) for r in topk.search(strange).collect()} == {(0, 1, 50, 327680), (0, 2, 8, 0), (50, 1, 0, 327680), (50, 2, 8, 0)}
    assert topk.search(strange.limit(0)).count() == 0


def test_topk_repeated_ids_and_lengths(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = 65536
    got = sorted(tuple(r) for r in topk.search(make([(0, [1.0]), (0, [2.0]), (3, [1.0]), (4, [0.5])])).collect())
    assert got == sorted([(0, 1, 0, 2 * one), (0, 2, 3, one), (0, 3, 4, one // 2), (0, 1, 0, 2 * one), (0, 2, 3, 2 * one), (0, 3, 4, one)])
    got = {tuple(r) for r in topk.search(make([(0, [1.0, 1.0, 1.0]), (1, [1.0]), (2, []), (3, [0.5, 1.0, 4.0, 9.0])])).collect()}
    assert got == {(0, 1, 3, 5 * one + one // 2), (0, 2, 1, one), (0, 3, 2, 0)}
    got = {tuple(r) for r in topk.search(make([(0, [1e12, 1.0]), (1, [1e12, 2.0]), (2, [-1e12, 0.0])])).collect()}
    assert got == {(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))}


def test_topk_queries_go_in_passes_of_bounded_size(spark, monkeypatch):
    # before, every query block was repeated for every index block, and Spark broadcast them all, as their files are small
    for blocks, width in ((0, 64), (1, 64), (600, 64), (7, 10**9)):
        found = topk.passes(blocks, width)
        assert [n for part in found for n in part] == list(range(blocks))
        assert all(len(part) == 1 or len(part) * topk.QUERIES * width <= topk.ASKED for part in found)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 4))
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "QUERIES", 8)
    monkeypatch.setattr(topk, "ASKED", 8 * 4 * 2)
    x = np.floor(256 * vectors).astype(int)
    want = {(q, n + 1, i, int(x[i] @ x[q])) for q in range(0, 300, 5) for n, i in enumerate(sorted((i for i in range(300) if i != q), key=lambda i: (-int(x[i] @ x[q]), i))[:5])}
    for block in (40, 1000):
        got = topk.search(emb, every=5, block=block)
        assert {tuple(r) for r in got.collect()} == want
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_topk_makes_fewer_products_than_brute_force():
    rng = np.random.default_rng(8)
    data = rng.normal(size=(8192, 64))
    data = np.floor(256 * data / np.linalg.norm(data, axis=1, keepdims=True)).astype(np.int64)
    index, rows = topk.Index(data), np.arange(8192)
    assert sum(len(at) for level in index.levels for _, at, _ in level) == np.count_nonzero(data)
    ids = rng.integers(0, 5000, 8192)
    found, products = topk.search_block(rows, ids, index, rows[:40], data[:40], 5)
    assert products < 0.75 * 40 * data.size
    for k, (i, score) in enumerate(found):
        exact = data @ data[k]
        order = [x for x in np.lexsort((ids, -exact)) if x != k][:5]
        assert i.tolist() == ids[order].tolist() and score.tolist() == exact[order].tolist()


# ---- repeated strings


def brute_repeats(raw, length):
    seen = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        yield len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest()


def test_suffix_brute(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("ab ") for _ in range(n)) for n in (10, 40, 90, 300)]
    made = ["".join(rng.choice(base + [rng.choice("xyz") * rng.randint(1, 30)]) for _ in range(rng.randint(0, 5))) for _ in range(60)] + ["a" * 100, "a" * 41, "é" * 50, None]
    made += made[:5]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    want = list(brute_repeats([(t or "").encode() for t in made], 40))
    for characters, slab in ((2_000, suffix.SLAB), (10**7, suffix.SLAB), (10**7, 64)):  # at last, texts are cut into pieces
        got = {r.doc_id: tuple(r)[1:] for r in suffix.remove(df, length=40, named=32, characters=characters, slab=slab).collect()}
        assert [got[i] for i in range(len(made))] == want


def test_suffix_keys_spread_over_buckets():
    rng = np.random.default_rng(3)
    keys = np.unique(suffix.Names([rng.integers(97, 123, 3_000_000, np.uint8).tobytes()], 200, 128).chosen)
    for bits in (6, 9):
        held = np.bincount((keys >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        assert held.max() < 3 * held.mean()


def test_suffix_documents_and_odd(docs, texts, odd):
    small = {i: t for i, t in texts.items() if i < 90}
    want = dict(zip(small, brute_repeats([(t or "").encode() for t in small.values()], 200)))
    got = {r.doc_id: tuple(r)[1:] for r in suffix.remove(docs.where("doc_id < 90"), characters=30_000).collect()}
    assert got == want
    out = suffix.remove(odd).collect()
    assert len(out) == len(ODD) and {r.n_removed for r in out if r.doc_id == 5} == {520}
    assert suffix.remove(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix.remove(odd, named=100)


# ---- tokens


def test_tokens_against_the_library(docs, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.tokenizer_path())
    rng = random.Random(2)
    made = ["".join(rng.choice(["'s", "'", "t", "re", "ll", "x", " ", "\n", "1", "23", "!", "é", "Σ", "ς", "漢", "😀", "İ", "　", "<|endoftext|>", "<|", "'ve"]) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["ab'" * 2000, "x" * 3000, "!" * 3000, None, ""]
    assert tokens.text_counts(made, tokens.tokenizer_path()).tolist() == [len(library.encode(t or "", add_special_tokens=False).ids) for t in made]
    out = tokens.token_counts(odd).collect()
    assert len(out) == len(ODD) and {r.n_tokens for r in out if r.doc_id in (1, 2, 3)} == {0}
    assert next(r for r in out if r.doc_id == 7).over_limit
    assert tokens.token_counts(odd.limit(0)).count() == 0
    for r in tokens.token_counts(docs).join(docs.limit(40), "doc_id").collect():
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids) and r.n_bytes == len((r.text or "").encode())


def test_tokens_of_every_character():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.tokenizer_path())
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x33480), *range(0xE0000, 0xE0200)]]
    for context in ("{0}", "a{0}b 1{0}"):
        made = ["  ".join(context.format(c) for c in every[k : k + 500]) for k in range(0, len(every), 500)]
        want = [len(e.ids) for e in library.encode_batch(made, add_special_tokens=False)]
        assert tokens.text_counts(made, tokens.tokenizer_path()).tolist() == want


def test_transducer_is_compiled_once(tmp_path, monkeypatch):
    machine = tokens.Counter(tokens.tokenizer_path())
    text = "the cat cats the " + "q" * 70 + " "
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    bounds = tokens.piece_bounds(points, machine.classes)
    first = machine.emitted(text, points, *bounds).tolist()
    states = machine.states
    monkeypatch.setattr(machine, "count", machine.long_count and (lambda piece: 1 / 0 if len(piece) <= tokens.LONG else first[-1]))
    assert machine.emitted(text, points, *bounds).tolist() == first and machine.states == states == 1 + len("the") + len("cats")
    other = tmp_path / "other.json"
    other.write_text(open(tokens.tokenizer_path(), encoding="utf-8").read().replace("'ll|'d|", "'ll|"), encoding="utf-8")
    with pytest.raises(ValueError):
        tokens.Counter(str(other))


# ---- mixing


def brute_targets(sizes):
    total, cap = sum(sizes.values()), {s: 3 * n for s, n in sizes.items()}
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    done: dict = {}
    while True:
        free = [s for s in sizes if s not in done]
        room = total - sum(done.values())
        share = {s: room * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= cap[s]]
        if not over:
            return done | share
        done |= {s: float(cap[s]) for s in over}


def test_mixing(spark, docs, odd):
    rng = random.Random(6)
    made = spark.createDataFrame([(k, "w " * rng.randint(0, 60), rng.choice(["a", "b", "c", None, "Z", "é", "big", "big", "big", "big"])) for k in range(600)] + [(900, "x y", "tiny")], "doc_id long, text string, source string")
    for df in (made, docs):
        rows = mixing.mix(df).collect()
        sizes = Counter()
        for r in rows:
            sizes[r.source] += r.size
        target, took = brute_targets(sizes), Counter()
        for r in rows:
            took[r.source] += r.taken
            assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert all(abs(took[s] - target[s]) <= 1 for s in sizes)
        assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(5)).collect()), key=repr)
    copies = mixing.mixed(made)
    assert copies.columns == made.columns
    n = copies.withColumn("n", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).groupBy("doc_id").agg(F.sum("n").alias("n"))
    assert {r.doc_id: r.n for r in n.collect()} == {r.doc_id: r.taken for r in mixing.mix(made).collect() if r.taken}
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd.limit(0)).count() == 0


# ---- PII


TEXT = 'Call +1 (017) 555-7713 or 555-123-4567, mail the.72@mail3.example.com! IP 169.122.221.182. card 4163219794092933 or 4163 2197 9409 2933. token = "ede43f42c939b6405768150e0411590525cf889e" by Mr. Roe and John Roe, Mary Roe; Анна Петрова. SSN 123-45-6789, 12 apples, 3.14'


def test_pii(spark, odd):
    df = spark.createDataFrame([(1, TEXT, 1), (2, "plain 12 text", 2), (3, None, 3), (4, "", 4), (5, "again +1 (017) 555-7713!!", 5)], "doc_id long, text string, found int")
    got = {r.doc_id: r for r in pii.counted(df).collect()}
    new = got[1].text
    for secret in ("017", "555-7713", "555-123", "the.72", "mail3", "169.122", "41632197", "4163 2197", "ede43f", "Roe", "Петрова", "123-45-6789"):
        assert secret not in new, secret
    import re

    assert re.search(r"Call \+1 \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}, mail \S+@example\.com! IP \d+\.\d+\.\d+\.\d+\. card \d{16} or \d{4} \d{4} \d{4} \d{4}\. token = \"[0-9a-f]{40}\" by Mr\. (\w+) and (\w+) \1, (\w+) \1; ", new)
    assert new.endswith("12 apples, 3.14") and re.search(r"; [А-Яа-яё]+ [А-Яа-яё]+\.", new)
    given = re.search(r"and (\w+) \w+, (\w+) ", new)
    assert given[1] in pii.GIVEN["latin", "m"] and given[2] in pii.GIVEN["latin", "f"]
    assert (got[2].text, got[3].text, got[4].text) == ("plain 12 text", None, "")
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new)[0] in got[5].text
    assert {r.doc_id: r.text for r in pii.replaced(df).collect()} == {k: r.text for k, r in got.items()}
    assert pii.replaced(df, key="other").where("doc_id = 1").collect()[0].text != new
    out = pii.replaced(odd)
    assert out.columns == odd.columns and out.count() == len(ODD) and pii.replaced(odd.limit(0)).count() == 0


def test_pii_persons_stay_one(spark):
    import re

    texts = ["Mr. Roe came. Mr. Roe's hat. Then Roe left; Roes stay.", "Roe is nobody here.", "Mr. O'Brien-Smith met O'Brien-Smith", "田中さん, 王小明先生", "Պրն Mr. Աննա", "x@firma.de, y@z.org, Z@Z.ORG, z@z.org", "Contact: Zeno Quark. Later Quark wrote: my name is Ada Byte.\nSincerely,\nZeno Quark", "Contact: Zeno. The name is Quark, Name: none"]
    got = [r.text for r in pii.replaced(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    m = re.fullmatch(r"Mr\. (\w+) came\. Mr\. (\w+)'s hat\. Then (\w+) left; Roes stay\.", got[0])
    assert m and m[1] == m[2] == m[3] != "Roe" and got[1] == texts[1]
    m = re.fullmatch(r"Mr\. (\w+) met (\w+)", got[2])
    assert m and m[1] == m[2]
    assert "田" not in got[3] and "王" not in got[3] and got[3].endswith("先生") and re.search(r"Mr\. [Ա-Ֆա-և]+$", got[4])
    m = re.fullmatch(r"Contact: (\w+) (\w+)\. Later (\w+) wrote: my name is (\w+) (\w+)\.\nSincerely,\n(\w+) (\w+)", got[6])
    assert m and m[3] == m[2] == m[7] and m[1] == m[6] and len({*m.groups(), "Zeno", "Quark", "Ada", "Byte"}) == 8 and got[7] == texts[7]
    a, b, c, d = got[5].split(", ")
    assert a.endswith("@de.example") and b.endswith("@example.org") and c == d != b


def test_pii_no_text_is_too_long(spark):
    """Runs of any length, which would overflow the stack of a matcher that recurses once a repeat."""
    n = 1_000_000
    made = ["x@" + "a." * n, "x@" + "a." * n + "com", "1" * n, "\U0001f600" * n, "a@" * 100_000, "1." * 100_000, "Mr. " + "Bb'" * 100_000, "password" + " " * 100_000, "A" * 100_000, "+1 23 45 " * 5_000]
    got = [r.text for r in pii.replaced(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [len(g) == len(t) for g, t in zip(got, made)].count(False) <= 2 and got[1].endswith("@example.com") and got[0] == made[0]


def test_pii_surrogates_hang_on_no_other_document(spark):
    names = [f"Mr. R{chr(97 + a)}{chr(97 + b)}x" for a in range(26) for b in range(26)] + [f"Mr. R{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}" for a in range(8) for b in range(20) for c in range(20)]
    names = list(dict.fromkeys(names))
    df = spark.createDataFrame([(k, f"{x} and {x}, again {names[k // 2]}.") for k, x in enumerate(names)], "doc_id long, text string")
    new = {}
    for r in pii.replaced(df).collect():
        first, rest = r.text.split(" and ")
        second, third = rest.rstrip(".").split(", again ")
        assert first == second != names[r.doc_id] and new.setdefault(names[r.doc_id], first) == first and new.setdefault(names[r.doc_id // 2], third) == third
    assert len(set(new.values())) == len(names) > 3000
    alone = {r.doc_id: r.text for r in pii.replaced(df.where("doc_id < 4")).collect()}
    assert alone == {r.doc_id: r.text for r in pii.replaced(df).where("doc_id < 4").collect()}


def test_pii_cards_keep_their_check(spark):
    def sound(d):
        return sum(sum(divmod(int(x) * (2 if k % 2 else 1), 10)) for k, x in enumerate(reversed(d))) % 10 == 0

    rng = random.Random(3)
    cards = ["4111111111111111", "5500005555555559", *("".join(rng.choice("0123456789") for _ in range(16)) for _ in range(200))]
    got = [r.text for r in pii.replaced(spark.createDataFrame(list(enumerate(cards)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [sound(c) for c in cards] == [sound(g) for g in got] and len(set(got)) == len(set(cards)) and not set(got) & set(cards)


def test_pii_brute(spark):
    """A plain search by another engine: what lies between entities stays, and entities map one to one, each in its own form."""
    import regex

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    email = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
    plain = regex.compile("|".join([email, *(pii.PATTERNS[k].replace(r"\1", r"(?:[ -]?)") for k in ("ip", "secret", "card", "ssn", "phone"))]))
    form = lambda e: regex.sub(r"\p{L}", "a", regex.sub(r"\d", "0", e))
    forward, backward, n = {}, {}, 0
    new = {r.doc_id: r.text for r in pii.replaced(docs).collect()}
    for r in docs.collect():
        found = list(plain.finditer(r.text or ""))
        gaps, at = [], 0
        for m in found:
            gaps.append(r.text[at : m.start()])
            at = m.end()
        gaps.append((r.text or "")[at:])
        m = regex.fullmatch("(.+)".join(map(regex.escape, gaps)), new[r.doc_id], regex.S)
        assert m, r.doc_id
        for old, own in zip(found, m.groups()):
            old = old[0].lower() if "@" in old[0] else old[0]
            assert forward.setdefault(old, own) == own and backward.setdefault(own, old) == old and own != old
            assert "@" in old or "\"" in old or "." in old or form(old) == form(own)
            n += 1
    assert n > 50


def test_pii_numbers_are_permuted(spark):
    for digits in (1, 2, 3, 5, 10):
        n = min(10**digits, 3000)
        df = spark.range(n).select(F.lpad(F.col("id").cast("string"), digits, "0").alias("d"))
        out = df.select(pii.new_digits(F.col("d"), "k").alias("x"))
        assert out.distinct().count() == n and out.where(F.length("x") != digits).count() == 0
    ips = spark.range(3000).select(F.concat(F.lit("10.1."), (F.col("id") / 250).cast("int").cast("string"), F.lit("."), (F.col("id") % 250).cast("string")).alias("ip"))
    assert ips.select(pii.new_ip(F.col("ip"), "k").alias("x")).distinct().count() == 3000


def test_pii_secrets_are_permuted(spark):
    """Short values have one surrogate each, of their own kind, and letters of other scripts don't stay."""
    n = 120_000
    new = lambda df: df.select("v", F.regexp_extract(pii.new_secret(F.concat(F.lit('token="'), "v", F.lit('"')), "k"), '"(.*)"', 1).alias("x"))
    digits = new(spark.range(0, n, 1, 4).select(F.lpad(F.col("id").cast("string"), 8, "0").alias("v")))
    hexed = new(spark.range(0, n, 1, 4).select(F.concat(F.lit("a"), F.lpad(F.lower(F.hex("id")), 7, "0")).alias("v")))
    for out, kind in ((digits, "^[0-9]{8}$"), (hexed, "^[a-f][0-9a-f]{7}$")):
        r = out.agg(F.count_distinct("x"), F.count_if(F.col("x").rlike(kind))).collect()[0]
        assert tuple(r) == (n, n)
    got = {r.v: r.x for r in new(spark.createDataFrame([("парольСекрет",), ("μυστικόςΩ",), ("パスワード漢字漢字",), ("Pass-w0rd!x",)], "v string")).collect()}
    import re

    assert re.fullmatch("[а-я]{6}[А-Я][а-я]{5}", got["парольСекрет"]) and re.fullmatch("[Ͱ-Ͽ]{9}", got["μυστικόςΩ"]) and re.fullmatch("[A-Z][a-z]{3}-[a-z][0-9][a-z]{2}![a-z]", got["Pass-w0rd!x"])
    for v, x in got.items():
        assert sum(a == b for a, b in zip(v, x)) < len(v) / 2
    many = spark.range(0, n, 1, 4).select("id", F.concat(F.lit('password = "'), F.lpad(F.col("id").cast("string"), 8, "0"), F.lit('"')).alias("text"))
    assert pii.replaced(many).agg(F.count_distinct("text")).collect()[0][0] == n


def test_pii_finds_what_the_data_has(spark):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = re.compile(r"\w[\w.+-]*@[\w-]+\.[\w.]+|\+1 \(\d{3}\) \d{3}-\d{4}|(?<!\d)\d{16}(?!\d)|\d+\.\d+\.\d+\.\d+|[0-9a-fA-F]{40}")
    old = {r.doc_id: set(found.findall(r.text)) for r in docs.collect()}
    assert sum(map(len, old.values())) > 50
    for r in pii.replaced(docs).collect():
        assert not [x for x in old[r.doc_id] if x in r.text]


# ---- packing


def test_packing(docs, texts, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.tokenizer_path())
    want = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in texts.items()}
    rows = packing.pack(docs).collect()
    import zlib

    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for i, ids in want.items():
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 1024 for r in own[1:]) and all(a.start + a.length == b.start for a, b in zip(own, own[1:]))
    for held in by_bin.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_bin) <= 1.03 * sum(map(len, want.values())) / 1024 + 1
    out = packing.pack(odd).collect()
    assert {r.length for r in out if r.doc_id in (1, 2)} == {1} and len({(r.sequence_id, r.offset) for r in out}) == len(out)
    assert packing.pack(odd.limit(0)).count() == 0


def test_plans_use_every_piece_once():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.choice([10, 64, 1024])
        counts = {rng.randint(1, capacity): rng.randint(1, 500) for _ in range(rng.randint(0, 80))}
        for groups in (1, 7, 128):
            used = Counter()
            for n, lengths in packing.plan(counts, capacity, groups):
                assert n > 0 and sum(lengths) <= capacity
                for x in lengths:
                    used[x] += n
            assert dict(used) == counts


def test_fast_ids_are_the_librarys(texts):
    e = packing.encoder(packing.tokenizer_path())
    assert e.fast is not None
    for t in [*list(texts.values())[:60], "a<|endoftext|>b", "<|endoftext|>", " \n\n x  ", "it's 12 ３ é漢😀"]:
        assert e.ids(t or "").tolist() == e.slow.encode(t or "", add_special_tokens=False).ids


def test_ids_agree_on_both_sides_of_the_long_texts():
    e = packing.encoder(packing.tokenizer_path())
    words_ = random.Random(5).choices(["the", "cat", " sat", "\n", "é漢", "12", "!?", "naïve"], k=260_000)
    text = " ".join(words_)
    for cut in (text[: packing.LONG], text[: packing.LONG + 1]):
        assert e.ids(cut).tolist() == e.slow.encode(cut, add_special_tokens=False).ids == e.fast.encode(cut, allowed_special=set(), disallowed_special=())


# ---- near duplicates


def brute_print(spark, texts):
    rows = []
    for i, t in texts:
        w = words((t or "").encode().translate(simhash.LOWER).decode())
        g = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        rows.append((i, g))
    df = spark.createDataFrame(rows, "i long, g array<string>").select("i", F.transform("g", lambda x: F.xxhash64(x)).alias("h"))
    out = {}
    for r in df.collect():
        h = [x & (2**64 - 1) for x in r.h]
        out[r.i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return out


def brute_components(prints, radius=3):
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_simhash(spark, docs, texts, odd):
    prints = brute_print(spark, texts.items())
    classes = brute_components(prints)
    for tile in (16_384, 5):
        got = {r.doc_id: r for r in simhash.classes(docs, tile=tile).collect()}
        assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
        assert {i: r.component_id for i, r in got.items()} == classes
    kept = simhash.one_of_each(docs)
    assert {r.doc_id for r in kept.collect()} == set(classes.values()) and kept.columns == docs.columns
    out = simhash.classes(odd).collect()
    assert len(out) == len(ODD) and {r.fingerprint for r in out if r.doc_id in (1, 2, 3)} == {"0" * 16}
    assert simhash.one_of_each(odd).columns == odd.columns and simhash.classes(odd.limit(0)).count() == 0 and simhash.one_of_each(odd.limit(0)).count() == 0


def test_chains_become_one_component(spark):
    rng = random.Random(3)
    chain = [rng.getrandbits(64)]
    for _ in range(150):
        chain.append(chain[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints = dict(enumerate(dict.fromkeys(chain + [rng.getrandbits(64) for _ in range(200)])))
    signed = {i: p - 2**64 if p >> 63 else p for i, p in prints.items()}
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed.values()], "print long"), tile=20)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    want = brute_components(prints)
    groups = {}
    for i, p in signed.items():
        groups.setdefault(want[i], set()).add(roots.get(p, p))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


# ---- blocks and pipeline


def test_blocks_hold_every_row(odd):
    held = blocks.blocks(odd, "b", 200).collect()
    ids = [i for r in held for i in blocks.documents_of(bytes(r.payload))[0]]
    assert Counter(ids) == Counter(r[0] for r in ODD) and len({r.block for r in held}) == len(held)


def test_pipeline(spark, docs):
    import corpus_pipeline as P

    stage, frames = docs, {}
    for name, f in P.STAGES:
        stage = f(spark, stage, DIR)
        frames[name] = stage.cache()
        if name != P.STAGES[-1][0]:
            assert stage.columns == docs.columns and dict(stage.dtypes) == dict(docs.dtypes)
    good = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert {r.doc_id for r in frames["quality"].collect()} == good
    classes = brute_components(brute_print(spark, [(r.doc_id, r.text) for r in frames["quality"].collect()]))
    assert {r.doc_id for r in frames["simhash"].collect()} == set(classes.values())
    taken = {r.doc_id: r.taken for r in mixing.mix(frames["pii"]).collect() if r.taken}
    assert {r.doc_id: sum(map(len, map(words, [r.text]))) for r in frames["mixing"].groupBy("doc_id").agg(F.array_join(F.collect_list("text"), " ").alias("text")).collect()} == taken
    whole = P.run(spark, DIR)
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert Counter(map(key, whole.collect())) == Counter(map(key, frames["packing"].collect()))


def test_queries_and_sql_agree(spark):
    import os

    import duckdb

    from quire.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark"):
        path = f"{DIR}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, DIR)
        columns = sorted(df.columns)
        got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
        found = con.execute(sql)
        names = [x[0] for x in found.description]
        assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr), name
