"""Toxicity from a fuzzy lexicon and the contexts of its matches.

The lexicon is learned: words, and stems that begin words, which labelled toxic texts
hold and labelled clean ones don't. It becomes a trie. A word of a text is looked up by
intersecting its Levenshtein automaton with the trie: the automaton's states, sets of
positions by number of edits, are stepped along the trie's edges, and a branch is left
as soon as no state is alive. So misspelled terms match, at a price per edit, stems
within the edits of any beginning of a word. The new words of many texts are looked up
together: at each node of the trie, the states of all words still alive there are
stepped as one array of bits.

Every match is read in its context window: within quotation marks it counts as
quotation, at half its strength if a word of reporting is near, else as abuse. A text's
features are the strengths and densities of plain matches, of words and of stems, exact
and misspelled, and the strength of quoted ones; a logistic regression on the labels turns them into a score
from 0 to 1. Its constant is moved so that the threshold falls where it tells the labelled texts
apart best (most of F1): toxic texts are few, and a regression's even odds pass too many of them.

Labels are learned from labelled rows whose checksum crc32(doc_id) mod 3 isn't 1, of
which those with the least hashes, TRAINING at most, are read: a documented bound.
Neither labels, language, source nor doc_id enter a score.

Nulls and empty texts have no match and get the score of such texts. A null doc_id
is scored, and is not held out. Repeated rows are scored alike; of rows that repeat an
id, the least text is learned from; where labels repeat or contradict, an id or a text
counts as toxic if any of its labels does. Texts, words and quotations of any length are
read whole. Without labels of both kinds
nothing is learned, and every score is 0. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, written

THRESHOLD = 0.7
#: Labelled rows that are learned from, at most.
TRAINING = 20_000
#: Terms of the lexicon, at most; toxic texts, near copies aside, that a term must have, their share in these
#: and the clean texts with it, and by how many standard deviations that exceeds the share of toxic texts.
TERMS, LEAST, PURE, SURE = 2_000, 4, 0.6, 6.5
STEM = range(4, 8)
#: Words from so many letters on may have an edit; long ones two.
ONE_EDIT, TWO_EDITS = 5, 9
EDIT_PRICE = 0.5
WINDOW = 6
#: Fixed words near which a term is reported rather than used, in the languages of the corpus.
REPORTING = frozenset("said says quoted quote called calls word term wrote cited sagte zitat nannte wort dit cite mot appelé dijo cita palabra llamó".split())
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: A quotation is within a line; none holds another of its kind.
QUOTED = re.compile(r"\"[^\"\n]*\"|“[^“”\n]*”|«[^«»\n]*»|„[^„“”\n]*[“”]")
#: Letters that the states of a word have room for; longer terms are looked up one by one.
ROOM = 60
#: Characters of the texts whose words are looked up together, and words whose strength a worker keeps.
TOGETHER, KEPT = 2_000_000, 500_000
WHOLE, PREFIX, NEAR = 1, 2, 2
KINDS = (WHOLE, PREFIX, WHOLE + NEAR, PREFIX + NEAR)


def trie(terms: Iterable[tuple[str, int, float]]) -> dict:
    root: dict = {}
    for term, kind, weight in terms:
        node = root
        for letter in term:
            node = node.setdefault(letter, {})
        node[kind] = weight
    return root


class Lexicon:
    """A trie of terms (weight of whole words, weight of stems) and fuzzy look-up in it."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]) -> None:
        self.words, self.stems = words, stems
        self.heads = sorted(set(map(len, stems)))
        terms = [(t, kind, w) for kind, some in ((WHOLE, words), (PREFIX, stems)) for t, w in some.items()]
        self.root = trie(x for x in terms if len(x[0]) <= ROOM - 4)
        self.long = trie(x for x in terms if len(x[0]) > ROOM - 4)
        self.met: set[str] = set()
        self.hits: dict[str, tuple[float, int]] = {}

    def strength(self, word: str) -> tuple[float, int]:
        """Weight and kind of the best match of a word: exact, or with the price of its edits; 0 for none."""
        self.meet({word})
        return self.hits.get(word, (0.0, 0))

    def meet(self, words: set[str]) -> None:
        """Looks up the words that are new, together."""
        if len(self.met) > KEPT:
            self.met.clear()
            self.hits.clear()
        fresh = words - self.met
        self.met |= fresh
        near: tuple[list[str], list[str]] = ([], [])
        for word in fresh:
            found = self.exact(word)
            if found[0]:
                self.hits[word] = found
            elif len(word) >= ONE_EDIT:
                near[len(word) >= TWO_EDITS].append(word)
        for k, some in enumerate(near):
            if some:
                strengths, kinds = self.together(some, k + 1)
                for at in np.flatnonzero(strengths).tolist():
                    self.hits[some[at]] = float(strengths[at]), int(kinds[at])
        if self.long:
            for word in fresh:
                if len(word) > ROOM - 8 and word not in self.hits:
                    best = max(((w * EDIT_PRICE**d, kind + NEAR) for d, w, kind in self.within(word, 2, self.long)), default=None)
                    if best:
                        self.hits[word] = best

    def exact(self, word: str) -> tuple[float, int]:
        best = (self.words.get(word, 0.0), WHOLE)
        for n in self.heads:
            if (weight := self.stems.get(word[:n])) is not None and len(word) >= n:
                best = max(best, (weight, PREFIX))
        return best if best[0] else (0.0, 0)

    def together(self, words: list[str], edits: int) -> tuple[np.ndarray, np.ndarray]:
        """Strength and kind of the best misspelled match of each word; see within."""
        sizes = np.array(list(map(len, words)))
        width = min(int(sizes.max()), ROOM)
        letters = np.zeros((len(words), width), np.uint32)
        flat = np.frombuffer("".join(w[:width] for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.arange(width) < sizes[:, None]
        letters[inside] = flat
        place = np.uint64(1) << np.arange(width, dtype=np.uint64)
        shown: dict[str, np.ndarray] = {}

        def at(letter: str) -> np.ndarray:
            found = shown.get(letter)
            if found is None:
                found = shown[letter] = ((letters == np.uint32(ord(letter))) * place).sum(1, dtype=np.uint64)
            return found

        one, two = np.uint64(1), np.uint64(2)
        held = np.minimum(sizes, width).astype(np.uint64)
        accept = np.where(sizes <= width, one << held, np.uint64(0))
        full = (two << held) - one
        best, kinds = np.zeros(len(words)), np.zeros(len(words), np.int64)

        def offer(rows: np.ndarray, strength: float, kind: int) -> None:
            better = (strength > best[rows]) | ((strength == best[rows]) & (kind > kinds[rows]))
            best[rows[better]], kinds[rows[better]] = strength, kind

        every = np.arange(len(words))
        stack = [(self.root, every, [np.uint64((2 << d) - 1) & full for d in range(edits + 1)], None, "")]
        while stack:
            node, rows, states, before, last = stack.pop()
            if (weight := node.get(WHOLE)) is not None:
                open_ = np.ones(len(rows), bool)
                for d, state in enumerate(states):
                    ends = open_ & ((state & accept[rows]) > 0)
                    open_ &= ~ends
                    if d:
                        offer(rows[ends], weight * EDIT_PRICE**d, WHOLE + NEAR)
            if (weight := node.get(PREFIX)) is not None:
                open_ = np.ones(len(rows), bool)
                for d, state in enumerate(states):
                    alive = open_ & (state > 0)
                    open_ &= ~alive
                    if d:
                        offer(rows[alive], weight * EDIT_PRICE**d, PREFIX + NEAR)
            for letter, child in node.items():
                if letter.__class__ is int:
                    continue
                here, mask = at(letter)[rows], full[rows]
                step = [(states[0] & here) << one]
                for d in range(1, edits + 1):
                    less = states[d - 1]
                    state = ((states[d] & here) << one) | less | (less << one) | (step[d - 1] << one)
                    if before is not None:  # neighbours swapped
                        state |= (before[d - 1] & here & (at(last)[rows] >> one)) << two
                    step.append(state & mask)
                alive = step[edits] > 0
                if alive.any():
                    stack.append((child, rows[alive], [x[alive] for x in step], [x[alive] for x in states], letter))
        return best, kinds

    def within(self, word: str, edits: int, root: dict | None = None) -> Iterator[tuple[int, float, int]]:
        """(distance, weight, kind) of the whole words within so many edits of a word, and of the stems within so many of a beginning of it.

        States are sets of positions in the word, as bits, one set per number of edits."""
        at: dict[str, int] = {}
        for k, letter in enumerate(word):
            at[letter] = at.get(letter, 0) | 1 << k
        accept, full = 1 << len(word), (2 << len(word)) - 1
        # at the root: the first position, and those that edits reach from it
        start = tuple((2 << d) - 1 & full for d in range(edits + 1))
        stack = [(self.root if root is None else root, start, None, "")]
        while stack:
            node, states, before, last = stack.pop()
            if (weight := node.get(WHOLE)) is not None:
                for d, state in enumerate(states):
                    if state & accept:
                        if d:
                            yield d, weight, WHOLE
                        break
            if (weight := node.get(PREFIX)) is not None:
                d = next(d for d, state in enumerate(states) if state)
                if d:
                    yield d, weight, PREFIX
            for letter, child in node.items():
                if letter.__class__ is int:
                    continue
                here = at.get(letter, 0)
                step = [(states[0] & here) << 1]
                for d in range(1, edits + 1):
                    less = states[d - 1]
                    state = (states[d] & here) << 1 | less | less << 1 | step[d - 1] << 1
                    if before is not None:  # neighbours swapped
                        state |= (before[d - 1] & here & at.get(last, 0) >> 1) << 2
                    step.append(state & full)
                if step[edits]:
                    stack.append((child, tuple(step), states, letter))


def features(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    """Per text: strength and density of abuse by words, the same by stems, strength of quotation, and those of misspelled words and stems."""
    out = np.zeros((len(texts), 9))
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size > TOGETHER or k == len(texts) - 1:
            some = [(t or "").lower() for t in texts[start : k + 1]]
            words = [WORD.findall(t) for t in some]
            lexicon.meet(set().union(*words))
            hit = set(lexicon.hits)
            for n, (lower, own) in enumerate(zip(some, words)):
                if not hit.isdisjoint(own):
                    out[start + n] = in_context(lower, own, lexicon.hits)
            start, size = k + 1, 0
    return out


def in_context(lower: str, words: list[str], hits: dict[str, tuple[float, int]]) -> tuple[float, ...]:
    """The features of a text in lower case that has a match."""
    quotes = [m.span() for m in QUOTED.finditer(lower)]
    spans = [m.span() for m in WORD.finditer(lower)] if quotes else []
    starts = [a for a, _ in quotes]
    abuse, quoted = dict.fromkeys(KINDS, 0.0), 0.0
    for k, word in enumerate(words):
        if word not in hits:
            continue
        weight, kind = hits[word]
        q = bisect_right(starts, spans[k][0]) - 1 if quotes else -1
        if q >= 0 and spans[k][1] <= quotes[q][1]:
            near = not REPORTING.isdisjoint(words[max(0, k - WINDOW) : k + WINDOW + 1])
            quoted += weight * (0.5 if near else 1.0)
        else:
            abuse[kind] += weight
    n = len(words)
    plain, plain_stems, near, near_stems = ((float(np.log1p(abuse[kind])), abuse[kind] / n) for kind in KINDS)
    return *plain, *plain_stems, float(np.log1p(quoted)), *near, *near_stems


def fitted(x: np.ndarray, y: np.ndarray, rounds: int = 100, ridge: float = 1e-5) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * len(y) * np.append(w[:-1], 0)
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(len(w)) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibrated(margins: np.ndarray, toxic: np.ndarray, threshold: float) -> float:
    """What is added to margins so that those from the best cut on have scores of the threshold and more; the cut is amid the gap between two margins."""
    order = np.argsort(-margins, kind="stable")
    z, y = margins[order], toxic[order]
    last = np.append(z[1:] < z[:-1], True)  # equal margins are cut together
    hits = np.cumsum(y)
    f1 = np.where(last, 2 * hits / (np.arange(1, len(y) + 1) + y.sum()), -1)
    k = int(f1.argmax())
    cut = (z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k]
    return float(np.log(threshold / (1 - threshold)) - cut)


def learnable() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, toxic, half) of the labelled rows that are learned from."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(F.col("toxic").isNotNull() & learnable()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = own.withColumn("place", F.xxhash64(F.lit(11), "doc_id")).orderBy("place", "doc_id").limit(most).withColumn("half", F.pmod(F.shiftright("place", 7), F.lit(2)).cast("int")).drop("place")
    chosen = written(chosen, "toxicity-chosen")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return own.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"), F.max("half").alias("half"))


def learned_lexicon(training: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Whole words and stems with weights, from training texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic_in: dict[str, set[int]] = {}
        clean: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORD.findall((text or "").lower())
                terms = {w: [w, *(f"{w[:n]}*" for n in STEM if len(w) > n)] for w in set(words) if len(w) > 2 and not w.isdigit()}
                if not toxic:
                    clean.update({t for ts in terms.values() for t in ts})
                    continue
                around = ["", *words, ""]
                own: dict[str, int] = {}
                for k, w in enumerate(words):
                    if w in terms:
                        use = xxh64_intdigest(f"{around[k]} {w} {around[k + 2]}") >> 1
                        for t in terms[w]:
                            own[t] = min(own.get(t, use), use)
                # a text has one use of a term, told by its neighbours: near copies have the same
                for t, use in own.items():
                    toxic_in.setdefault(t, set()).add(use)
        found = [(t, c, 0) for t, cs in toxic_in.items() for c in cs] + [(t, None, n) for t, n in clean.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.string(), pa.int64(), pa.int64()))] if found else [pa.array([], k) for k in (pa.string(), pa.int64(), pa.int64())], ["term", "use", "clean"])

    from xxhash import xxh64_intdigest

    uses = training.groupBy("text").agg(F.max("toxic").alias("toxic")).mapInArrow(rows, "term string, use long, clean long")
    counts = uses.groupBy("term").agg(F.count_distinct("use").alias("toxic"), F.sum("clean").alias("clean"))
    base = training.agg(F.avg("toxic").alias("p")).collect()[0]["p"] or 0.0
    texts = F.col("toxic") + F.col("clean")
    sure = F.col("toxic") - base * texts >= SURE * F.sqrt(base * (1 - base) * texts)
    odds = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5))
    best = counts.where((F.col("toxic") >= LEAST) & (F.col("toxic") >= PURE * texts) & sure).withColumn("odds", odds).orderBy(F.desc("odds"), "term").limit(TERMS).collect()
    stems = {r["term"][:-1]: r["odds"] for r in best if r["term"].endswith("*")}
    words = {r["term"]: r["odds"] for r in best if not r["term"].endswith("*")}
    # a stem that its one word explains is that word; a stem within another says nothing new
    by_word = {r["term"]: r["toxic"] for r in best if not r["term"].endswith("*")}
    by_stem = {r["term"][:-1]: r["toxic"] for r in best if r["term"].endswith("*")}
    stems = {s: w for s, w in stems.items() if not any(word.startswith(s) and n >= 0.5 * by_stem[s] for word, n in by_word.items())}
    stems = {s: w for s, w in stems.items() if not any(s[:n] in stems for n in range(1, len(s)))}
    most = max([*words.values(), *stems.values()], default=1.0)
    return {w: o / most for w, o in words.items()}, {s: o / most for s, o in stems.items()}


def model(docs: DataFrame, labels: DataFrame, most: int = TRAINING, threshold: float = THRESHOLD) -> tuple[dict[str, float], dict[str, float], list[float] | None]:
    """Words, stems and regression weights; all bounded by TERMS and `most`."""
    training = written(training_texts(docs, labels, most), "toxicity-training")
    words, stems = learned_lexicon(training)
    # weights are learned from each half with the terms of the other: with its own, it would look too easy
    other = [learned_lexicon(training.where(F.col("half") == 1 - half)) for half in (0, 1)]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, half = np.array(batch.column(0).to_pylist(), object), batch.column(2).to_numpy(zero_copy_only=False)
        found = np.zeros((len(texts), 9))
        for k in (0, 1):
            found[half == k] = features(texts[half == k].tolist(), Lexicon(*other[k]))
        return pa.RecordBatch.from_arrays([pa.array(found.tolist(), pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    seen = mapped(training.select("text", "toxic", "half").orderBy("doc_id"), rows, "x array<double>, toxic int").toPandas()
    if seen.empty or seen["toxic"].nunique() < 2:
        return words, stems, None
    x, y = np.array(seen["x"].tolist()), seen["toxic"].to_numpy(float)
    weights = fitted(x, y)
    weights[-1] += calibrated(x @ weights[:-1] + weights[-1], y, threshold)
    return words, stems, weights.tolist()


def score(docs: DataFrame, labels: DataFrame, most: int = TRAINING, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    words, stems, weights = model(docs, labels, most, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(words, stems)
        for batch in batches:
            if not batch.num_rows:
                continue
            if weights is None:
                scores = np.zeros(batch.num_rows)
            else:
                x = features(batch.column(1).to_pylist(), lexicon)
                scores = 1 / (1 + np.exp(-np.clip(x @ np.array(weights[:-1]) + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
