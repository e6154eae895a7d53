"""Token counts from a compiled finite-state tokenizer.

The tokenizer file (BPE with word ends; lower case; white space dropped) is compiled
to two deterministic machines:

* A splitter over classes of characters, of seven states, which says where pieces
  begin: letter runs, single numbers, runs of other signs, and contractions, for
  which an apostrophe and up to one letter stay pending.
* A transducer over the characters of pieces: a trie whose transitions lead from
  state to state and whose last transition, the one that ends the piece, is annotated
  with the number of tokens it emits. Paths are compiled from the merge ranks of the
  file, when a piece first goes there; then all pieces of a batch take their steps
  together, a character at a time, over arrays.

Text is cut into chunks of equal length. Every chunk's map from each state it may
be entered in to the state it is left in is computed for all chunks at once; a
parallel prefix scan composes the maps, which gives each chunk its true entry state;
then all chunks emit. So no chunk waits for the one before it, however long a text.
Characters get their small forms from the file's own library, as it may know more of
them than this Python. Files of another kind than this are refused.

Nulls and empty texts have no tokens; a null doc_id is kept. Repeated rows are counted
each. Columns beyond doc_id and text are ignored; empty tables give empty results.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, mix64

LIMIT = 2048
CHUNK = 512
#: Characters that are split at once.
SLAB = 2_000_000
#: States that a worker keeps; beyond, compilation starts anew.
KEPT = 2_000_000
#: Longer pieces are counted one by one.
LONG = 64
#: Fixed value: the pattern of pieces that the splitter is made for.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# classes of characters
SPACE, NUMBER, OTHER, APOSTROPHE, LETTER, ENDS, R, V, L, E = range(10)
# states: between pieces, in letters, in other signs, after a piece's first apostrophe, and after that and r, v or l
OUT, LETTERS, OTHERS, TICK, TICK_R, TICK_V, TICK_L = range(7)
# what is emitted: a piece begins here, began at the letter before, both, nothing
NONE, HERE, BEFORE, BOTH = range(4)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) by class * 8 + state."""
    step, emit = np.zeros(80, np.uint8), np.zeros(80, np.uint8)
    letters = (LETTER, ENDS, R, V, L, E)
    for state in range(7):
        for c in range(10):
            if state == TICK and c in (ENDS, R, V, L):
                to, out = {ENDS: OUT, R: TICK_R, V: TICK_V, L: TICK_L}[c], NONE
            elif (state, c) in ((TICK_R, E), (TICK_V, E), (TICK_L, L)):
                to, out = OUT, NONE
            else:
                in_letters = state in (LETTERS, TICK_R, TICK_V, TICK_L)
                in_others = state in (OTHERS, TICK)
                if c == SPACE:
                    to, out = OUT, NONE
                elif c == NUMBER:
                    to, out = OUT, HERE
                elif c in letters:
                    to, out = LETTERS, NONE if in_letters else HERE
                else:
                    to, out = (OTHERS, NONE) if in_others else (TICK if c == APOSTROPHE else OTHERS, HERE)
                if state in (TICK_R, TICK_V, TICK_L):
                    out = BOTH if out == HERE else BEFORE
            step[c * 8 + state], emit[c * 8 + state] = to, out
    return step, emit


STEP, EMIT = splitter()


#: Code points that may have a small form, or that versions of Unicode may tell apart: the planes beyond have none.
ASSIGNED = [*range(0x80, 0xD800), *range(0xE000, 0x33480), *range(0xE0000, 0xE0200)]


@lru_cache(2)
def classes(path: str) -> np.ndarray:
    """The class of every code point; where two versions of Unicode differ about it, the file's library decides."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for found in regex.finditer(pattern, every):
            a, last = (x + 0x800 * (x >= 0xD800) for x in (found.start(), found.end() - 1))
            out[a : last + 1] = c
    out[0xD800:0xE000] = OTHER
    kinds = {"L": LETTER, "N": NUMBER}
    disputed = [c for c in ASSIGNED if out[c] != SPACE and out[c] != kinds.get(unicodedata.category(chr(c))[0], OTHER)]
    if disputed:
        from tokenizers import Tokenizer

        split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        for c in disputed:
            out[c] = LETTER if len(split(f"a{chr(c)}")) == 1 else OTHER if len(split(f"!{chr(c)}")) == 1 else NUMBER
    out[ord("'")] = APOSTROPHE
    for letter, c in {"s": ENDS, "t": ENDS, "m": ENDS, "d": ENDS, "r": R, "v": V, "l": L, "e": E}.items():
        out[ord(letter)] = c
    return out


def composed(maps: np.ndarray) -> np.ndarray:
    """maps[k] after maps[k - 1] after ... after maps[0], for every k, by doubling strides."""
    out, stride = maps.copy(), 1
    while stride < len(out):
        out[stride:] = np.take_along_axis(out[stride:], out[:-stride], 1)
        stride *= 2
    return out


def piece_bounds(points: np.ndarray, kind_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends of the pieces of a text, given as code points, that ends with white space; kind_of: their classes."""
    n = len(points)
    chunks = -(-n // CHUNK)
    kinds = np.zeros(chunks * CHUNK, np.uint8)
    np.take(kind_of, points, out=kinds[:n])
    spaces = kinds == SPACE
    kinds *= 8
    turned = np.ascontiguousarray(kinds.reshape(chunks, CHUNK).T)
    maps = np.tile(np.arange(7, dtype=np.uint8), (chunks, 1))
    for column in turned:
        maps = STEP[column[:, None] + maps]
    state = np.zeros(chunks, np.uint8)
    state[1:] = composed(maps)[:-1, OUT]
    emitted = np.empty_like(turned)
    for column, out in zip(turned, emitted):
        at = column + state
        np.take(EMIT, at, out=out)
        state = STEP[at]
    emitted = np.ascontiguousarray(emitted.T).ravel()
    begins = (emitted == HERE) | (emitted == BOTH)
    begins[:-1] |= emitted[1:] >= BEFORE
    event = np.flatnonzero(begins | spaces)
    first = begins[event]
    ends = np.append(event[1:], len(kinds))
    return event[first], ends[first]


class Counter:
    """The transducer of a tokenizer file, compiled from its merges as pieces come."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        model = spec["model"]
        steps = [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [p.get("pattern", {}).get("Regex") for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if model.get("type") != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or splits[:1] != [PIECES] or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} is no tokenizer of the kind that is compiled here")
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.classes = classes(path)
        self.small = small_forms(path)
        self.odd = regex.compile("[" + "".join(map(regex.escape, self.small)) + "]") if self.small else None
        self.end = model["end_of_word_suffix"] or ""
        names: dict[str, int] = {}
        self.names = names
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((self.name(a), self.name(b)), (rank, self.name(a + b)))
        # bytes are written as printable characters: those that are printable in Latin-1 as themselves, the others from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in shown]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.inner = [self.name(letters[b]) for b in range(256)]
        self.last = [self.name(letters[b] + self.end) for b in range(256)]
        self.restart()

    def restart(self) -> None:
        """Forgets all compiled paths. The table of transitions is open: a key's place is its hash, or the next free one."""
        self.states = 1
        self.keys = np.zeros(1 << 16, np.uint64)
        self.to = np.zeros(1 << 16, np.int32)
        self.ends = np.full(1 << 12, -1, np.int32)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is in the table, or the free place where it would be."""
        mask = np.uint64(len(self.keys) - 1)
        at = mix64(keys) & mask
        held = self.keys[at]
        left = np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            at[left] = (at[left] + np.uint64(1)) & mask
            held = self.keys[at[left]]
            left = left[(held != keys[left]) & (held != 0)]
        return at

    def add(self, keys: np.ndarray) -> None:
        """New states for distinct keys that aren't in the table."""
        while 2 * (self.states + len(keys)) > len(self.keys):
            old, to = self.keys, self.to
            self.keys, self.to = np.zeros(2 * len(old), np.uint64), np.zeros(2 * len(old), np.int32)
            self.put(old[old != 0], to[old != 0])
        self.put(keys, np.arange(self.states, self.states + len(keys), dtype=np.int32))
        self.states += len(keys)
        if self.states > len(self.ends):
            self.ends = np.concatenate([self.ends, np.full(max(len(self.ends), self.states - len(self.ends)), -1, np.int32)])

    def put(self, keys: np.ndarray, to: np.ndarray) -> None:
        while len(keys):
            at = self.places(keys)
            # of several keys for one free place the last written stays; the others look again
            self.keys[at] = keys
            mine = self.keys[at] == keys
            self.to[at[mine]] = to[mine]
            keys, to = keys[~mine], to[~mine]

    def emitted(self, text: str, points: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What each piece's last transition emits."""
        if self.states > KEPT:
            self.restart()
        out = np.zeros(len(begins), np.int64)
        sizes = ends - begins
        long = np.flatnonzero(sizes > LONG)
        for k in long.tolist():
            out[k] = self.count(text[begins[k] : ends[k]])
        order = np.argsort(-np.where(sizes > LONG, 0, sizes), kind="stable")[: len(begins) - len(long)]
        begin, size = begins[order], sizes[order]
        state = np.zeros(len(order), np.int64)
        for step in range(int(size.max(initial=0))):
            active = int(np.searchsorted(-size, -step, "left"))  # pieces longer than step
            # a key is never 0: characters are counted from 1
            keys = (state[:active].astype(np.uint64) << np.uint64(21)) | (points[begin[:active] + step].astype(np.uint64) + np.uint64(1))
            at = self.places(keys)
            missing = self.keys[at] == 0
            if missing.any():
                self.add(np.unique(keys[missing]))
                at = self.places(keys)
            state[:active] = self.to[at]
        fresh = np.flatnonzero(self.ends[state] < 0)
        if len(fresh):
            states, first = np.unique(state[fresh], return_index=True)
            self.ends[states] = [self.count(text[a : a + n]) for a, n in zip(begin[fresh[first]].tolist(), size[fresh[first]].tolist())]
        out[order] = self.ends[state]
        return out

    def name(self, token: str) -> int:
        return self.names.setdefault(token, len(self.names))

    def count(self, piece: str) -> int:
        """Tokens of a piece: the lowest-ranked pair is merged until there is none."""
        raw = piece.encode("utf-8", "surrogatepass")
        inner, merges = self.inner, self.merges
        parts = [inner[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        if len(parts) > 64:
            return self.long_count(parts)
        pairs = [merges.get(p) for p in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for k, found in enumerate(pairs):
                if found is not None and (best is None or found[0] < best[0]):
                    best, at = found, k
            if best is None:
                return len(parts)
            parts[at : at + 2] = [best[1]]
            del pairs[at]
            if at:
                pairs[at - 1] = merges.get((parts[at - 1], parts[at]))
            if at < len(pairs):
                pairs[at] = merges.get((parts[at], parts[at + 1]))

    def long_count(self, parts: list[int]) -> int:
        """The same with a heap of pairs and linked parts, for pieces of any length."""
        import heapq

        n, merges = len(parts), self.merges
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(found[0], k, found[1], parts[k], parts[k + 1]) for k in range(n - 1) if (found := merges.get((parts[k], parts[k + 1])))]
        heapq.heapify(heap)
        left = n
        while heap:
            _, k, made, a, b = heapq.heappop(heap)
            if not alive[k] or parts[k] != a or (j := after[k]) >= n or parts[j] != b:
                continue
            parts[k], alive[j], after[k] = made, False, after[j]
            left -= 1
            if after[k] < n:
                before[after[k]] = k
            for i in (before[k], k):
                if i >= 0 and after[i] < n and (found := merges.get((parts[i], parts[after[i]]))):
                    heapq.heappush(heap, (found[0], i, found[1], parts[i], parts[after[i]]))
        return left


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def normalised(text: str) -> str:
    """NFC and lower case, character by character: a capital sigma has one small form."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


@lru_cache(2)
def small_forms(path: str) -> dict[str, str]:
    """Characters whose normal form in the file's library is another than here."""
    from tokenizers import Tokenizer

    every = list(map(chr, ASSIGNED))
    theirs = Tokenizer.from_file(path).normalizer.normalize_str("|".join(every)).split("|")
    return {c: form for c, form in zip(every, theirs, strict=True) if normalised(c) != form and not c.isspace() and form.strip()}


def text_counts(texts: list[str | None], path: str) -> np.ndarray:
    """Tokens of each text."""
    machine = counter(path)
    out = np.zeros(len(texts), np.int64)
    parts: list[str] = []
    held: list[tuple[int, int]] = []  # text, characters

    def flush() -> None:
        nonlocal parts, held
        if not held:
            return
        whole = "".join(parts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        begins, ends = piece_bounds(points, machine.classes)
        counts = machine.emitted(whole, points, begins, ends)
        upto = np.concatenate([[0], np.cumsum(counts)])
        stops = np.cumsum([n for _, n in held])
        at = np.searchsorted(begins, stops)
        np.add.at(out, [k for k, _ in held], np.diff(upto[at], prepend=0))
        parts, held = [], []

    size = 0
    for k, text in enumerate(texts):
        if not text:
            continue
        if any(t in text for t in machine.specials):
            out[k] += len(machine.special.findall(text))
            pieces = machine.special.split(text)
        else:
            pieces = [text]
        if machine.odd is not None and not text.isascii():
            pieces = [machine.odd.sub(lambda m: machine.small[m[0]], p) for p in pieces]
        # a line break ends every piece and belongs to none
        clean = "".join(normalised(p) + "\n" for p in pieces)
        parts.append(clean)
        held.append((k, len(clean)))
        size += len(clean)
        if size > SLAB:
            flush()
            size = 0
    flush()
    return out


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""
    path = path or tokenizer_path()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
        found = text_counts(texts, path)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found), pa.array(found > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
