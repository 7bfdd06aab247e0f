"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The words of all texts are counted; the most frequent ones, with the ids the merges give them,
are compiled into a minimal acyclic automaton: states with the same right language are one, so
suffixes are shared, and each word's number - the count of accepted words before it - leads to its
ids.  Executors memory-map the compiled bytes.  Words outside are merged by the vocabulary's ranks,
exactly.  Only a piece between white space that has a character on whose class or normal form libraries might
differ goes through the tokenizer itself, the rest of its text does not.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenql.llm import kernel as K
from lumenql.llm.pieces import PieceTable, word_pieces
from lumenql.llm.shared import saved, ship

#: Fixed values of the tokenizer file: its word pattern.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: What a plain piece doesn't have: controls and spaces that libraries class differently, letters whose lower case is two or
#: depends on what follows, characters with other normal forms, scripts but Latin, Greek, Cyrillic, Hebrew and Arabic letters,
#: kana, Han and Hangul syllables, and a special token's sign.
ODD = regex.compile(
    "[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u012f\u0131-\u024f\u0391-\u03a1\u03a4-\u03c9\u0410-\u044f\u0451-\u045f"
    "\u05d0-\u05ea\u0627-\u063a\u0641-\u064a\u2010-\u2027\u2030-\u203a\u20ac\u3001-\u3003\u3008-\u3011"
    "\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]|<[|]"
)

#: Bytes of words whose next merge is looked for among all pairs; longer ones have a heap of pairs.
_SHORT = 64


@dataclass(frozen=True)
class Lexicon:
    """Words in the automaton, and bytes of the longest: together they bound what executors get; pieces a worker remembers."""

    words: int = 40_000
    longest: int = 48
    remembered: int = 800_000


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merger:
    """Exact merges of a word by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.end = model.get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in whole.get("added_tokens") or ()}
        self.letters = _byte_letters()
        inner, last = ([self.vocab.get(c + end, -1) for c in self.letters] for end in ("", self.end))
        self.first_ids = None if min(inner + last) < 0 else (inner, last)
        # the pair of ids a, b is the number a * width + b
        self.width = max(self.vocab.values()) + 1
        self.pair_rank = {self.vocab[a] * self.width + self.vocab[b]: i for (a, b), i in self.rank.items()} if self.first_ids else {}
        self.made = [self.vocab[a + b] for a, b in pairs] if self.first_ids else []

    def ids(self, word: str) -> list[int]:
        raw = word.encode()
        if self.first_ids is None or len(raw) > _SHORT:
            return self._ids_by_heap(word)
        inner, last = self.first_ids
        out = [inner[b] for b in raw]
        out[-1] = last[raw[-1]]
        rank, width, none = self.pair_rank.get, self.width, len(self.made)
        ranks = [rank(a * width + b, none) for a, b in zip(out, out[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            out[i] = made = self.made[least]
            del out[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(out[i - 1] * width + made, none)
            if i < len(ranks):
                ranks[i] = rank(made * width + out[i + 1], none)
        return out

    def _ids_by_heap(self, word: str) -> list[int]:
        parts: list[str | None] = [self.letters[b] for b in word.encode()]
        parts[-1] += self.end  # type: ignore[operator]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.rank[p], i, p) for i in range(n - 1) if (p := (parts[i], parts[i + 1])) in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j] = pair[0] + pair[1], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (p := (parts[k], parts[after[k]])) in self.rank:
                    heapq.heappush(heap, (self.rank[p], k, p))
        return [self.vocab[p] for p in parts if p is not None]


def compiled(entries: dict[str, list[int]]) -> bytes:
    """The minimal acyclic automaton of the words as bytes, with each word's ids.

    Words come in byte order; when a word leaves a branch, the states below it are replaced by equal ones
    that are registered, so no two states of the result accept the same endings."""
    words = sorted((w.encode(), ids) for w, ids in entries.items())
    edges: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path = [0]
    last = b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            sign = (final[state], tuple(edges[state].items()))
            if (same := register.setdefault(sign, state)) != state:
                edges[path[-1]][last[len(path) - 1]] = same

    for word, _ in words:
        common = next((i for i, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
        settle(common)
        last = word
        for b in word[common:]:
            edges.append({})
            final.append(False)
            edges[path[-1]][b] = len(edges) - 1
            path.append(len(edges) - 1)
        final[path[-1]] = True
    settle(0)
    # states that are left, numbered; endings counted from the leaves up
    number, order, stack = {0: 0}, [0], [0]
    while stack:
        for to in edges[stack.pop()].values():
            if to not in number:
                number[to] = len(order)
                order.append(to)
                stack.append(to)
    ends: dict[int, int] = {}

    def count(state: int) -> int:
        if state not in ends:
            ends[state] = final[state] + sum(count(t) for t in edges[state].values())
        return ends[state]

    first, label, target, skip = [0], [], [], []
    for state in order:
        passed = int(final[state])
        for b, to in edges[state].items():
            label.append(b)
            target.append(number[to])
            skip.append(passed)
            passed += count(to)
        first.append(len(label))
    starts = np.cumsum([0, *(len(ids) for _, ids in words)])
    flat = np.array([i for _, ids in words for i in ids], np.uint32)
    head = np.array([len(order), len(label), len(words), len(flat)], np.uint32)
    parts = (head, np.array(first, np.uint32), np.array(target, np.uint32), np.array(skip, np.uint32), starts.astype(np.uint32), flat, np.array([final[s] for s in order], np.uint8), np.array(label, np.uint8))
    return b"".join(p.tobytes() for p in parts)


class Automaton:
    """Lookup in compiled bytes through a memory map."""

    def __init__(self, blob: bytes):
        with tempfile.TemporaryFile() as f:  # the map stays when the nameless file closes
            f.write(blob)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        states, edges, words, ids = np.frombuffer(self.map, np.uint32, 4).tolist()
        at = 16
        view = memoryview(self.map)

        def take(n: int, kind: str) -> memoryview:
            nonlocal at
            size = 4 if kind == "I" else 1
            at += n * size
            return view[at - n * size : at].cast(kind)

        self.first, self.target, self.skip = take(states + 1, "I"), take(edges, "I"), take(edges, "I")
        self.starts, self.ids, self.final, self.label = take(words + 1, "I"), take(ids, "I"), take(states, "B"), take(edges, "B")
        first, self._target, self._skip = (np.frombuffer(x, np.uint32).astype(np.int64) for x in (self.first, self.target, self.skip))
        self._final = np.frombuffer(self.final, np.uint8) > 0
        # edges by state and label: ascending
        self._edges = np.repeat(np.arange(states), np.diff(first)) << 8 | np.frombuffer(self.label, np.uint8)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word, or -1: all of them take a step at a time."""
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        data, begin = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size
        state, passed = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        out, on, step = np.full(len(raw), -1), np.arange(len(raw)), 0
        while len(on):
            ended = size[on] == step
            done = on[ended]
            out[done] = np.where(self._final[state[done]], passed[done], -1)
            on = on[~ended]
            if not len(self._edges):
                break
            key = state[on] << 8 | data[begin[on] + step]
            at = np.minimum(np.searchsorted(self._edges, key), len(self._edges) - 1)
            there = self._edges[at] == key
            on, at = on[there], at[there]
            passed[on] += self._skip[at]
            state[on] = self._target[at]
            step += 1
        return out

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist()

    def find(self, word: str) -> list[int] | None:
        state = passed = 0
        for b in word.encode():
            low, high = self.first[state], self.first[state + 1]
            while low < high:
                mid = (low + high) // 2
                if self.label[mid] < b:
                    low = mid + 1
                else:
                    high = mid
            if low >= self.first[state + 1] or self.label[low] != b:
                return None
            passed += self.skip[low]
            state = self.target[low]
        return self.ids[self.starts[passed] : self.starts[passed + 1]].tolist() if self.final[state] else None


class Encoder:
    """Texts to ids and back."""

    def __init__(self, path: str, blob: bytes, rule: Lexicon):
        self.path = path
        self.merger = merger(path)
        self.automaton = Automaton(blob)
        self.spaced = {i: f"{t} ".encode() for i, t in self.merger.tokens.items()}
        self.table = PieceTable(self._pieces, (np.uint16, np.uint8), rule.remembered)
        self._library = None

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def _pieces(self, pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and decoded bytes, with a space after each token, of pieces without white space."""
        cut = [None if ODD.search(piece) else WORD.findall(piece.lower()) for piece in pieces]
        words = list(dict.fromkeys(chain.from_iterable(c for c in cut if c)))
        merge, ids_of = self.merger.ids, self.automaton.ids_of
        known = {w: merge(w) if k < 0 else ids_of(k) for w, k in zip(words, self.automaton.numbers(words).tolist(), strict=True)}
        ids: list[int] = []
        many, shown = [], []
        spaced = self.spaced.__getitem__
        for piece, own_words in zip(pieces, cut, strict=True):
            if own_words is None:
                own = self.library.encode(piece, add_special_tokens=False).ids
            elif len(own_words) == 1:
                own = known[own_words[0]]
            else:
                own = [i for w in own_words for i in known[w]]
            ids += own
            many.append(len(own))
            shown.append(b"".join(map(spaced, own)))
        sizes = list(map(len, shown))
        return [(np.array(ids, np.uint16), np.array(many, np.int32)), (np.frombuffer(b"".join(shown), np.uint8), np.array(sizes, np.int32))]

    def encode(self, texts: pa.Array) -> list[tuple[np.ndarray, bytes]]:
        """(ids as little-endian 32-bit integers, the decoded text in UTF-8) of each text."""
        data, ends = K.utf8(texts)
        hashes, starts, stops, first = word_pieces(data, ends)
        if len(hashes):
            slots = self.table.slots_of(hashes, data, starts, stops)
            (ids, id_ends), (shown, shown_ends) = self.table.gather(0, slots), self.table.gather(1, slots)
            ids = ids.astype("<u4")
        else:
            ids, shown, id_ends, shown_ends = np.zeros(0, "<u4"), np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64)
        a, b = id_ends[first].tolist(), shown_ends[first].tolist()
        raw = shown.tobytes()
        return [(ids[a[i] : a[i + 1]], raw[b[i] : max(b[i], b[i + 1] - 1)]) for i in range(len(ends) - 1)]


@lru_cache(1)
def _encoder(path: str, blob: bytes, rule: Lexicon) -> Encoder:
    """One for a worker process, whose tasks share what it remembers."""
    return Encoder(path, blob, rule)


@lru_cache(1)
def merger(path: str) -> Merger:
    return Merger(path)


def decode(ids: Iterable[int], path: str) -> str:
    tokens = merger(path).tokens
    return " ".join(tokens[i] for i in ids)


def _count(rule: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for piece, n in held.items():
                for w in WORD.findall(piece.lower()):
                    words[w] += n
            held.clear()
            kept = [(w, n) for w, n in words.items() if len(w.encode()) <= rule.longest]
            return pa.record_batch([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in K.slices(batches, 4 << 20):
            data, ends = K.utf8(batch.column("text"))
            hashes, starts, stops, _ = word_pieces(data, ends)
            _, place, many = np.unique(hashes, return_index=True, return_counts=True)
            raw = data.tobytes()
            for a, b, n in zip(starts[place].tolist(), stops[place].tolist(), many.tolist(), strict=True):
                piece = raw[a:b].decode()
                if piece in held:
                    held[piece] += n
                elif not ODD.search(piece):
                    held[piece] = n
            if len(held) > 250_000:
                yield flush()
        yield flush()

    return run


def frequent_words(docs: DataFrame, rule: Lexicon = Lexicon()) -> list[str]:
    """Of all texts' words the most frequent ones, rule.words at most.

    A histogram of the counts (six leading bits a bin) gives the least count that leaves so many, and only those come to
    the driver."""
    counts = saved(docs.select("text").mapInArrow(_count(rule), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "zwords")
    shift = "greatest(length(bin(n)) - 6, 0)"
    bins = counts.groupBy(F.expr(f"shiftleft(shiftright(n, {shift}), {shift})").alias("low")).agg(F.count("*").alias("words")).collect()
    least, total = None, 0
    for b in sorted(bins, key=lambda r: -r.low):
        total += b.words
        if total > rule.words:
            break
        least = b.low
    if least is None:
        return [r.word for r in counts.orderBy(F.col("n").desc(), "word").limit(rule.words).collect()] if bins else []
    return sorted(r.word for r in counts.where(F.col("n") >= least).select("word").collect())


def _encode(path: str, shared, rule: Lexicon, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, shared.value, rule)
        for batch in K.slices(batches, 2 << 20):
            found = encoder.encode(batch.column("text"))
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(i) for i, _ in found], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i, _ in found]),
                "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for _, d in found]),
            }
            if with_ids:
                columns |= {"ids": pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())), "decoded": pa.array([d.decode() for _, d in found], pa.string())}
            yield pa.record_batch(columns)

    return run


def encoded(docs: DataFrame, path: str, rule: Lexicon = Lexicon(), with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of each row of `docs` (doc_id, text).

    Null and empty texts have no tokens; rows keep their doc_id, null or repeated; other columns aren't
    read.  `path` is a tokenizer file that every executor has at the same place."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    merge = merger(path)
    blob = compiled({w: merge.ids(w) for w in frequent_words(docs, rule)})
    shared = docs.sparkSession.sparkContext.broadcast(blob)
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.mapInArrow(_encode(path, shared, rule, with_ids), ddl)
