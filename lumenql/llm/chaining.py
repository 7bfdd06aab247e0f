"""Fuzzy repeated passages by collinear chaining.

1. Texts are dealt into blocks.  A block sends its distinct seeds - all k-mers of lower-cased words, or
   winnowed ones - with the first document and word they occur at.
2. A bucket of seeds finds the first document of all that has a seed and answers the blocks.  Each
   place thus matches one earlier document at most: a passage that a third of all documents share costs
   one match for each place, never pairs.  A k-mer's second, third, ... occurrence in a text is a seed of its
   own; if no earlier document has it as often, it matches the k-mer's first place.
3. A block groups a document's matches by earlier document, merges those on a diagonal into anchors
   and chains anchors that are ordered in both texts; the best predecessor under a linear gap cost
   is a prefix maximum, kept in a Fenwick tree.
4. Chains of more than a chance seed (size + 2 words) travel with their words to the block of the earlier document, where
   gaps between anchors are aligned by a bit-parallel longest common subsequence and ends are extended
   over the margin by the alignment of the best score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenql.llm import kernel as K
from lumenql.llm.shared import bounded_buckets, saved, ship, text_bytes


@dataclass(frozen=True)
class Chaining:
    """Words of a seed and seeds of a winnowing window (a common run of size + window - 1 words has a seed; 1 takes all),
    cost of a gap word, longest gap, what makes a passage: words and similarity, and words that travel with each end of a
    chain so that its alignment can be extended."""

    size: int = 5
    window: int = 1
    gap_cost: float = 0.2
    max_gap: int = 40
    min_words: int = 40
    similarity: float = 0.75
    margin: int = 100
    block_bytes: int = 4 << 20
    bucket_bytes: int = 24 << 20


class _Words:
    """Word hashes of a batch of texts, and their winnowed seeds."""

    def __init__(self, batch: pa.RecordBatch, rule: Chaining, seeds: bool = True):
        data, ends = K.utf8(batch.column("text"))
        hashes, _, _, self.first = K.words(data, ends, lower=True)
        self.words = (hashes >> np.uint64(32)).astype(np.uint32)
        self.docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
        if not seeds:
            return
        k, w = rule.size, rule.window
        n = len(hashes) - k + 1
        chosen = np.zeros(max(n, 0), bool)
        row = np.repeat(np.arange(batch.num_rows), np.diff(self.first))
        if n >= w:
            grams = np.zeros(n, np.uint64)
            for i in range(k):
                grams += hashes[i : i + n] * K._SLOT[i + 1]
            grams = K.mix(grams)
            least = K.sliding_min(grams, w)
            whole = row[: len(least)] == row[k + w - 2 :]
            for o in range(w):
                chosen[o : o + len(least)] |= (grams[o : o + len(least)] == least) & whole
            at = np.flatnonzero(chosen)
            self.plain, self.row = grams[at], row[at].astype(np.int32)
            self.seed = _numbered(self.plain, self.row)
        else:
            at, self.plain, self.seed, self.row = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.place = (at - self.first[self.row]).astype(np.int32)

    @property
    def doc(self) -> np.ndarray:
        return self.docs[self.row]


def _numbered(seed: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Seeds that tell a k-mer's first, second, ... occurrence in a text apart, so that repetitive texts match place by place."""
    # a text's own order of seeds; only those that occur again are ordered by their places
    own = K.mix(seed ^ (row.astype(np.uint64) * K._SLOT[0]))
    order = np.argsort(own)
    s = own[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return seed
    often = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    often = often[np.lexsort((often, own[often]))]
    begin = np.concatenate([[True], own[often[1:]] != own[often[:-1]]])
    index = np.arange(len(often))
    turn = index - np.maximum.accumulate(np.where(begin, index, 0))
    again, turn = often[turn > 0], turn[turn > 0]
    out = seed.copy()
    out[again] = K.mix(seed[again] + turn.astype(np.uint64) * K._SLOT[0])
    return out


def _read(table: pa.Table, rule: Chaining, seeds: bool = True) -> Iterator[_Words]:
    """In order of doc_id."""
    for batch in K.slices(iter(table.select(["doc_id", "text"]).sort_by("doc_id").combine_chunks().to_batches())):
        yield _Words(batch, rule, seeds)


def _key(seed: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of a seed; chains check the words themselves."""
    many = np.uint64(buckets)
    return ((seed % many) << np.uint64(32)) | ((seed // many) & np.uint64(0xFFFFFFFF))


def _in_order(doc: np.ndarray, place: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """All arrays in order of (doc, place); most come in that order, or in runs of it."""
    rises = lambda d, p: ((d[1:] > d[:-1]) | ((d[1:] == d[:-1]) & (p[1:] >= p[:-1]))).all()
    arrays = (doc, place, *more)
    if rises(doc, place):
        return arrays
    turn = np.argsort(doc, kind="stable")
    if not rises(doc[turn], place[turn]):
        turn = np.lexsort((place, doc))
    return tuple(a[turn] for a in arrays)


def _firsts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each key occurs first, in order of key; the number of each place's key)."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(key)
    s = key[order]
    head = np.concatenate([[True], s[1:] != s[:-1]])
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(head) - 1
    return np.minimum.reduceat(order, np.flatnonzero(head)), number


def _narrow(numbers: np.ndarray, below: int) -> np.ndarray:
    """Integers of 16 bits, where they fit, are sorted by radix."""
    return numbers.astype(np.uint16 if below <= 1 << 16 else np.int32)


def _packed(short: np.ndarray, doc: np.ndarray, place: np.ndarray) -> bytes:
    """Seeds in order of (doc, place): steps between documents, and bytes of one weight side by side, compress well."""
    step = np.diff(doc, prepend=doc.dtype.type(0))
    planes = (x.view(np.uint8).reshape(len(doc), -1).T.tobytes() for x in (step.astype("<i8"), place.astype("<i4")))
    return len(doc).to_bytes(4, "little") + pa.compress(short.astype("<u4").tobytes() + b"".join(planes), "zstd", asbytes=True)


def _unpacked(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(short, doc, place, row) of the packed seeds of all rows."""
    parts = [(np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))]
    for r, x in enumerate(column):
        blob = x.as_py()
        n = int.from_bytes(blob[:4], "little")
        raw = np.frombuffer(pa.decompress(blob[4:], 16 * n, "zstd", asbytes=True), np.uint8)
        plane = lambda a, b: np.ascontiguousarray(raw[a * n : b * n].reshape(-1, n).T)  # noqa: B023, E731
        parts.append((raw[: 4 * n].view("<u4"), np.cumsum(plane(4, 12).view("<i8").ravel()), plane(12, 16).view("<i4").ravel(), np.full(n, r)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def _seeds(rule: Chaining, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        found = [(w.doc, w.place, w.seed) for w in _read(table, rule)]
        doc, place, seed = _in_order(*(np.concatenate(x) for x in zip(*found, strict=True)))
        once = np.sort(_firsts(_key(seed, buckets))[0])
        seed, doc, place = seed[once], doc[once], place[once]
        short = (seed // np.uint64(buckets)).astype(np.uint32)
        order, cut = K.grouped(_narrow(seed % np.uint64(buckets), buckets))
        parts = [(int(seed[i[0]] % np.uint64(buckets)), _packed(short[i], doc[i], place[i])) for i in (order[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True))]
        block = table.column("block")[0].as_py()
        return pa.table({"bucket": pa.array([b for b, _ in parts], pa.int32()), "block": pa.array([block] * len(parts), pa.int64()), "rows": pa.array([x for _, x in parts], pa.binary())})

    return run


def _first_places(table: pa.Table) -> pa.Table:
    """For each block its seeds that an earlier document of another block has, with the first place of all."""
    short, doc, place, row = _unpacked(table.column("rows"))
    bucket = table.column("bucket")[0].as_py()
    blocks = table.column("block").to_numpy()
    doc, place, short, row = _in_order(doc, place, short, row)
    once, number = _firsts(short)
    of = once[number]
    later = np.flatnonzero(doc > doc[of])
    order, cut = K.grouped(_narrow(row[later], len(blocks)))
    later = later[order]
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        i = later[a:b]
        i = i[np.argsort(of[i])]
        out.append((int(blocks[row[i[0]]]), _packed(short[i], doc[of[i]], place[of[i]])))
    return pa.table({"block": pa.array([o[0] for o in out], pa.int64()), "bucket": pa.array([bucket] * len(out), pa.int32()), "rows": pa.array([o[1] for o in out], pa.binary())})


def best_chains(x: np.ndarray, y: np.ndarray, length: np.ndarray, rule: Chaining) -> list[list[int]]:
    """Chains of anchors (x, y, length), sorted by x: indices in order, best chain first, each anchor in one chain at most.

    score(i) = length(i) + max(0, max over j before i in x and y, within max_gap in both, of score(j) - gap_cost * (gap in x + gap in y));
    without max_gap the inner maximum is a prefix maximum over ranks of y of score(j) + gap_cost * (end of j in x and y).
    If that one is out of reach, those whose end in x is in reach are compared: as a place has one match, they are
    about max_gap at most."""
    n, cost = len(x), rule.gap_cost
    xs, ys, ls = x.tolist(), y.tolist(), length.tolist()
    rank = (np.searchsorted(np.unique(y), y) + 1).tolist()
    tree = [(-1e18, -1)] * (n + 1)
    score, total, back = [0.0] * n, [0.0] * n, [-1] * n
    near: list[int] = []
    for i in range(n):
        best, at = (-1e18, -1), rank[i] - 1
        while at > 0:
            if tree[at] > best:
                best = tree[at]
            at -= at & -at
        to_x, to_y = xs[i] - rule.max_gap, ys[i] - rule.max_gap
        if best[0] > cost * (xs[i] + ys[i]) and (xs[best[1]] + ls[best[1]] < to_x or ys[best[1]] + ls[best[1]] < to_y):
            near = [j for j in near if xs[j] + ls[j] >= to_x]
            best = max(((total[j], j) for j in near if ys[j] < ys[i] and ys[j] + ls[j] >= to_y), default=(-1e18, -1))
        gain = best[0] - cost * (xs[i] + ys[i])
        score[i] = ls[i] + max(0.0, gain)
        if gain > 0:
            back[i] = best[1]
        near.append(i)
        total[i] = score[i] + cost * (xs[i] + ys[i] + 2 * ls[i])
        entry, at = (total[i], i), rank[i]
        while at <= n:
            if entry > tree[at]:
                tree[at] = entry
            at += at & -at
    used, chains = [False] * n, []
    for i in sorted(range(n), key=lambda j: -score[j]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            chains.append(chain[::-1])
    return chains


def _chains(rule: Chaining, buckets: int):
    """Chains of each document of a block: (doc, source, base, words, anchors)."""
    margin = rule.margin

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if texts.num_rows:
            short, source, at, row = _unpacked(answers.column("rows"))
            known = (answers.column("bucket").to_numpy().astype(np.uint64)[row] << np.uint64(32)) | short
            order = np.argsort(known)
            known, source, at = known[order], source[order], at[order]
            held = list(_read(texts, rule))
            own = [(w.doc, w.place, _key(w.seed, buckets)) for w in held]
            doc, place, key = (np.concatenate(c) for c in zip(*own, strict=True))
            del own
            doc, place, key, turn = _in_order(doc, place, key, np.arange(len(key)))
            once, number = _firsts(key)
            key, doc, place = key[once], doc[once], place[once]
            # a first place in another block comes before all of this one's
            spot = np.searchsorted(known, key)
            left = np.ones(len(key), bool)
            inside = spot < len(known)
            left[inside] = known[spot[inside]] != key[inside]
            known, source, at = (np.insert(a, spot[left], b[left]) for a, b in ((known, key), (source, doc), (at, place)))
            # where the own seeds' keys are among all
            entry = np.empty(len(turn), np.int64)
            entry[turn] = (spot + np.cumsum(left) - left)[number]
            begin = 0
            for w in held:
                i = entry[begin : begin + len(w.seed)]
                begin += len(w.seed)
                # an occurrence that no earlier document has as often matches the first place of the k-mer
                alone = np.flatnonzero((w.seed != w.plain) & (source[i] >= w.doc))
                i[alone] = np.searchsorted(known, _key(w.plain[alone], buckets))
                out += _of_texts(w, source[i], at[i], rule, margin)
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["doc", "source", "base", "words", "anchors"])

    return run


def _of_texts(w: _Words, source: np.ndarray, at: np.ndarray, rule: Chaining, margin: int) -> list[tuple]:
    hit = np.flatnonzero(source < w.doc)
    if not len(hit):
        return []
    row, source, x, y = w.row[hit], source[hit], w.place[hit].astype(np.int64), at[hit].astype(np.int64)
    order = np.lexsort((x, y - x, source, row))
    row, source, x, y = row[order], source[order], x[order], y[order]
    same = (row[1:] == row[:-1]) & (source[1:] == source[:-1])
    run = np.concatenate([[True], ~(same & (y[1:] - x[1:] == y[:-1] - x[:-1]) & (x[1:] - x[:-1] <= rule.size))])
    begin = np.flatnonzero(run)
    last = np.append(begin[1:], len(x)) - 1
    ax, ay, al, ar, asrc = x[begin], y[begin], x[last] - x[begin] + rule.size, row[begin], source[begin]
    order = np.lexsort((ay, ax, asrc, ar))
    ax, ay, al, ar, asrc = (v[order] for v in (ax, ay, al, ar, asrc))
    pair = np.flatnonzero(np.concatenate([[True], (ar[1:] != ar[:-1]) | (asrc[1:] != asrc[:-1])]))
    out = []
    for p, e in zip(pair, np.append(pair[1:], len(ax)), strict=True):
        sx, sy, sl = ax[p:e], ay[p:e], al[p:e]
        r = ar[p]
        n = w.first[r + 1] - w.first[r]
        for chain in best_chains(sx, sy, sl, rule) if e - p > 1 else [[0]]:
            a, b = int(sx[chain[0]]), int(sx[chain[-1]] + sl[chain[-1]])
            if b - a < rule.size + 2:
                continue
            base, end = max(0, a - margin), min(int(n), b + margin)
            text = w.words[w.first[r] + base : w.first[r] + end]
            anchors = np.array([sx[chain], sy[chain], sl[chain]], np.int32)
            out.append((int(w.docs[r]), int(asrc[p]), base, text.tobytes(), anchors.tobytes()))
    return out


def common_words(a: list[int], b: list[int]) -> int:
    """Length of a longest common subsequence, bit-parallel."""
    if not a or not b:
        return 0
    masks: dict[int, int] = {}
    for i, v in enumerate(a):
        masks[v] = masks.get(v, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        m = v & masks.get(c, 0)
        v = ((v + m) | (v - m)) & full
    return len(a) - v.bit_count()


#: What an edit takes from the score of an end, where a common word gives 1: ends that are 2/3, 3/4 or 1/2 alike go on.
_USUAL, _WIDE = (2, 3), (1,)


def extended(a: list[int], b: list[int], edits: tuple[int, ...]) -> list[tuple[int, int]]:
    """For each cost of an edit, words of a and b in the longest pair of beginnings with the best score.

    far[k] is the last place in a that e edits reach on the diagonal k; an added or missing word costs half a word
    more than a changed one, so the score follows from place and edits.  It ends when no words in common are
    left that could pay for another edit."""
    limit = (Counter(a) & Counter(b)).total()
    i, na, nb = 0, len(a), len(b)
    while i < na and i < nb and a[i] == b[i]:
        i += 1
    far, e = {0: i}, 0
    best = [(float(i), i, i) for _ in edits]
    while far:
        e += 1
        if all(limit - c * e < s[0] for c, s in zip(edits, best, strict=True)):
            break
        new = {}
        for k in range(-e, e + 1):
            i = max(far.get(k, -2) + 1, far.get(k - 1, -2) + 1, far.get(k + 1, -1))
            j = i - k
            if i < 0 or j < 0 or i > na or j > nb:
                continue
            while i < na and j < nb and a[i] == b[j]:
                i, j = i + 1, j + 1
            new[k] = i
            if i and j and a[i - 1] == b[j - 1]:
                for o, c in enumerate(edits):
                    best[o] = max(best[o], ((i + j) / 2 - (c + 1) * e, i, j))
        far = new
    return [(i, j) for _, i, j in best]


def _ends(a: list[int], b: list[int], edits: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(words of a, words of b, common words) of the ways to extend an end; the last ends at the first unequal word."""
    same = 0
    while same < len(a) and same < len(b) and a[same] == b[same]:
        same += 1
    # more words of b cost more than all of a brings
    ways = dict.fromkeys([*extended(a, b[: 2 * len(a)], edits), (same, same)])
    return [(i, j, common_words(a[:i], b[:j])) for i, j in ways]


def _hopeless(common: int, in_a: int, in_b: int, ends: list[tuple[list[int], list[int]]], rule: Chaining) -> bool:
    """Whether no extension of these many words makes a passage: with c common words at most it has c / similarity
    words at most in either text, and ends cut to that leave fewer common words."""
    for alike in (lambda a, b: (Counter(a) & Counter(b)).total(), common_words):
        size = -1
        while size != (size := sum(len(a) + len(b) for a, b in ends)):
            most = int((common + sum(alike(a, b) for a, b in ends)) / rule.similarity + 1e-9)
            if most < max(rule.min_words, in_a, in_b):
                return True
            ends = [(a[: most - in_a], b[: most - in_b]) for a, b in ends]
    return False


def align(a: list[int], b: list[int], anchors: list[tuple[int, int, int]], rule: Chaining) -> tuple[int, int, int, int, int] | None:
    """(from, to in a, from, to in b, common words) of the chain's alignment with most common words that is similar and long enough; None without one.

    A passage begins and ends with words in common.  Ends of little likeness are taken only if it is too short else."""
    anchors = [(x, y, n) for x, y, n in anchors if a[x : x + n] == b[y : y + n]]
    if not anchors:
        return None
    x, y, n = anchors[0]
    left, common, (i, j) = (x, y), n, (x + n, y + n)
    for x, y, n in anchors[1:]:
        skip = max(0, i - x, j - y)
        if skip >= n:
            continue
        x, y, n = x + skip, y + skip, n - skip
        common += common_words(a[i:x], b[j:y]) + n
        i, j = x + n, y + n
    x, y = left
    if _hopeless(common, i - x, j - y, [(a[:x][::-1], b[:y][::-1]), (a[i:], b[j:])], rule):
        return None
    for edits in (_USUAL, _WIDE):
        before, after = _ends(a[:x][::-1], b[:y][::-1], edits), _ends(a[i:], b[j:], edits)
        found = [(x - l[0], i + r[0], y - l[1], j + r[1], common + l[2] + r[2]) for l, r in product(before, after)]  # noqa: E741
        found = [f for f in found if f[1] - f[0] >= rule.min_words and f[4] >= rule.similarity * max(f[1] - f[0], f[3] - f[2])]
        if found:
            return max(found, key=lambda f: f[4])
    return None


_PASSAGE = pa.schema([("doc_id", pa.int64()), ("source_id", pa.int64()), *((c, pa.int32()) for c in ("start_word", "end_word", "source_start", "source_end", "common"))])
_PASSAGE_DDL = "doc_id long, source_id long, start_word int, end_word int, source_start int, source_end int, common int"


def _aligned(rule: Chaining):
    def run(texts: pa.Table, chains: pa.Table) -> pa.Table:
        found = []
        if texts.num_rows and chains.num_rows:
            words: dict[int, list[np.ndarray]] = {}
            for w in _read(texts.filter(pc.is_in(texts.column("doc_id"), chains.column("source"))), rule, seeds=False):
                for r, d in enumerate(w.docs.tolist()):
                    words.setdefault(d, []).append(w.words[w.first[r] : w.first[r + 1]].copy())
            rows = []
            for doc, source, base, blob, packed in zip(*(chains.column(c).to_pylist() for c in ("doc", "source", "base", "words", "anchors")), strict=True):
                anchors = np.frombuffer(packed, np.int32).reshape(3, -1)
                rows.append((doc, source, -int(anchors[2].sum()), int(anchors[0, 0]), base, blob, anchors))
            last, own = None, []
            for doc, source, _, _, base, blob, (ax, ay, al) in sorted(rows, key=lambda r: r[:5]):
                if (doc, source) != last:
                    last, own = (doc, source), []
                # a chain within a passage of the same pair would give it again
                if any(p[2] <= ax[0] and ax[-1] + al[-1] <= p[3] and p[4] <= ay[0] and ay[-1] + al[-1] <= p[5] for p in own):
                    continue
                a = np.frombuffer(blob, np.uint32).tolist()
                low, high = max(0, int(ay[0]) - 2 * len(a)), int(ay[-1] + al[-1]) + 2 * len(a)
                anchors = list(zip((ax - base).tolist(), (ay - low).tolist(), al.tolist(), strict=True))
                aligned = (align(a, text[low:high].tolist(), anchors, rule) for text in words.get(source, []))
                best = max((r for r in aligned if r), key=lambda r: r[4], default=None)
                if best:
                    own.append((doc, source, best[0] + base, best[1] + base, best[2] + low, best[3] + low, best[4]))
                    found.append(own[-1])
        columns = list(zip(*found, strict=True)) if found else [[]] * len(_PASSAGE)
        return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, _PASSAGE, strict=True)], schema=_PASSAGE)

    return run


def passages(docs: DataFrame, rule: Chaining = Chaining()) -> DataFrame:
    """(doc_id, source_id, start_word, end_word, source_start, source_end, common): each passage of a document that resembles one of an earlier document.

    Words are [^\\x20\\x09-\\x0D]+, A-Z lower-cased, counted from 0; `common` words are alike in both.
    The earlier document is, seed by seed, the one with the smallest doc_id, so each later copy is linked
    to a first place and copies aren't paired among each other.  Null and empty texts and null
    doc_ids have no passages, rows that repeat a doc_id are one document, other columns aren't read."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    total = text_bytes(docs)
    blocks, buckets = max(1, -(-total // rule.block_bytes)), bounded_buckets(total, rule.bucket_bytes)
    parts = bounded_buckets(total, 64 << 20, int(spark.conf.get("spark.sql.shuffle.partitions")))
    block_of = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(blocks)).cast("long")
    texts = docs.withColumn("block", block_of("doc_id")).repartition(parts, "block")
    seeds = texts.groupBy("block").applyInArrow(_seeds(rule, buckets), "bucket int, block long, rows binary")
    first = seeds.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_first_places, "block long, bucket int, rows binary")
    chains = texts.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(_chains(rule, buckets), "doc long, source long, base int, words binary, anchors binary")
    chains = chains.withColumn("block", block_of("source"))
    return texts.groupBy("block").cogroup(chains.groupBy("block")).applyInArrow(_aligned(rule), _PASSAGE_DDL)


def _cut(spans: str):
    """Takes the words of the spans in that column out of each text, with the separators after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            data, ends = K.utf8(batch.column("text"))
            _, starts, stops, first = K.words(data, ends)
            texts = batch.column("text").to_pylist()
            for r, own in enumerate(batch.column(spans).to_pylist()):
                base, begin, stop = first[r], ends[r], ends[r + 1]
                keep = np.ones(stop - begin, bool)
                n = first[r + 1] - base
                for s in own:
                    if s["start_word"] >= n:
                        continue
                    a = starts[base + s["start_word"]] if s["start_word"] else begin
                    b = starts[base + s["end_word"]] if s["end_word"] < n else stop
                    keep[a - begin : b - begin] = False
                texts[r] = data[begin:stop][keep].tobytes().decode()
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string())).drop_columns([spans])

    return run


def cut_passages(docs: DataFrame, rule: Chaining = Chaining()) -> DataFrame:
    """docs with the repeated passages cut out of later documents' texts; those with no words left go, first places stay.

    Word positions of a passage hold for every row of its doc_id; a row whose text is shorter is cut to its end."""
    ship(docs.sparkSession)
    spans = "_spans"
    while spans in docs.columns:
        spans += "_"
    found = saved(passages(docs, rule), "zpassages").groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias(spans))
    named = [F.col(f"`{c}`") for c in docs.columns]
    joined = docs.join(found, "doc_id", "left").select(*named, spans)
    after = joined.where(F.col(spans).isNotNull()).mapInArrow(_cut(spans), docs.schema).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return joined.where(F.col(spans).isNull()).drop(spans).unionByName(after)
