"""Removal of byte strings that an earlier document has, by prefix-free parsing.

A rolling hash over `trigger` bytes sets the triggers: in every `length`-byte window the smallest
hash is one, so each window holds a trigger, and equal windows hold the same at the same place.
Triggers cut a text into *phrases*; a phrase carries all windows that share its trigger, with
their bytes, so phrases overlap and none is a prefix of another.

* Dictionary: distinct phrases, each with the smallest document it is in.  Highly repetitive text
  has few; copies of a phrase are settled by the fingerprints of phrase and trigger, over 100 bits together.
* Parse: each document as its sequence of phrases; what the dictionary says of a phrase goes to
  every place of it in the parse.
* Suffixes: a window reaches half its spare bytes or more to the left of its trigger, or to the right.  So phrases that
  share a window share their trigger together with the bytes on one side, of which the dictionary has a code.  Phrases of
  which another one has trigger and code travel with their bytes.  A key range of triggers
  sorts the suffixes of its phrases by prefix doubling, to the depth `length` that the rule asks for, so
  neighbours in the suffix array that are equal to that depth are equal byte for byte.  A run of them in the order of
  the parse, by doc_id, gives the first place.

The texts are dealt into blocks for the dictionary, and once more for the two passes after it, when the dictionary's
shuffle files are gone.  What leaves a block is
already reduced to distinct phrases, so a phrase that a third of all documents share reaches
its bucket once for each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenql.llm import kernel as K
from lumenql.llm.shared import bounded_buckets, pack, saved, ship, text_bytes, unpack

_LARGEST = np.iinfo(np.int64).max
#: Parts of a bucket's triggers; those of bounded bytes are sorted at a time.
_PARTS = 256
#: The code of a side that may be any.
_ANY = 255


@dataclass(frozen=True)
class SuffixDedup:
    """Length of strings that count as repeated, bytes of the rolling hash, text bytes in a block and behind a bucket,
    and bytes of phrases whose suffixes are sorted at a time (more if a part of the triggers has more)."""

    length: int = 50
    trigger: int = 20
    block_bytes: int = 4 << 20
    bucket_bytes: int = 24 << 20
    sorted_bytes: int = 2 << 20


class _Parse:
    """The phrases of a batch of texts."""

    def __init__(self, batch: pa.RecordBatch, rule: SuffixDedup):
        self.data, self.ends = K.utf8(batch.column("text"))
        self.ranges = K.Ranges(self.data)
        self.docs = batch.column("doc_id").fill_null(_LARGEST).to_numpy(zero_copy_only=False)
        size, n = rule.length, len(self.data) - rule.length + 1
        if n <= 0:
            self.row = self.lo = self.hi = np.zeros(0, np.int64)
            self.trigger = self.phrase = np.zeros(0, np.uint64)
        else:
            least = K.sliding_min(self.ranges.windows(rule.trigger), size - rule.trigger + 1)
            row = np.repeat(np.arange(batch.num_rows, dtype=np.int32), np.diff(self.ends))
            inside = row[:n] == row[size - 1 :]
            new = np.ones(n, bool)
            new[1:] = (least[1:] != least[:-1]) | (row[1:n] != row[: n - 1])
            self.lo = np.flatnonzero(new & inside)
            breaks = np.flatnonzero(new | ~inside)
            self.hi = np.append(breaks, n)[np.searchsorted(breaks, self.lo, "right")]
            self.row = row[self.lo]
            self.trigger = least[self.lo]
            self.phrase = self.ranges.of(self.lo, self.hi - 1 + size)
        self.doc = self.docs[self.row]

    def sides(self, rule: SuffixDedup) -> tuple[np.ndarray, np.ndarray]:
        """For each phrase codes of its trigger with the bytes to the left and to the right of it that half its windows have, or 0 if no window
        has them; _ANY twice if the trigger's hash is in the phrase more than once, so that its place isn't certain."""
        spare, n = rule.length - rule.trigger, len(self.lo)
        half = spare // 2
        at, found = np.full(n, -1), np.zeros(n, np.int64)
        if n:
            hashes = self.ranges.windows(rule.trigger)
            for k in range(spare + 1):
                here = hashes[self.lo + k] == self.trigger
                at[here] = (self.lo + k)[here]
                found += here
            for k in range(spare + 1):
                found += (self.hi - 1 + k > self.lo + spare) & (hashes[self.hi - 1 + k] == self.trigger)
        known = (found == 1) & (self.hi - self.lo <= spare + 1)
        codes = []
        for has, a, b in ((self.lo <= at - half, at - half, at + rule.trigger), (self.hi - 1 >= at - half, at, at + rule.length - half)):
            code = np.zeros(n, np.uint8)
            i = np.flatnonzero(known & has)
            code[i] = self.ranges.of(a[i], b[i]) % np.uint64(_ANY - 1) + np.uint64(1)
            code[~known] = _ANY
            codes.append(code)
        return codes[0], codes[1]

    def windows(self, which: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprints, starts, documents) of all windows of the chosen phrases."""
        many = (self.hi - self.lo)[which]
        start = np.repeat(self.lo[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return self.ranges.of(start, start + length), start, np.repeat(self.doc[which], many)


def _parses(table: pa.Table, rule: SuffixDedup) -> Iterator[_Parse]:
    for batch in K.slices(iter(table.select(["doc_id", "text"]).combine_chunks().to_batches())):
        yield _Parse(batch, rule)


def _least(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, a place of each, its smallest document)."""
    order, begin = K.grouped(keys)
    if not len(keys):
        return keys, order, docs
    return keys[order[begin[:-1]]], order[begin[:-1]], np.minimum.reduceat(docs[order], begin[:-1])


def _in(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array."""
    if not len(known):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys


def _first_doc(keys: np.ndarray, known: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return docs[np.searchsorted(known, keys)]


_SENT = "bucket int, block long, rows binary"
_ANSWER = "block long, kind int, keys binary"


def _sent(block: int, parts: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"bucket": pa.array([b for b, _ in parts], pa.int32()), "block": pa.array([block] * len(parts), pa.int64()), "rows": pa.array([x for _, x in parts], pa.binary())})


def _steps(docs: np.ndarray) -> bytes:
    """Ascending documents as their differences, in as few bytes each as the largest needs."""
    steps = np.diff(docs.astype(np.int64).view(np.uint64), prepend=np.uint64(0))
    first, steps[0] = int(steps[0]), 0
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(steps.max()) < 1 << 8 * w)
    return len(docs).to_bytes(4, "little") + bytes([width]) + first.to_bytes(8, "little") + steps.astype(f"<u{width}").tobytes()


def _from_steps(blob: memoryview) -> tuple[np.ndarray, int]:
    """(documents, where their bytes end)."""
    n, width = int.from_bytes(blob[:4], "little"), blob[4]
    docs = np.cumsum(np.frombuffer(blob, f"<u{width}", n, 13), dtype=np.uint64) + np.frombuffer(blob, "<u8", 1, 5)
    return docs.view(np.int64), 13 + n * width


_ENTRY = ("<u4", "<u8", "u1", "u1")


def _dictionary(rule: SuffixDedup, buckets: int):
    """Pass 1: the distinct phrases of a block."""

    def run(table: pa.Table) -> pa.Table:
        found = [(p.trigger, p.phrase, p.doc, *p.sides(rule)) for p in _parses(table, rule)]
        trigger, phrase, doc, left, right = (np.concatenate(x) for x in zip(*found, strict=True))
        phrase, at, doc = _least(phrase, doc)
        trigger, left, right = trigger[at], left[at], right[at]
        short = (trigger // np.uint64(buckets)).astype(np.uint32)
        bucket = (trigger % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((doc, bucket))
        cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        groups = np.split(order, cut[1:]) if len(order) else []
        return _sent(table.column("block")[0].as_py(), [(int(bucket[i[0]]), _steps(doc[i]) + pack(short[i], phrase[i], left[i], right[i])) for i in groups])

    return run


def _entries(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """(trigger, phrase, left, right, doc) of all rows of a bucket, and each one's row."""
    parts = []
    for x in table.column("rows"):
        blob = memoryview(x.as_buffer())
        doc, at = _from_steps(blob)
        parts.append((*unpack(blob[at:], *_ENTRY), doc))
    return [np.concatenate(x) for x in zip(*parts, strict=True)], np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[0]) for p in parts])


def _answers(blocks: np.ndarray, row: np.ndarray, kind: int, keys: np.ndarray) -> list[tuple[int, int, bytes]]:
    order, begin = K.grouped(row)
    return [(int(blocks[row[order[a]]]), kind, keys[order[a:b]].tobytes()) for a, b in zip(begin[:-1], begin[1:], strict=True)]


def _table(answers: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"block": pa.array([a[0] for a in answers], pa.int64()), "kind": pa.array([a[1] for a in answers], pa.int32()), "keys": pa.array([a[2] for a in answers], pa.binary())})


def _several(keys: np.ndarray) -> np.ndarray:
    """Which keys are there more than once."""
    order, begin = K.grouped(keys)
    out = np.empty(len(keys), bool)
    many = np.diff(begin)
    out[order] = np.repeat(many > 1, many)
    return out


def _alike(trigger: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the distinct phrases may have a window that another one has: of their trigger another has a side, or any has _ANY."""
    out = np.zeros(len(trigger), bool)
    i = np.flatnonzero(_several(trigger))
    if len(i):
        of = trigger[i].astype(np.uint64) << np.uint64(8)
        out[i] = _in(trigger[i], np.unique(trigger[i][left[i] == _ANY]))
        for side in (left[i], right[i]):
            out[i] |= (side > 0) & _several(of | side)
    return out


def _merge_dictionaries(table: pa.Table) -> pa.Table:
    """Which phrases an earlier document of another block has (kind 0), and which first places may share a window with another phrase (kind 1)."""
    if not table.num_rows:
        return _table([])
    (trigger, phrase, left, right, doc), row = _entries(table)
    blocks = table.column("block").to_numpy()
    order = np.lexsort((phrase, trigger))
    t, p = trigger[order], phrase[order]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (p[1:] != p[:-1])])
    begin = np.flatnonzero(new)
    of = np.empty(len(order), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    least = np.minimum.reduceat(doc[order], begin)
    at = order[begin]
    shared = _alike(t[begin], left[at], right[at])
    later = doc > least[of]
    first = ~later & shared[of]
    return _table(_answers(blocks, row[later], 0, phrase[later]) + _answers(blocks, row[first], 1, phrase[first]))


def _keys(table: pa.Table, kind: int) -> np.ndarray:
    if not table.num_rows:
        return np.zeros(0, np.uint64)
    chosen = [np.frombuffer(x.as_buffer(), np.uint64) for k, x in zip(table.column("kind").to_pylist(), table.column("keys"), strict=True) if k == kind]
    return np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.uint64)


def _local_first(parses: list[_Parse]) -> tuple[np.ndarray, np.ndarray]:
    known, _, least = _least(np.concatenate([p.phrase for p in parses]), np.concatenate([p.doc for p in parses]))
    return known, least


def _suffixes(rule: SuffixDedup, buckets: int):
    """Pass 2: the phrases of a block that share a trigger, once each, with their bytes and first document."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        shared = _keys(answers, 1)
        if not texts.num_rows or not len(shared):
            return _sent(0, [])
        parses = list(_parses(texts, rule))
        chosen = [np.flatnonzero(_in(p.phrase, shared)) for p in parses]
        of = np.repeat(np.arange(len(parses)), [len(c) for c in chosen])
        phrase, doc, trigger, lo, hi = (np.concatenate([getattr(p, name)[c] for p, c in zip(parses, chosen, strict=True)]) for name in ("phrase", "doc", "trigger", "lo", "hi"))
        order = np.lexsort((doc, phrase))
        once = order[np.concatenate([[True], phrase[order][1:] != phrase[order][:-1]])] if len(order) else order
        bucket = (trigger[once] % np.uint64(buckets)).astype(np.int64)
        by, cut = K.grouped(bucket)
        out = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            i = once[by[a:b]]
            size = hi[i] - lo[i] - 1 + rule.length
            raw = b"".join(parses[k].data[x : x + n].tobytes() for k, x, n in zip(of[i].tolist(), lo[i].tolist(), size.tolist(), strict=True))
            part = ((trigger[i] // np.uint64(buckets)) % np.uint64(_PARTS)).astype(np.uint8)
            out.append((int(bucket[by[a]]), len(i).to_bytes(4, "little") + pack(doc[i].astype("<i8"), size.astype("<u4"), part) + raw))
        return _sent(texts.column("block")[0].as_py(), out)

    return run


def suffix_ranks(data: np.ndarray, start: np.ndarray, depth: int) -> np.ndarray:
    """For each start the rank of its suffix among all, compared to `depth` bytes (8 at least): by prefix doubling, in lexicographic order."""
    padded = np.concatenate([data, np.zeros(depth, np.uint8)])
    key = np.zeros(len(data), np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + len(data)]
    rank, have = np.unique(key, return_inverse=True)[1], 8
    while 2 * have <= depth:
        ahead = np.concatenate([rank[have:], np.zeros(have, rank.dtype)])
        rank, have = np.unique(rank * (int(rank.max(initial=0)) + 1) + ahead, return_inverse=True)[1], 2 * have
    return np.unique(rank[start] * (int(rank.max(initial=0)) + 1) + rank[start + (depth - have)], return_inverse=True)[1]


def _runs(part: np.ndarray, size: np.ndarray, most: int) -> list[np.ndarray]:
    """The phrases dealt by part of the triggers into runs of parts, of `most` bytes each where more than one part is in it."""
    upto = np.cumsum(np.bincount(part, size, minlength=_PARTS)).astype(np.int64)
    turn, begin, turns = 0, 0, np.zeros(_PARTS, np.int64)
    for i in range(_PARTS):
        if upto[i] - begin > most and i and upto[i - 1] > begin:
            turn, begin = turn + 1, upto[i - 1]
        turns[i] = turn
    order, cut = K.grouped(turns[part])
    return [order[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _merge_suffixes(rule: SuffixDedup):
    """Windows that an earlier document of another block has (kind 2), from suffix arrays of a bucket's phrases, one for each run of triggers."""

    def run(table: pa.Table) -> pa.Table:
        docs, sizes, parts, rows, raw = [], [], [], [], []
        for r, x in enumerate(table.column("rows")):
            blob = memoryview(x.as_buffer())
            n = int.from_bytes(blob[:4], "little")
            docs.append(np.frombuffer(blob, "<i8", n, 4))
            sizes.append(np.frombuffer(blob, "<u4", n, 4 + 8 * n))
            parts.append(np.frombuffer(blob, "u1", n, 4 + 12 * n))
            raw.append(np.frombuffer(blob, np.uint8, -1, 4 + 13 * n))
            rows.append(np.full(n, r))
        docs, sizes, parts, rows, raw = (np.concatenate(x) for x in (docs, sizes, parts, rows, raw))
        sizes = sizes.astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        blocks, out = table.column("block").to_numpy(), []
        for i in _runs(parts, sizes, rule.sorted_bytes):
            size = sizes[i]
            data = raw[np.repeat(begin[i] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            out += _later_windows(rule, blocks, docs[i], size, rows[i], data)
        return _table(out)

    return run


def _later_windows(rule: SuffixDedup, blocks: np.ndarray, doc: np.ndarray, size: np.ndarray, row: np.ndarray, data: np.ndarray) -> list[tuple[int, int, bytes]]:
    many = size - rule.length + 1
    at = np.repeat(np.cumsum(size) - size, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    rank = suffix_ranks(data, at, rule.length)
    doc, row = np.repeat(doc, many), np.repeat(row, many)
    # of each block the first document of a run of equal suffixes, and of all
    own, spot, of = np.unique(rank * len(blocks) + row, return_index=True, return_inverse=True)
    first = np.full(len(own), _LARGEST)
    np.minimum.at(first, of, doc)
    least = np.full(int(rank.max(initial=-1)) + 1, _LARGEST)
    np.minimum.at(least, rank[spot], first)
    later = spot[first > least[rank[spot]]]
    return _answers(blocks, row[later], 2, K.Ranges(data).of(at[later], at[later] + rule.length))


def _remove(rule: SuffixDedup, with_text: bool):
    """Pass 3: marks and cuts."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _RESULT.empty_table() if with_text else _RESULT.empty_table().drop_columns(["kept"])
        settled, shared, windows = (_keys(answers, k) for k in (0, 1, 2))
        known, least = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        pairs, parts = [], []
        for p in _parses(texts, rule):
            which = np.flatnonzero(_in(p.phrase, shared))
            hashes, _, docs = p.windows(which, rule.length)
            keep = _least(p.phrase, p.doc)
            pairs.append((keep[0], keep[2]))
            parts.append(_least(hashes, docs)[::2])
        known, _, least = _least(np.concatenate([x[0] for x in pairs]), np.concatenate([x[1] for x in pairs]))
        seen, _, seen_doc = _least(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]))
        out = []
        for p in _parses(texts, rule):
            change = np.zeros(len(p.data) + 1, np.int32)
            gone = _in(p.phrase, settled) | (p.doc > _first_doc(p.phrase, known, least))
            np.add.at(change, p.lo[gone], 1)
            np.add.at(change, p.hi[gone] - 1 + rule.length, -1)
            which = np.flatnonzero(_in(p.phrase, shared) & ~gone)
            hashes, start, docs = p.windows(which, rule.length)
            again = _in(hashes, windows) | (docs > _first_doc(hashes, seen, seen_doc)) if len(hashes) else np.zeros(0, bool)
            np.add.at(change, start[again], 1)
            np.add.at(change, start[again] + rule.length, -1)
            cut = np.cumsum(change[:-1]) > 0
            head = cut.copy()
            head[1:] &= ~cut[:-1]
            edge = p.ends[:-1][np.diff(p.ends) > 0]
            head[edge] = cut[edge]
            removed = np.append(0, np.cumsum(cut))[p.ends]
            spans = np.append(0, np.cumsum(head))[p.ends]
            kept = [p.data[a:b][~cut[a:b]].tobytes() if r else p.data[a:b].tobytes() for a, b, r in zip(p.ends[:-1], p.ends[1:], np.diff(removed), strict=True)]
            columns = {
                "doc_id": pa.array(p.docs, pa.int64(), mask=p.docs == _LARGEST),
                "n_bytes": pa.array(np.diff(p.ends)),
                "n_removed": pa.array(np.diff(removed)),
                "n_spans": pa.array(np.diff(spans)),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            }
            if with_text:
                columns["kept"] = pa.array(kept, pa.binary())
            out.append(pa.table(columns))
        return pa.concat_tables(out)

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def without_repeats(docs: DataFrame, rule: SuffixDedup = SuffixDedup(), with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of each row of `docs` (doc_id: long, text).

    A byte goes if a string of rule.length bytes covers it that also starts in a document with a
    smaller doc_id.  Null text is empty; a null doc_id counts as larger than any; rows that
    repeat a doc_id are one document for the comparison and each have a row; other columns aren't read.
    `kept` is bytes, as a cut may fall within a character."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = text_bytes(docs)
    blocks, buckets = max(1, -(-total // rule.block_bytes)), bounded_buckets(total, rule.bucket_bytes)
    parts = bounded_buckets(total, 64 << 20, int(spark.conf.get("spark.sql.shuffle.partitions")))
    block = F.pmod(F.xxhash64(F.col("doc_id"), F.octet_length("text")), F.lit(blocks)).cast("long")
    texts = docs.withColumn("block", block).repartition(parts, "block")
    by_block = lambda df: df.groupBy("block")
    phrases = by_block(texts).applyInArrow(_dictionary(rule, buckets), _SENT)
    # the dictionary goes from the disks before the texts are dealt out again, and is merged once for both uses
    first = saved(phrases.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_merge_dictionaries, _ANSWER), "phrases")
    suffixes = by_block(texts).cogroup(by_block(first.where("kind = 1"))).applyInArrow(_suffixes(rule, buckets), _SENT)
    second = suffixes.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_merge_suffixes(rule), _ANSWER)
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return by_block(texts).cogroup(by_block(first.unionByName(second))).applyInArrow(_remove(rule, with_text), ddl)
