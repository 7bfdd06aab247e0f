"""Token files in grammar-compressed form, by Re-Pair.

Texts are encoded in order of doc_id, range partition by range partition.  Each shard of about a
million ids gets its own grammar: in each round the most frequent pairs of neighbours that are
left become nonterminals and are replaced together, never across a document's end.  A shard stores its
rules, their expansion lengths, and where each document begins, so a document or one id of it can
be decoded alone.  Shards are rows of a Parquet table in the shared folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenql.llm import kernel as K
from lumenql.llm.pieces import PieceTable, spaced_pieces
from lumenql.llm.shared import bounded_buckets, saved, ship, text_bytes

#: White space beyond ASCII and controls that libraries class differently, and a special token's sign: such texts aren't cut.
_ODD = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\|"
_MAGIC = b"RPG1"


@dataclass(frozen=True)
class RePair:
    """Ids of a shard, rounds of replacement, new rules a round, least use of a pair, and pieces a worker remembers."""

    shard_ids: int = 1 << 20
    rounds: int = 4
    rules: int = 3000
    least: int = 8
    remembered: int = 1_200_000


_SLOTS = 1 << 18


def _slot(pair: np.ndarray) -> np.ndarray:
    return (pair * np.uint32(0x9E3779B1)) >> np.uint32(14)


def compress(ids: np.ndarray, last: np.ndarray, rule: RePair, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, whether each ends a document, rules): rule r is symbol terminals + r.

    Symbols stay below 2**16, so a pair is a 32-bit key; a round's pairs get one slot of a hash table each."""
    if terminals >= 1 << 16:
        raise ValueError("a vocabulary of less than 65536 ids is needed")
    seq, made = ids.astype(np.uint32), 0
    rules: list[np.ndarray] = []
    for _ in range(rule.rounds):
        room = min(rule.rules, (1 << 16) - terminals - made)
        if len(seq) < 2 or room <= 0:
            break
        pair = (seq[:-1] << np.uint32(16)) | seq[1:]
        open_ = ~last[:-1]
        s = np.sort(pair[open_])
        head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        many = np.diff(np.append(head, len(s)))
        often = np.flatnonzero(many >= rule.least)
        if not len(often):
            break
        often = often[np.argsort(-many[often], kind="stable")[:room]]
        chosen = s[head[often]]
        # of pairs that share a slot the most frequent one stays
        _, once = np.unique(_slot(chosen), return_index=True)
        chosen = chosen[np.sort(once)]
        place = np.full(_SLOTS, -1, np.int32)
        place[_slot(chosen)] = np.arange(len(chosen), dtype=np.int32)
        at = place[_slot(pair)]
        hit = open_ & (at >= 0)
        hit &= chosen[at] == pair
        # of overlapping places every other one, from the left
        where = np.flatnonzero(hit)
        if not len(where):
            break
        begin = np.concatenate([[True], np.diff(where) > 1])
        run = np.maximum.accumulate(np.where(begin, np.arange(len(where)), 0))
        where = where[(np.arange(len(where)) - run) % 2 == 0]
        useful = np.bincount(at[where], minlength=len(chosen)) >= 2
        where = where[useful[at[where]]]
        if not len(where):
            break
        name = np.cumsum(useful) - 1 + terminals + made
        kept = chosen[useful]
        rules.append(np.stack([kept >> np.uint32(16), kept & np.uint32(0xFFFF)], axis=1))
        seq[where] = name[at[where]]
        stay = np.ones(len(seq), bool)
        stay[where + 1] = False
        last = last.copy()
        last[where] = last[where + 1]
        seq, last = seq[stay], last[stay]
        made += len(kept)
    return seq, last, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    """Terminals of the symbols; as many passes as rules are deep."""
    seq = symbols.astype(np.int64)
    while True:
        deep = seq >= terminals
        if not deep.any():
            return seq.astype(np.uint32)
        width = np.where(deep, 2, 1)
        at = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.int64)
        out[at[~deep]] = seq[~deep]
        pair = rules[seq[deep] - terminals]
        out[at[deep]], out[at[deep] + 1] = pair[:, 0], pair[:, 1]
        seq = out


def lengths_of(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Expansion length of each rule; a rule refers to earlier ones only."""
    out = np.ones(len(rules), np.int64)
    for r, (a, b) in enumerate(rules.tolist()):
        out[r] = (out[a - terminals] if a >= terminals else 1) + (out[b - terminals] if b >= terminals else 1)
    return out


class Shard:
    """A shard's bytes: header, rules, expansion lengths, documents' ends in symbols and ids, symbols."""

    def __init__(self, blob: bytes | memoryview):
        if bytes(blob[:4]) != _MAGIC:
            raise ValueError("not a shard of this format")
        self.terminals, n_rules, n_docs, n_symbols, width = np.frombuffer(blob, "<u4", 5, 4).tolist()
        at = 24
        take = lambda n, kind: np.frombuffer(blob, kind, n, at)
        self.rules = take(2 * n_rules, "<u4").reshape(-1, 2)
        at += 8 * n_rules
        self.lengths = take(n_rules, "<u4")
        at += 4 * n_rules
        self.symbol_ends = take(n_docs + 1, "<u4")
        at += 4 * (n_docs + 1)
        self.id_ends = take(n_docs + 1, "<u4")
        at += 4 * (n_docs + 1)
        self.symbols = take(n_symbols, f"<u{width}")

    @staticmethod
    def pack(ids: np.ndarray, ends: np.ndarray, rule: RePair, terminals: int) -> bytes:
        last = np.zeros(len(ids), bool)
        last[ends[1:] - 1] = True
        symbols, last, rules = compress(ids, last, rule, terminals)
        width = 2
        head = np.array([terminals, len(rules), len(ends) - 1, len(symbols), width], "<u4")
        symbol_ends = np.concatenate([[0], np.flatnonzero(last) + 1])
        parts = (head, rules.astype("<u4"), lengths_of(rules, terminals).astype("<u4"), symbol_ends.astype("<u4"), ends.astype("<u4"), symbols.astype(f"<u{width}"))
        return _MAGIC + b"".join(p.tobytes() for p in parts)

    def ids(self) -> np.ndarray:
        """All ids: each rule is expanded once, symbols are looked up."""
        flat = np.concatenate([np.arange(self.terminals, dtype=np.uint32), expand(self.rules.ravel(), self.rules, self.terminals)])
        length = np.concatenate([np.ones(self.terminals, np.int32), self.lengths.astype(np.int32)])
        start = np.cumsum(length, dtype=np.int32) - length
        many = length[self.symbols]
        upto = np.cumsum(many, dtype=np.int32)
        return flat[np.repeat(start[self.symbols] - (upto - many), many) + np.arange(upto[-1] if len(upto) else 0, dtype=np.int32)]

    def document(self, i: int) -> np.ndarray:
        return expand(self.symbols[self.symbol_ends[i] : self.symbol_ends[i + 1]], self.rules, self.terminals)

    def id_at(self, i: int, position: int) -> int:
        """One id of a document: the lengths lead down the one symbol that holds it."""
        own = self.symbols[self.symbol_ends[i] : self.symbol_ends[i + 1]].astype(np.int64)
        length = lambda s: int(self.lengths[s - self.terminals]) if s >= self.terminals else 1
        upto = np.cumsum([length(s) for s in own])
        k = int(np.searchsorted(upto, position, "right"))
        symbol, position = int(own[k]), position - (int(upto[k - 1]) if k else 0)
        while symbol >= self.terminals:
            a, b = self.rules[symbol - self.terminals].tolist()
            symbol, position = (a, position) if position < length(a) else (b, position - length(a))
        return symbol


class _Tokens:
    """Byte-level ids by the tokenizers library; pieces it has encoded are remembered while there is room."""

    def __init__(self, path: str, remembered: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.table = PieceTable(self._encoded, (np.uint16,), remembered)

    def _encoded(self, pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of pieces, each on its own, in few calls."""
        flat, many = [], []
        for at in range(0, len(pieces), 20_000):
            some = pieces[at : at + 20_000]
            e = self.library.encode(some, is_pretokenized=True, add_special_tokens=False)
            flat.append(np.array(e.ids, np.uint16))
            many.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)))
        return [(np.concatenate(flat), np.concatenate(many).astype(np.int32))]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, as 16-bit integers."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        data, ends = K.utf8(plain)
        hashes, starts, stops, first = spaced_pieces(data, ends)
        ids, upto = self.table.gather(0, self.table.slots_of(hashes, data, starts, stops)) if len(hashes) else (np.zeros(0, np.uint16), np.zeros(1, np.int64))
        cut = upto[first].tolist()
        out = [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        for i in np.flatnonzero(odd):
            out[i] = np.array(self.library.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint16)
        return out


@lru_cache(1)
def _tokens(path: str, remembered: int) -> _Tokens:
    """One for a worker process, whose tasks share what it remembers."""
    return _Tokens(path, remembered)


_SHARD = "part int, before long, n_ids long, doc_ids binary, nulls binary, shard binary"


def _write(path: str, rule: RePair, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, before = _tokens(path, rule.remembered), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint16)
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([0, *(len(x) for x in held)])
            blob = Shard.pack(np.concatenate(held), ends, rule, tokens.size)
            row = [[part], [before], [int(ends[-1])], [np.array([d or 0 for d in docs], "<i8").tobytes()], [np.array([d is None for d in docs], np.uint8).tobytes()], [blob]]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["part", "before", "n_ids", "doc_ids", "nulls", "shard"])

        for batch in K.slices(batches, 2 << 20):
            for d, ids in zip(batch.column("doc_id").to_pylist(), tokens.encode(batch.column("text")), strict=True):
                docs.append(d)
                held.append(np.concatenate([ids, end]))
                size += len(held[-1])
                if size >= rule.shard_ids:
                    yield flush()
                    before += size
                    docs, held, size = [], [], 0
        if docs:
            yield flush()

    return run


def write_shards(docs: DataFrame, path: str, rule: RePair = RePair(), end_id: int = 0, where: str | None = None) -> DataFrame:
    """The written table of shards, in order of doc_id, those of one doc_id by a hash of their text, null doc_ids first: (part, before, n_ids, doc_ids, nulls, shard).

    `where` is the folder that keeps it; without one it is an intermediate that goes with the session."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = bounded_buckets(text_bytes(docs), 64 << 20, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    shards = ordered.mapInArrow(_write(path, rule, end_id), _SHARD)
    if where is None:
        return saved(shards, "zrepair")
    shards.write.option("compression", "zstd").parquet(where)
    return docs.sparkSession.read.schema(shards.schema).parquet(where)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, doc_ids, nulls, blob in zip(*(batch.column(c) for c in ("begin", "doc_ids", "nulls", "shard")), strict=True):
            shard = Shard(blob.as_buffer())
            ids, ends = shard.ids().astype("<u4"), shard.id_ends.astype(np.int64)
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            empty = np.frombuffer(nulls.as_buffer(), np.uint8).astype(bool)
            yield pa.record_batch(
                [pa.array(np.frombuffer(doc_ids.as_buffer(), "<i8"), mask=empty), pa.array(ends[:-1] + begin.as_py()), pa.array(np.diff(ends)), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the table of write_shards().

    start counts the ids of all documents before it; n_tokens includes the end id.  Null and
    empty texts have the end id alone; rows that repeat a doc_id each have a row."""
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range partition that was written
    starts = totals.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    placed = shards.join(F.broadcast(starts), "part").select((F.col("base") + F.col("before")).alias("begin"), "doc_ids", "nulls", "shard")
    return placed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
