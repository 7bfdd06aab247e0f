"""A small corpus with hard cases, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, size long, block long, word string, _spans string"


def corpus() -> list[tuple]:
    """(doc_id, text, lang, source): exact, near and partial copies, repetition, nulls, empty and long texts."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = prose(70), prose(220)
    near = base.split(" ")
    near[40], near[150] = "changed", "words"
    texts = [base, base, " ".join(near), prose(30) + " " + passage + "\n" + prose(25), passage + " tail " + prose(12), prose(50) + "\n" + passage.upper() + " " + prose(9)]
    texts += ["", None, "   \n\t ", "one", "two words", "a b c d e", "a b c d e", "The Same Line\nThe Same Line\n" * 30, "x " * 600, prose(4000), "é" * 120, "日本語 テキスト " + prose(60), "a b c \x1c d <|endoftext|> \x85 e"]
    texts += ["#*$%&|<> " * 40 + prose(60), "Released under the MIT License.\n" + prose(80), prose(60) + "\nLicensed under CC BY-NC 4.0.", base[:400] + prose(30)]
    texts += [prose(rng.randint(55, 140)) for _ in range(40)] + [base + " more"] * 3
    rows = [(3 * i + 1, t, ["en", "fr", None][i % 3], ["s0", "s0", "s1", None, "s2"][i % 5]) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    """The rows with columns whose names clash with those of operators."""
    return spark.createDataFrame([(*r, len(r[1] or ""), -1, -2, -3, "w", "s") for r in rows], SCHEMA).repartition(3)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def links(rows, size=5) -> dict:
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {}
    for d, t, *_ in rows:
        w = words((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def without_repeats(rows, length=50) -> dict:
    """doc_id -> (bytes, removed, spans, digest)."""
    first: dict[bytes, int] = {}
    data = sorted((d, (t or "").encode()) for d, t, *_ in rows)
    for d, b in data:
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], d)
    out = {}
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def features(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)
