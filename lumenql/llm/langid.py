"""Language of web pages by Bayesian fusion of evidence.

The text model is trained here on all labelled documents: hashed byte trigrams per language, merged
from partial counts.  A page's evidence is the likelihood of its visible text, the language its markup
declares, the suffix of its address, and a prior of its host.  Host priors are grouped sums of what text and
markup say of all pages, smoothed towards the host's domain and that towards the corpus, without the page itself.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenql.llm import kernel as K
from lumenql.llm.shared import saved, ship, summed

CELLS = 1 << 14
_UNIT = 1_000_000

# Country suffixes with one main language.
SUFFIXES = {"fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh"}


# Three-letter codes of languages that have one of two letters.
SHORTER = {"eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl", "pol": "pl", "rus": "ru", "jpn": "ja", "zho": "zh", "chi": "zh"}


@dataclass(frozen=True)
class Fusion:
    """How far declarations and suffixes are trusted, pages by which a host leans on its domain and a domain on the corpus,
    and trigrams at most that a text's likelihood counts as (neighbours aren't independent)."""

    declared: float = 0.9
    suffix: float = 0.8
    smoothing: float = 5.0
    effective: float = 40.0


def _trigrams(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each byte trigram within a text, its text); A-Z in lower case, spaces alike."""
    d = K.LOWER[np.where(K.SEPARATOR[data], np.uint8(0x20), data)].astype(np.uint32)
    if len(d) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cell = ((d[:-2] * np.uint32(0x9E3779B1)) ^ (d[1:-1] * np.uint32(0x85EBCA77)) ^ (d[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(18)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    inside = row[:-2] == row[2:]
    return cell[inside].astype(np.int64), row[:-2][inside]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(list(total), pa.string()), pa.array([v.astype(np.int64).tobytes() for v in total.values()], pa.binary())], names=["key", "counts"])
        total.clear()
        return out

    for batch in K.slices(batches):
        langs = batch.column("lang").to_pylist()
        cell, row = _trigrams(*K.utf8(batch.column("text")))
        names = sorted(set(langs))
        place = {x: i for i, x in enumerate(names)}
        of = np.array([place[x] for x in langs])[row]
        order, begin = K.grouped(of)
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            name = names[of[order[a]]]
            total[name] = total.get(name, 0) + np.bincount(cell[order[a:b]], minlength=CELLS)
            if len(total) >= 256:
                yield flush()
    yield flush()


#: Languages whose models the driver and each worker hold, CELLS numbers each.
MOST = 4096


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities of cells) from all documents with a language; CELLS numbers for each of them.

    More than MOST different values of lang are no languages: an error, none is left out."""
    ship(docs.sparkSession)
    some = docs.where("lang is not null and text is not null").select("lang", "text")
    # one row of CELLS counts for each language and task before the shuffle
    rows = saved(summed(saved(some.mapInArrow(_count, "key string, counts binary"), "ztrigrams"), "string"), "ztrained")
    if rows.count() > MOST:
        raise ValueError(f"more than {MOST} values of lang")
    rows = rows.orderBy("key").collect()
    if not rows:
        return ["und"], np.zeros((1, CELLS))
    counts = np.stack([np.frombuffer(r.counts, np.int64) for r in rows]).astype(float) + 0.5
    return [r.key for r in rows], np.log(counts / counts.sum(axis=1, keepdims=True))


_OPENS = re.compile(r"<(?:(script|style|noscript|nav)\b|!--)", re.I)
_CLOSES = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "nav")}
_TAG = re.compile(r"<[^>]*>")
_HTML = re.compile(r"<html\b[^>]*", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?\s*([A-Za-z]{2,8})", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", re.I)


def visible(page: str) -> str:
    """Text outside of tags, comments, scripts, styles and navigation.  What isn't closed is text.

    Each search goes on where the last ended, and what has no end is looked for once, so time is linear in the page."""
    parts, at, unclosed = [], 0, set()
    for m in _OPENS.finditer(page):
        name = (m[1] or "--").lower()
        if m.start() < at or name in unclosed:
            continue
        close = _CLOSES[name].search(page, m.end()) if m[1] else None
        end = close.end() if close else page.find("-->", m.end()) + 3 if not m[1] else 0
        if end < m.end():
            unclosed.add(name)
            continue
        parts.append(page[at : m.start()])
        at = end
    rest = " ".join([*parts, page[at:]])
    tags = rest.rfind(">") + 1  # no tag ends behind it
    return markup.unescape(_TAG.sub(" ", rest[:tags]) + rest[tags:])


def declared_in(page: str) -> str | None:
    """The language of the <html> tag: its primary code, of two letters if it has such a one."""
    tag = _HTML.search(page)
    said = _LANG.search(tag[0]) if tag else None
    return SHORTER.get(said[1].lower(), said[1].lower()) if said else None


def host_of(url: str | None) -> tuple[str | None, str | None, str | None]:
    """(host, its last two labels, its suffix), lower-cased."""
    found = _HOST.match(url or "")
    if not found:
        return None, None, None
    host = found[1].lower().rstrip(".")
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _lean(languages: list[str], named: list[str | None], trust: float) -> np.ndarray:
    """Log likelihood of a declaration: trust for the language it names, the rest for the others alike; none if it names no known one."""
    n = len(languages)
    out = np.zeros((len(named), n))
    for i, name in enumerate(named):
        if name in languages and n > 1:
            out[i] = np.log((1 - trust) / (n - 1))
            out[i, languages.index(name)] = np.log(trust)
    return out


def _evidence(languages: list[str], shared, rule: Fusion):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.T
        for batch in K.slices(batches, column="html"):
            pages = [p or "" for p in batch.column("html").to_pylist()]
            texts = pa.array([visible(p) for p in pages], pa.string())
            cell, row = _trigrams(*K.utf8(texts))
            n = np.bincount(row, minlength=len(pages)).astype(float)
            sums = np.stack([np.bincount(row, weights=model[cell, k], minlength=len(pages)) for k in range(len(languages))], axis=1)
            text = sums * (np.minimum(n, rule.effective) / np.maximum(n, 1))[:, None]
            said = [declared_in(p) for p in pages]
            hosts = [host_of(u) for u in batch.column("url").to_pylist()]
            own = text + _lean(languages, said, rule.declared)
            whole = own + _lean(languages, [SUFFIXES.get(h[2]) for h in hosts], rule.suffix)
            soft = np.round(_softmax(own) * _UNIT).astype(np.int64)
            yield pa.record_batch(
                [batch.column("page_id"), pa.array([h[0] for h in hosts], pa.string()), pa.array([h[1] for h in hosts], pa.string()), pa.array(said, pa.string()), pa.array(n.astype(np.int64))]
                + [pa.array(list(v), pa.list_(t)) for v, t in ((whole, pa.float64()), (soft, pa.int64()))],
                names=["page_id", "host", "domain", "declared", "n_trigrams", "evidence", "soft"],
            )

    return run


def identify(pages: DataFrame, docs: DataFrame, rule: Fusion = Fusion()) -> DataFrame:
    """(page_id, host, declared, lang, posterior, n_trigrams) of each row of `pages` (page_id, url, html).

    A null or empty page has no text evidence, an address without host only the corpus prior; without labelled
    documents the one language is 'und'.  Ties go to the language that sorts first.  Rows keep their page_id, null or
    repeated; other columns aren't read."""
    languages, model = train(docs)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # languages x CELLS numbers at most
    ddl = "page_id long, host string, domain string, declared string, n_trigrams long, evidence array<double>, soft array<long>"
    seen = saved(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_evidence(languages, shared, rule), ddl), "zpages")
    k = range(len(languages))
    sums = [F.sum(F.get("soft", F.lit(i))).alias(f"c{i}") for i in k]
    host = seen.where("host is not null").groupBy("host", "domain").agg(*sums)
    domain = host.groupBy("domain").agg(*(F.sum(f"c{i}").alias(f"d{i}") for i in k))
    corpus = seen.agg(*(F.coalesce(F.sum(F.get("soft", F.lit(i))), F.lit(0)).alias(f"g{i}") for i in k))
    near = host.join(domain, "domain").drop("domain")
    joined = seen.join(near, "host", "left").crossJoin(F.broadcast(corpus))  # one row

    def without(prefix: str, i: int):
        return F.greatest(F.coalesce(F.col(f"{prefix}{i}"), F.lit(0)) - F.when(F.col("host").isNotNull() | F.lit(prefix == "g"), F.get("soft", F.lit(i))).otherwise(0), F.lit(0)) / F.lit(float(_UNIT))

    def smooth(prefix: str, parent: list) -> list:
        own = [without(prefix, i) for i in k]
        total = sum(own[1:], own[0])
        return [(own[i] + rule.smoothing * parent[i]) / (total + rule.smoothing) for i in k]

    flat = [F.lit(1.0 / len(languages)) for _ in k]
    staged = joined
    for prefix, names in (("g", "pg"), ("d", "pd"), ("c", "pc")):
        staged = staged.withColumns({f"{names}{i}": c for i, c in enumerate(smooth(prefix, flat))})
        flat = [F.col(f"{names}{i}") for i in k]
    scores = [F.get("evidence", F.lit(i)) + F.log(F.col(f"pc{i}")) for i in k]
    staged = staged.withColumn("_s", F.array(*scores)).withColumn("_best", F.array_max("_s"))
    total = F.aggregate(F.transform("_s", lambda x: F.exp(x - F.col("_best"))), F.lit(0.0), lambda a, x: a + x)
    names = F.array(*(F.lit(x) for x in languages))
    order = F.transform("_s", lambda x, i: F.when(x == F.col("_best"), F.get(names, i)))
    return staged.select("page_id", "host", "declared", F.array_min(F.filter(order, lambda x: x.isNotNull())).alias("lang"), F.round(1.0 / total, 6).alias("posterior"), "n_trigrams")
