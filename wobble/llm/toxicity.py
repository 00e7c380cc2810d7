"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learnt from labels of whole documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, lean, pieces

#: The sample to learn from: so many rows of either label at most, with their whole texts.
SAMPLE_ROWS = 2500
#: What the choice of words and the fit take: standard errors, and the share of the largest weight.
SIGNAL, STRONG = 4.0, 0.05
#: Features are words and their first letters, so many of them; a feature of fewer toxic documents than LEAST is no evidence.
PARTS, LEAST = (3, 4, 5, 6), 5
_EDGES = re.compile(r"^\W+|\W+$")


class Model(NamedTuple):
    """Logit of a sentence: bias plus the weights of its features: words, and beginnings of words with * after them."""

    weights: dict[str, float]
    bias: float


class Parsed(NamedTuple):
    """Words of a batch by code, or their features (with_parts), the sentence of each, and each sentence's document and first word (within the document)."""

    names: list[str]
    code: np.ndarray
    sentence: np.ndarray
    document: np.ndarray
    first: np.ndarray


def parse(texts: pa.Array) -> Parsed:
    """A sentence ends after a word that ends with . ! or ?, at a line's end and at the text's. Null texts have none."""
    lower = pc.utf8_lower(pc.replace_substring(pc.fill_null(texts, ""), "\n", " \n. "))
    split = pc.ascii_split_whitespace(lower)
    coded = split.flatten().dictionary_encode()
    raw = coded.dictionary.to_pylist()
    names = [_EDGES.sub("", w) for w in raw]
    stop = np.array([w[-1:] in (".", "!", "?") for w in raw], bool)
    real = np.array([bool(w) for w in names], bool)
    which = coded.indices.to_numpy(zero_copy_only=False)
    ends = np.asarray(split.offsets)
    ends = (ends - ends[0]).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(ends))
    if not len(which):
        none = np.zeros(0, np.int64)
        return Parsed(names, none, none, none, none)
    after = np.zeros(len(which), bool)
    after[1:] = stop[which[:-1]]
    after[ends[:-1][np.diff(ends) > 0]] = True
    s = np.cumsum(after)
    keep = real[which]
    s, d, c = s[keep], doc[keep], which[keep]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    order = np.arange(len(s)) - np.concatenate([[0], np.cumsum(np.bincount(d, minlength=len(texts)))])[d]
    return Parsed(names, c, np.cumsum(new) - 1, d[new], order[new])


def with_parts(p: Parsed) -> Parsed:
    """Features instead of words: each word, and the beginnings that PARTS names of it if it is longer."""
    ids: dict[str, int] = {}
    flat: list[int] = []
    ends = np.zeros(len(p.names) + 1, np.int64)
    for k, w in enumerate(p.names):
        flat.append(ids.setdefault(w, len(ids)))
        flat += [ids.setdefault(w[:n] + "*", len(ids)) for n in PARTS if len(w) > n]
        ends[k + 1] = len(flat)
    n = np.diff(ends)[p.code]
    at = np.repeat(ends[p.code] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return Parsed(list(ids), np.array(flat, np.int64)[at], np.repeat(p.sentence, n), p.document, p.first)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def holdings(p: Parsed) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct features of a batch, and the distinct pairs of a document and the number of a feature that it holds."""
    ids: dict[str, int] = {}
    code = np.array([ids.setdefault(w, len(ids)) for w in p.names], np.int64)[p.code]
    pairs = np.unique(p.document[p.sentence] * max(1, len(ids)) + code)
    return list(ids), pairs // max(1, len(ids)), pairs % max(1, len(ids))


def telling(both, mine, docs: int, toxic: int, signal: float, sqrt: Callable):
    """Whether LEAST toxic documents or more hold a feature, and their share exceeds that of others by `signal` standard errors. Arrays or columns; both, mine: documents and toxic documents that hold it."""
    share = both / docs
    gap = mine / toxic - (both - mine) / (docs - toxic)
    return (mine >= LEAST) & (gap > signal * sqrt(share * (1 - share) * (1 / toxic + 1 / (docs - toxic))))


class Patterns(NamedTuple):
    """Sentences of a document that hold the same words are one pattern: its document and how often it occurs; and pairs of a pattern and a word in it."""

    document: np.ndarray
    times: np.ndarray
    sent: np.ndarray
    word: np.ndarray


def patterns(p: Parsed, words: dict[str, int], texts: int) -> Patterns:
    """Patterns over `words`, by document; sentences that hold none of them are a pattern as well."""
    code = np.array([words.get(w, -1) for w in p.names], np.int64)[p.code]
    held = code >= 0
    pairs = np.unique(p.sentence[held] * max(1, len(words)) + code[held])  # a word counts once in a sentence
    sent, word = pairs // max(1, len(words)), pairs % max(1, len(words))
    at = np.flatnonzero(np.diff(sent, prepend=-1))
    own = p.document[sent[at]]
    bare = np.bincount(p.document, minlength=texts) - np.bincount(own, minlength=texts)
    found: dict[tuple[int, bytes], int] = {(int(d), b""): int(bare[d]) for d in np.flatnonzero(bare)}
    for d, lo, hi in zip(own.tolist(), at.tolist(), np.append(at, len(sent))[1:].tolist(), strict=True):
        key = d, word[lo:hi].tobytes()
        found[key] = found.get(key, 0) + 1
    keys = sorted(found)
    sizes = np.array([len(k) // 8 for _, k in keys], np.int64)
    return Patterns(np.array([d for d, _ in keys], np.int64), np.array([found[k] for k in keys], np.int64), np.repeat(np.arange(len(keys)), sizes), np.frombuffer(b"".join(k for _, k in keys), np.int64))


def train(texts: list[str], toxic: np.ndarray, rounds: int = 400, rate: float = 0.5, decay: float = 1e-4, signal: float = SIGNAL, strong: float = STRONG) -> Model:
    """Maximum likelihood with a small penalty over all sample documents, by Adagrad.

    A document is clean if all of its sentences are, so its log-probability of that is the sum of theirs. The noisy-or has a leak, fitted along: the
    chance that a document is marked though no sentence is toxic; it keeps wrong labels from being learnt by heart. Features have a weight
    only if they are telling, by `signal` standard errors, and if a first fit under the penalty `decay` gives them `strong` times
    the largest weight or more; the second fit has next to no penalty.
    """
    if not len(texts) or toxic.all() or not toxic.any():
        return Model({}, -6.0)
    p = with_parts(parse(pa.array(texts, pa.string())))
    y = toxic.astype(bool)
    names, document, word = holdings(p)
    kept = telling(np.bincount(word, minlength=len(names)), np.bincount(word, y[document], len(names)), len(texts), int(y.sum()), signal, np.sqrt)
    names = sorted(np.array(names, object)[kept])
    return learn(patterns(p, {w: i for i, w in enumerate(names)}, len(texts)), y, names, rounds, rate, decay, strong)


def learn(found: Patterns, y: np.ndarray, names: list[str], rounds: int = 400, rate: float = 0.5, decay: float = 1e-4, strong: float = STRONG) -> Model:
    """The two fits of train(). y: of each document; names: of the patterns' words."""
    w, b = fit(found, y, len(names), rounds, rate, decay)
    if w.max(initial=0.0) > 0:
        kept = w[found.word] >= strong * w.max()
        w, b = fit(found._replace(sent=found.sent[kept], word=found.word[kept]), y, len(names), rounds, rate, decay / 100)
    return Model({names[i]: float(w[i]) for i in np.flatnonzero(w)}, float(b))


def fit(found: Patterns, y: np.ndarray, words: int, rounds: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Weights and bias. y: of each document."""
    document, times, sent, word = found
    n = len(document)
    docs = len(y)
    w, b, gw, gb, leak = np.zeros(words), -4.0, np.full(words, 1e-8), 1e-8, 0.2 * y.mean()
    for _ in range(rounds):
        z = b + np.bincount(sent, w[word], n)
        clean = np.exp(-np.bincount(document, times * softplus(z), docs))
        marked = leak + (1 - leak) * (1 - clean)
        pull = np.where(y, -(1 - leak) * clean / marked, 1.0) / docs
        dz = times * pull[document] / (1 + np.exp(-np.clip(z, -500, 500)))
        dw, db = np.bincount(word, dz[sent], words) + decay * w, dz.sum()
        gw, gb = gw + dw**2, gb + db**2
        w, b = w - rate * dw / np.sqrt(gw), b - rate * db / np.sqrt(gb)
        leak = np.clip(np.where(y, leak / marked, 0).sum() / max(1e-9, np.where(y, leak / marked, 1.0).sum()), 1e-4, 0.5)
    return w, float(b)


def train_sample(docs: DataFrame, labels: DataFrame, seed: int = 17) -> Model:
    """A model from at most SAMPLE_ROWS rows of either label, in order of a hash of doc_id. Their texts count whole, however long.

    labels: doc_id, toxic; null in either leaves a row out. Labelled ids without a document, and null texts, teach nothing. Texts stay with the
    executors, which count the words' documents and then reduce each document to its patterns of telling words; the driver gets those.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    l = labels.select(F.col("doc_id").cast("long").alias("_id"), (F.col("toxic") == 1).alias("_y")).where("_id is not null and _y is not null")
    order = F.xxhash64("_id", F.lit(seed))
    ids = [l.where(F.col("_y") == y).orderBy(order, "_id").limit(SAMPLE_ROWS) for y in (True, False)]
    s = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids[0].union(ids[1])), F.col("doc_id") == F.col("_id"))
    s = scratch.keep(s.select("_id", "_y", F.xxhash64("text").alias("_th"), F.monotonically_increasing_id().alias("_row"), "text"))
    if s.count() > 2 * SAMPLE_ROWS:  # repeated ids
        s = s.join(F.broadcast(s.orderBy(order, "_id", "_th", "_y", "_row").select("_row").limit(2 * SAMPLE_ROWS)), "_row")
    total = s.agg(F.count("*").alias("docs"), F.count_if("_y").alias("toxic")).first()
    if total.toxic in (0, total.docs):
        scratch.only()
        return Model({}, -6.0)

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            names, document, word = holdings(with_parts(parse(b.column(1))))
            y = b.column(0).to_numpy(zero_copy_only=False)
            both, mine = np.bincount(word, minlength=len(names)), np.bincount(word[y[document]], minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(both), pa.array(mine)], ["word", "both", "mine"])

    held = s.select("_y", "text").mapInArrow(count, "word string, both long, mine long").groupBy("word").agg(F.sum("both").alias("both"), F.sum("mine").alias("mine"))
    names = sorted(r.word for r in held.where(telling(F.col("both"), F.col("mine"), total.docs, total.toxic, SIGNAL, F.sqrt)).select("word").collect())
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(names)})

    @lean
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            f = patterns(with_parts(parse(b.column(3))), shared.value, len(b))
            ends = np.searchsorted(f.document, np.arange(len(b) + 1))
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v)) for at, v in ((ends, f.times), (ends, np.bincount(f.sent, minlength=len(f.times))), (np.searchsorted(f.sent, ends), f.word))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *lists], ["_id", "_th", "_y", "times", "sizes", "words"])

    t = s.select("_id", "_th", "_y", "text").mapInArrow(reduce, "_id long, _th long, _y boolean, times array<long>, sizes array<long>, words array<long>").toArrow()
    scratch.only()
    t = t.sort_by([(c, "ascending") for c in ("_id", "_th", "_y")]).combine_chunks()
    times, sizes, words = (t.column(c).combine_chunks() for c in ("times", "sizes", "words"))
    flat = lambda a: a.flatten().to_numpy(zero_copy_only=False)
    found = Patterns(np.repeat(np.arange(len(t)), pc.list_value_length(times).to_numpy(zero_copy_only=False)), flat(times), np.repeat(np.arange(len(flat(sizes))), flat(sizes)), flat(words))
    return learn(found, t.column("_y").to_numpy(), names)


def score(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id, score (0 to 1), offending (array<struct<sentence,first_word,score>>, sentences of score limit or more, numbered from 0).

    Whole texts are scored; those without words score 0. Repeated rows are scored each. No shuffle.
    """
    names = sorted(model.weights)
    tables = [(0, [w for w in names if w[-1] != "*"])] + [(k, [w for w in names if w[-1] == "*" and len(w) == k + 1]) for k in PARTS]
    tables = [(k, [w[: k or None] for w in found], [names.index(w) for w in found]) for k, found in tables if found]
    shared = docs.sparkSession.sparkContext.broadcast((tables, np.array([model.weights[w] for w in names]), model.bias))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, weights, bias = shared.value
        sets = [(k, pa.array(found, pa.string()), np.array([*number, -1])) for k, found, number in tables]
        for b in pieces(batches, "text"):
            p = parse(b.column(1))
            words = pa.array(p.names, pa.string())
            n = len(p.document)
            z = np.full(n, bias)
            if sets and len(words):
                # which features each distinct word has: one a table, or none
                own = np.stack([number[pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(words, 0, k) if k else words, found), -1).to_numpy(zero_copy_only=False)] for k, found, number in sets], 1)
                own[np.stack([pc.utf8_length(words).to_numpy(zero_copy_only=False) <= k for k, _, _ in sets], 1)] = -1
                heavy = np.flatnonzero((own >= 0).any(1)[p.code])
                mine = own[p.code[heavy]]
                pairs = np.unique((p.sentence[heavy][:, None] * len(weights) + mine)[mine >= 0])  # a feature counts once in a sentence
                z += np.bincount(pairs // len(weights), weights[pairs % len(weights)], n)
            total = -np.expm1(-np.bincount(p.document, softplus(z), len(b)))
            each = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            bad = np.flatnonzero(each >= limit)
            start = np.searchsorted(p.document, np.arange(len(b)))
            items = pa.StructArray.from_arrays([pa.array((bad - start[p.document[bad]]).astype(np.int32)), pa.array(p.first[bad].astype(np.int32)), pa.array(each[bad])], ["sentence", "first_word", "score"])
            offsets = np.searchsorted(p.document[bad], np.arange(len(b) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total), pa.ListArray.from_arrays(offsets, items)], ["doc_id", "score", "offending"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, offending array<struct<sentence:int,first_word:int,score:double>>")
