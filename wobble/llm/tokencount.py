"""Token counts by a unigram model, with forward scores shared along a trie of pre-tokens."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from .base import pieces

SPACE = "▁"


def zipf_scores(names: list[str]) -> dict[str, float]:
    """Log-probabilities of pieces in order of rank, by Zipf's law: a vocabulary made by merges has ranks, not probabilities."""
    total = math.log(sum(1 / (r + 2.7) for r in range(len(names))))
    return {name: -math.log(r + 2.7) - total for r, name in enumerate(names)}


def load_pieces(path: str) -> dict[str, float]:
    """Scores of a sentencepiece model's normal pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return zipf_scores([sp.id_to_piece(i) for i in sorted(ids, key=lambda i: (-sp.get_score(i), i))])


class TrieCounter:
    """Numbers of tokens in the best segmentation of pre-tokens: the highest sum of scores, of equal ones the fewest tokens.

    A character that no piece covers costs one token for each of its UTF-8 bytes, at byte_score each.
    """

    def __init__(self, scores: dict[str, float], byte_score: float = -20.0, most: int = 300_000):
        self.byte_score, self.most = byte_score, most
        self.scores = scores
        lengths: dict[str, set[int]] = {}
        for piece in scores:
            lengths.setdefault(piece[-2:] if len(piece) > 1 else piece, set()).add(len(piece))
        self.lengths = {k: sorted(v) for k, v in lengths.items()}
        self.known: dict[str, int] = {}

    def learn(self, words: list[str]) -> None:
        """words, sorted: equal prefixes stand side by side, so walking them is a depth-first walk of their trie. best and
        count are the forward scores along the current branch; a shared prefix keeps its own, and a word's end stores its count."""
        scores, lengths, known, byte_score = self.scores, self.lengths, self.known, self.byte_score
        best, count, last = [0.0], [0], ""
        for w in words:
            shared, n = 0, min(len(w), len(last))
            while shared < n and w[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for d in range(shared + 1, len(w) + 1):
                c = w[d - 1]
                own = scores.get(c)
                if own is None:
                    size = len(c.encode("utf-8", "surrogatepass"))
                    top, tokens = best[-1] + size * byte_score, count[-1] + size
                else:
                    top, tokens = best[-1] + own, count[-1] + 1
                if d > 1:
                    for k in lengths.get(w[d - 2 : d], ()):
                        if k > d:
                            break
                        s = scores.get(w[d - k : d])
                        if s is not None:
                            s += best[d - k]
                            if s > top or s == top and count[d - k] + 1 < tokens:
                                top, tokens = s, count[d - k] + 1
                best.append(top)
                count.append(tokens)
            known[w] = count[-1]
            last = w

    def counts(self, distinct: list[str]) -> np.ndarray:
        if len(self.known) + len(distinct) > self.most:
            self.known.clear()
        self.learn(sorted(w for w in distinct if w not in self.known))
        return np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))


_counters: dict[str, TrieCounter] = {}


def counter_for(key: str, scores: dict[str, float], byte_score: float) -> TrieCounter:
    """A worker's counter for the scores that key stands for, with what it has learnt in earlier tasks; one at a time."""
    if key not in _counters:
        _counters.clear()
        _counters[key] = TrieCounter(scores, byte_score)
    return _counters[key]


def token_counts(docs: DataFrame, scores: dict[str, float], byte_score: float = -20.0) -> DataFrame:
    """docs with n_pre_tokens and n_tokens (long), without text.

    Pre-tokens are the words between ASCII white space, each after a space mark. Null, empty and blank texts have none.
    Repeated rows are counted each. Columns of docs named like those added are replaced. A worker remembers the counts of up to 300,000 pre-tokens it has
    met, in earlier tasks as well; what is new in a batch goes through the trie together. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scores)
    key = hashlib.sha256(repr((byte_score, sorted(scores.items()))).encode()).hexdigest()
    own = [c for c in docs.columns if c.lower() not in ("n_pre_tokens", "n_tokens", "text")]
    df = docs.select(*own, "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(key, shared.value, byte_score)
        for b in pieces(batches, "text"):
            split = pc.ascii_split_whitespace(pc.fill_null(b.column(b.schema.get_field_index("text")), ""))
            coded = split.flatten().dictionary_encode()
            names = coded.dictionary.to_pylist()
            real = np.array([bool(w) for w in names], np.int64)
            each = np.where(real > 0, counter.counts([SPACE + w for w in names]), 0) if names else real
            which = coded.indices.to_numpy(zero_copy_only=False)
            ends = np.asarray(split.offsets)
            ends = ends - ends[0]
            sums = [np.diff(np.concatenate([[0], np.cumsum(v[which])])[ends]) if len(which) else np.zeros(len(b), np.int64) for v in (real, each)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in own), *(pa.array(s.astype(np.int64)) for s in sums)], [*own, "n_pre_tokens", "n_tokens"])

    return df.mapInArrow(count, StructType([*(df.schema[c] for c in own), StructField("n_pre_tokens", LongType()), StructField("n_tokens", LongType())]))
