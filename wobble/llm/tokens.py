"""Token-ID output: documents as Simple-8b coded token ids in files, in ascending doc_id order, and back.

File format: Parquet files with one row per segment, a run of whole documents. Parquet gives commits that survive lost
executors and any file system; the payload columns are binary:

  shard int        number of the range of doc_ids; ascending shards hold ascending doc_ids
  segment int      number within the shard, ascending
  first long       ids of all earlier segments of the shard
  n_ids long       ids in this segment
  doc_ids array<long>, doc_lens array<int>
  words binary     little-endian 64-bit Simple-8b words
  offsets binary   little-endian int32, where each block of BLOCK ids begins in words, and the end
  escapes binary   little-endian 64-bit raw values
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import simple8b
from .base import lean, pieces

FILE_SCHEMA = "shard int, segment int, first long, n_ids long, doc_ids array<long>, doc_lens array<int>, words binary, offsets binary, escapes binary"
DIGEST_SCHEMA = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long"


class Known:
    """Strings and the ids of each, as Arrow and numpy arrays; looked up many at a time."""

    def __init__(self) -> None:
        self.names = pa.array([], pa.string())
        self.ids = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def find(self, names: pa.Array) -> np.ndarray:
        """Where each name is, or -1."""
        return pc.fill_null(pc.index_in(names, self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, names: pa.Array, ids: np.ndarray, lens: np.ndarray) -> None:
        self.names = pa.concat_arrays([self.names, names])
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lens)])

    def remember(self, known: int, again: np.ndarray, most: int) -> Known:
        """All entries, if they are `most` at most; otherwise those after the first `known` that `again` marks, and `most` of them at most."""
        if len(self.names) <= most:
            return self
        keep = known + np.flatnonzero(again)[:most]
        out = Known()
        out.names = self.names.take(pa.array(keep))
        out.ids, lens = self.of(keep)
        out.ends = np.concatenate([[0], np.cumsum(lens)])
        return out

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries, one after the other, and how many each has."""
        return gather(self.ids, self.ends[at], self.ends[at + 1] - self.ends[at])


class WordIds:
    """Token ids of texts by a BPE tokenizer that lower-cases, drops white space and never lets a pre-token span ASCII white space.

    A text's ids are those of its words in order, and a word's those of its pre-tokens. A batch's distinct words are looked up among those known; new ones are
    cut to pre-tokens, and the tokenizer's own model encodes a pre-token that isn't known. Words with a control string, or with characters beyond Latin, go through the
    whole tokenizer, and so does every word if the tokenizer's pattern isn't the one that PRE spells. A Python worker remembers at most `most` words and as many pre-tokens from one batch to the next;
    where there are more, those that the last batch held more than once.
    """

    #: The tokenizer file's pattern of pre-tokens.
    PRE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
    ODD = r"[^\x21-\x7E\x{A1}-\x{AC}\x{AE}-\x{12F}\x{131}-\x{24F}]|<\|"

    def __init__(self, tokenizer_json: str, most: int = 1_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_str(tokenizer_json)
        self.bare = Tokenizer(self.tok.model)
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        vocab = self.tok.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a pre-token
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.most = most
        self.words, self.parts = Known(), Known()
        try:
            pattern = json.loads(tokenizer_json)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        except (KeyError, IndexError, TypeError):
            pattern = ""
        self.odd = self.ODD if pattern.replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}") == self.PRE else "(?s)."

    def model(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens by the model, one after the other, and how many each has."""
        ids, lens = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(new), 256):
            some = new[k : k + 256]
            got = np.array(self.bare.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[got]) + 1
            if len(ends) != len(some):
                raise ValueError("pre-tokens and ends of words differ in number")
            ids.append(got)
            lens.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(lens)

    def learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and how many each has."""
        whole = pc.match_substring_regex(new, self.odd).to_numpy(zero_copy_only=False)
        ids, lens = np.zeros(0, np.uint32), np.zeros(len(new), np.int64)
        plain = pc.utf8_lower(new.filter(pa.array(~whole)))
        if len(plain):
            # pre-tokens, each with a mark after it that no such word holds; words of letters alone are one
            one = pc.utf8_is_alpha(plain)
            cut = pc.replace_substring_regex(plain.filter(pc.invert(one)), f"({self.PRE})", "\\1\x00")
            marked = pc.replace_with_mask(pc.binary_join_element_wise(plain, "", "\x00"), pc.invert(one), cut)
            split = pc.split_pattern(marked, "\x00")
            ends = np.asarray(split.offsets).astype(np.int64)
            coded = split.flatten().dictionary_encode()
            which = coded.indices.to_numpy(zero_copy_only=False)
            real = np.ones(len(which), bool)
            real[ends[1:] - 1] = False  # what follows a word's last mark: nothing
            at = self.parts.find(coded.dictionary)
            unknown = np.zeros(len(at), bool)
            unknown[np.unique(which[real])] = True
            unknown &= at < 0
            fresh = coded.dictionary.filter(pa.array(unknown))
            at[unknown] = len(self.parts.names) + np.arange(len(fresh))
            known = len(self.parts.names)
            self.parts.add(fresh, *self.model(fresh.to_pylist()))
            ids, each = self.parts.of(at[which[real]])
            self.parts = self.parts.remember(known, np.bincount(which[real], minlength=len(at))[unknown] > 1, self.most)
            total = np.concatenate([[0], np.cumsum(each)])
            lens[~whole] = np.diff(total[np.concatenate([[0], np.cumsum(real)])[ends]])
        if whole.any():
            got = self.tok.encode_batch_fast(new.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)
            lens[whole] = [len(e.ids) for e in got]
            both = np.zeros(int(lens.sum()), np.uint32)
            odd = np.repeat(whole, lens)
            both[~odd], both[odd] = ids, np.concatenate([np.array(e.ids, np.uint32) for e in got])
            ids = both
        return ids, lens

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, uint32, and the number of each text's ids. Null counts as empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        ends = np.asarray(split.offsets)
        coded = split.flatten().dictionary_encode()
        if not len(coded):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        which = coded.indices.to_numpy(zero_copy_only=False)
        at = self.words.find(coded.dictionary)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self.words.names) + np.arange(len(new))
            names = coded.dictionary.take(pa.array(new))
            self.words.add(names, *self.learn(names))
        out, lens = self.words.of(at[which])
        if len(new):
            self.words = self.words.remember(len(self.words.names) - len(new), np.bincount(which, minlength=len(at))[new] > 1, self.most)
        total = np.concatenate([[0], np.cumsum(lens)])
        return out, np.diff(total[ends - ends[0]])


def gather(flat: np.ndarray, at: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs flat[at : at + lens], one after the other."""
    before = np.cumsum(lens) - lens
    return flat[np.repeat(at - before, lens) + np.arange(int(lens.sum()))], lens


_coders: dict[str, WordIds] = {}


def coder_for(tokenizer_json: str) -> WordIds:
    """A worker's coder, with what it has learnt in earlier tasks."""
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if key not in _coders:
        _coders.clear()
        _coders[key] = WordIds(tokenizer_json)
    return _coders[key]


def write_token_files(docs: DataFrame, path: str, tokenizer_json: str, end_id: int | None = 2, segment_ids: int = 1 << 20) -> None:
    """Writes doc_id and text of docs as token files under path, in ascending doc_id order (null ids first; rows of equal id by text).

    Null and empty texts give only end_id. Repeated rows are written each. Other columns don't matter. A text's ids stay
    in one segment; segments close at segment_ids. One range shuffle of the texts; each task writes one shard.
    """
    spark = docs.sparkSession
    js = spark.sparkContext.broadcast(tokenizer_json)

    @lean
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(js.value)
        shard = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        doc_ids: list = []
        lens: list[np.ndarray] = []
        n = first = segment = 0
        schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int32())), ("words", pa.binary()), ("offsets", pa.binary()), ("escapes", pa.binary())])

        def close() -> pa.RecordBatch:
            nonlocal held, doc_ids, lens, n, first, segment
            c = simple8b.encode(np.concatenate(held))
            row = [[shard], [segment], [first], [c.n], [doc_ids], [np.concatenate(lens)], [c.words.astype("<u8").tobytes()], [c.offsets.astype("<i4").tobytes()], [c.escapes.astype("<u8").tobytes()]]
            first, segment = first + c.n, segment + 1
            held, doc_ids, lens, n = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

        for batch in pieces(batches, "text", 10 << 20):
            ids, each = coder.encode(batch.column(1))
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(each), end_id)
                each = each + 1
            held.append(ids)
            doc_ids += batch.column(0).to_pylist()
            lens.append(each)
            n += len(ids)
            if n >= segment_ids:
                yield close()
        if doc_ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows.repartitionByRange("doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")).mapInArrow(code, FILE_SCHEMA).write.mode("overwrite").option("compression", "zstd").parquet(path)


def segment_ids(row_words: bytes, row_offsets: bytes, row_escapes: bytes, n: int) -> np.ndarray:
    """The ids of one segment."""
    return simple8b.decode(simple8b.Coded(n, np.frombuffer(row_words, "<u8"), np.frombuffer(row_offsets, "<i4").astype(np.int64), np.frombuffer(row_escapes, "<u8")))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of token files: doc_id, ids array<int>; decoded segment by segment."""

    @lean
    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = segment_ids(r["words"], r["offsets"], r["escapes"], r["n_ids"])
                ends = np.concatenate([[0], np.cumsum(r["doc_lens"])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return spark.read.schema(FILE_SCHEMA).parquet(path).mapInArrow(back, "doc_id long, ids array<int>")


def token_file_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document of token files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    @lean
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                raw = memoryview(segment_ids(r["words"], r["offsets"], r["escapes"], r["n_ids"]).astype("<u4").tobytes())
                lens = np.array(r["doc_lens"], np.int64)
                ends = np.cumsum(lens)
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for n, b in zip(lens.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["shard"]] * len(lens), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(r["first"] + ends - lens), pa.array(lens), pa.array(crc, pa.int64())], ["shard", "doc_id", "start", "n_tokens", "ids_crc32"]
                )

    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # a row for each shard: as many as the writer had tasks
    base = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    rows = files.mapInArrow(digest, DIGEST_SCHEMA)
    return rows.join(base, "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
