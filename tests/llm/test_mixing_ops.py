"""Packing, importance resampling and source divergence against brute force, on small tables with odd rows."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wobble.llm import divergence, packing
from wobble.llm import queries as Q
from wobble.llm.divergence import source_divergence
from wobble.llm.importance import importance_resample, words_of
from wobble.llm.packing import packed_digest, plan_sequences, read_packed, write_packed
from wobble.llm.tokens import WordIds

RNG = np.random.default_rng(11)
VOCAB = ["".join(RNG.choice(list("abcdefgh"), RNG.integers(1, 6))) for _ in range(60)]
ROWS = [(i, " ".join(RNG.choice(VOCAB, RNG.integers(1, 90))), ["en", "fr"][i % 2], "abc"[i % 3]) for i in range(90)] + [
    (90, None, "en", "a"), (91, "", None, None), (92, "\n \t", "fr", None), (93, "One TWO, one-two 3x É É é", "en", "a"), (93, "One TWO, one-two 3x É É é", "en", "a"), (None, " ".join(VOCAB[:40]), None, "b"),
    (94, " ".join(RNG.choice(VOCAB, 6000)), "fr", "b"), (95, "a b " * 2000, "zz", "only"), (96, "\u0000x\u0000y z", "en", "b\u0000"), (97, "日本語 🙂 ab", "ja", "d"), (98, "solo", "zz", "other"),
]
BENCH = [(str(i), " ".join(RNG.choice(VOCAB[:20], 15))) for i in range(10)] + [("n", None), ("e", "")]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark):
    clash = {"rank": F.lit("mine"), "bucket": F.lit(1), "n": F.lit(2), "part": F.lit(3), "length": F.lit("x"), "shard": F.lit(-1)}
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumns(clash).repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id string, text string")


# --- packing


def brute_sums(lengths, room):
    """The largest sum of some of the lengths that is at most room."""
    found = {0}
    for x in lengths:
        found |= {s + x for s in found if s + x <= room}
    return max(found)


def test_fullest_is_the_fullest():
    for _ in range(60):
        lengths = RNG.integers(1, 40, RNG.integers(1, 12)).tolist()
        mix = packing.fullest(dict(Counter(lengths)), 50)
        assert max(lengths) in mix and all(n <= lengths.count(k) for k, n in mix.items())
        rest = list(lengths)
        rest.remove(max(lengths))
        assert sum(k * n for k, n in mix.items()) == max(lengths) + brute_sums(rest, 50 - max(lengths))


def test_plan_is_bin_by_bin_packing():
    """The same number of sequences as combinations removed one at a time, and every place taken once."""
    for _ in range(20):
        counts = {int(k): int(n) for k, n in zip(RNG.integers(1, 65, 12), RNG.integers(1, 30, 12), strict=True)}
        plan = plan_sequences(counts, 64)
        left, bins = dict(counts), 0
        while left:
            for k, n in packing.fullest(left, 64).items():
                left[k] -= n
            left = {k: n for k, n in left.items() if n}
            bins += 1
        length = np.repeat(np.array(sorted(counts)), [counts[k] for k in sorted(counts)])
        rank = np.concatenate([np.arange(counts[k]) for k in sorted(counts)])
        sequence, offset = packing.place(plan, length, rank)
        assert sequence.max() + 1 == bins
        taken = defaultdict(list)
        for s, o, n in zip(sequence.tolist(), offset.tolist(), length.tolist(), strict=True):
            taken[s].append((o, n))
        for runs in taken.values():
            runs.sort()
            assert [o for o, _ in runs] == np.cumsum([0, *[n for _, n in runs]])[:-1].tolist() and runs[-1][0] + runs[-1][1] <= 64


def test_plan_stays_small():
    counts = dict.fromkeys(range(1, 2049), 10**9)
    plan = plan_sequences(counts, 2048)
    total = sum(k * n for k, n in counts.items())
    last = plan.sequence[plan.length == 1].max()
    assert len(plan.length) < 40_000 and last < 1.001 * total / 2048 + 1 and plan_sequences({}, 2048).length.size == 0


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packed_files(spark, docs, tmp_path, capacity):
    path = f"file://{tmp_path}/p"
    write_packed(docs, path, Q.tokenizer_json(), capacity=capacity)
    tok = WordIds(Q.tokenizer_json()).tok
    want = Counter()
    total = 0
    for i, t, *_ in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[i, k // capacity, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    rows = packed_digest(spark, path).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for runs in places.values():
        runs.sort()
        assert runs[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(runs, runs[1:], strict=False)) and sum(n for _, n in runs) <= capacity
    assert len(places) <= -(-total // capacity) + 1  # what no packing can beat, and one
    back = read_packed(spark, path).collect()
    assert sum(len(r.ids) for r in back) == total and all(len(r.ids) == sum(r.lens) and r.ids[-1] >= 0 for r in back)
    write_packed(docs.where("1 = 0"), f"{path}e", Q.tokenizer_json(), capacity=capacity)
    assert packed_digest(spark, f"{path}e").count() == 0


def test_open_sequences_go_on_in_the_next_batch():
    ids = [np.arange(n, dtype="<u2").tobytes() for n in (2, 1, 3, 1)]
    t = pa.table({"sequence_id": [5, 5, 5, 9], "offset": [0, 2, 3, 0], "doc_id": [1, None, 3, 4], "piece": pa.array([0] * 4, pa.int32()), "start": [0] * 4, "length": pa.array([2, 1, 3, 1], pa.int32()), "ids": pa.array(ids, pa.binary())})
    for size in (1, 2, 3, 4):
        out = pa.Table.from_batches(list(packing._sequences(iter(t.to_batches(max_chunksize=size))))).to_pylist()
        assert [(r["sequence_id"], r["doc_ids"], r["lens"], r["ids"], r["width"]) for r in out] == [(5, [1, None, 3], [2, 1, 3], b"".join(ids[:3]), 2), (9, [4], [1], ids[3], 2)]


# --- importance resampling


def features(t, orders):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 500 for k in range(1, orders + 1) for i in range(len(w) - k + 1)]


def brute_importance(orders, percent, least):
    rows = [(i, *features(t, orders)) for i, t, *_ in ROWS]
    s = Counter(b for *_, f in rows for b in f)
    t = Counter(b for _, x in BENCH for b in features(x, orders)[1])
    big, small = sum(s.values()), sum(t.values())
    out = []
    for i, n, f in rows:
        weight = sum(math.floor(1000 * math.log(((t[b] + 1.0) * (big + 500)) / ((s[b] + 1.0) * (small + 500)))) for b in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    first = sorted((k for k, r in enumerate(out) if r[1] >= least), key=lambda k: (-out[k][4], out[k][0] is None, out[k][0] or 0))
    ranks = {at: k + 1 for k, at in enumerate(first[: percent * len(first) // 100])}
    return Counter((*r, ranks.get(k)) for k, r in enumerate(out))


@pytest.mark.parametrize("orders", [1, 3])
def test_importance(docs, bench, orders):
    got = Counter(tuple(r) for r in importance_resample(docs, bench, orders=orders, buckets=500, percent=40, least_words=5).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect())
    assert got == brute_importance(orders, 40, 5)


def test_importance_of_nothing(docs, bench):
    assert importance_resample(docs.where("1 = 0"), bench).count() == 0
    alone = importance_resample(docs, bench.where("1 = 0"), buckets=500).agg(F.count("*"), F.count("score")).first()
    assert tuple(alone) == (len(ROWS), len(ROWS))


def test_words_of_runs(spark):
    rows = [(n, sum(max(0, n - k + 1) for k in range(1, 5))) for n in range(12)]
    assert all(r.n == r.w for r in spark.createDataFrame(rows, "n long, f long").select("n", words_of("f", 4).alias("w")).collect())


# --- source divergence


def brute_divergence(rows, least, top):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for _, t, lang, source in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        df = Counter(x for *_, w in own for x in set(w))
        kept = {x for x, n in df.items() if n >= least}
        count = {s: Counter(x for _, b, w in own if b == s for x in w if x in kept) for s in {r[1] for r in own}}
        total = sum(count.values(), Counter())
        share = lambda c: {x: 1 + 10**9 * (c[x] + 2) // (sum(c.values()) + 2 * len(kept)) for x in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = sorted((-sum(f(p[s][x], p[o][x]) for x in kept), o.encode()) for o in p if o != s)
            terms = sorted((-f(p[s][x], q[x]), x.encode()) for x in kept if count[s][x] and p[s][x] > q[x])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)}
    return out


def test_divergence(docs, monkeypatch):
    monkeypatch.setattr(divergence, "MERGE_ROWS", 50)
    monkeypatch.setattr(divergence, "SHARD_TERMS", 20)
    for least, top, shards in ((3, 4, 5), (1, 10, 1), (10**6, 10, 3)):
        got = {tuple(r) for r in source_divergence(docs, least, top, shards).select("lang", "source", "part", "item", "value", "rank").collect()}
        assert got == brute_divergence(ROWS, least, top)
    assert source_divergence(docs.where("1 = 0")).count() == 0


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = "alpha É-beta " * 400
    batch = pa.RecordBatch.from_pydict({"lang": ["l"], "source": ["s"], "text": [text]})
    whole = divergence.count_batch(batch).to_pylist()
    monkeypatch.setattr(divergence, "TEXT_BYTES", 37)
    parts = divergence.count_batch(batch).to_pylist()
    order = lambda r: r["term"]
    assert sorted(parts, key=order) == sorted(whole, key=order) and {r["docs"] for r in parts} == {1} and "".join(divergence.chunks(text, 37)) == text
