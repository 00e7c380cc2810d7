"""The ten operators and the pipeline against brute force, on small tables with odd rows."""

import hashlib
import pickle
import re
import struct
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import corpus_pipeline
from wobble.llm import queries as Q
from wobble.llm import decontaminate, near, paragraphs, simple8b, substrings, suffixes, tokencount
from wobble.llm.base import GAP, Scratch
from wobble.llm.chat import escape, format_reply_trees, unescape
from wobble.llm.decontaminate import contamination
from wobble.llm.mixing import mix_sources, source_targets
from wobble.llm.neardup import near_duplicates
from wobble.llm.paragraphs import duplicate_paragraphs
from wobble.llm.quality import quality
from wobble.llm.setsketch import estimate_reaches, joint_estimate, registers, shingle_sets, word_hashes
from wobble.llm.substrings import remove_repeats
from wobble.llm.tokencount import TrieCounter, token_counts
from wobble.llm.tokens import WordIds, read_token_files, token_file_digest, write_token_files
from wobble.llm.toxicity import Model, score, train, train_sample

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.default_rng(5)
VOCAB = ["".join(RNG.choice(list("abcdefghijklmno"), RNG.integers(2, 8))) for _ in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB, n))


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@lru_cache(1)
def odd_rows():
    base = prose(120)
    edited = base.split()
    edited[60] = "other"
    long = prose(4000)
    return [
        (0, base, "en", "a"), (1, base, "en", "b"), (2, " ".join(edited), "en", None), (3, None, None, None), (4, "", "en", "a"), (5, "\n \t", "fr", "a"), (6, "one two", "fr", "a"),
        (7, "One TWO", "fr", "c"), (8, long, "de", "c"), (9, long + " tail", "de", "c"), (9, long + " tail", "de", "c"), (None, prose(80), "es", "d"), (10, prose(200) + "\n" + base, "en", "a"),
        (11, "a" * 3000, "en", "e"), (12, prose(90) + " ### <turn x> & ％ ñandú É 日本 🙂 <|endoftext|>", "zz", "e"), (13, "x\n" * 60, "en", "e"), (14, "ab ab ab ab ab ab", "en", "e"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    # clashing and extra columns
    return spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string").withColumns({"n_words": F.lit("mine"), "extra": F.lit(1), "size": F.lit("s"), "component": F.lit(2)}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("1 = 0")


def test_simple8b_round_trip():
    for n in (0, 1, 511, 512, 513, 3000):
        for top in (1, 50_000, 1 << 40, (1 << 64) - 1):
            v = RNG.integers(0, top, n, dtype=np.uint64, endpoint=True)
            c = simple8b.encode(v)
            assert (simple8b.decode(c) == v).all()
            for k in range(len(c.offsets) - 1):
                assert (simple8b.decode_block(c, k) == v[512 * k : 512 * k + 512]).all()


def test_word_ids_are_the_tokenizers():
    coder = WordIds(Q.tokenizer_json())
    texts = ["Σίσυφος ΑΣ <|endoftext|>a a<|endoftext|> <|nope İstanbul  x y é \x1c\x1d a\x1cb it's 12ab!!?c 日本語 🙂", "", None, " \n ", "don't DON'T 3.14 ß ſ", prose(50)]
    ids, n = coder.encode(pa.array(texts))
    want = [coder.tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]


def test_token_files(spark, docs, none, tmp_path):
    write_token_files(docs, f"file://{tmp_path}/t", Q.tokenizer_json(), segment_ids=100)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_file_digest(spark, f"file://{tmp_path}/t").collect())
    tok = WordIds(Q.tokenizer_json()).tok
    at, want = 0, []
    for i, t, *_ in sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((at, i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert got == want
    back = {r.doc_id: r.ids for r in read_token_files(spark, f"file://{tmp_path}/t").collect()}
    assert back[6] == tok.encode("one two", add_special_tokens=False).ids + [2]
    write_token_files(none, f"file://{tmp_path}/e", Q.tokenizer_json())
    assert token_file_digest(spark, f"file://{tmp_path}/e").count() == 0


def brute_tokens(word, scores, byte_score):
    best = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        c = [(best[s][0] + scores[word[s:e]], best[s][1] - 1) for s in range(e) if word[s:e] in scores]
        if word[e - 1] not in scores:
            n = len(word[e - 1].encode())
            c.append((best[e - 1][0] + n * byte_score, best[e - 1][1] - n))
        best.append(max(c))
    return -best[-1][1]


def test_token_counts(docs, none):
    scores = {p: float(-i) / 7 for i, p in enumerate(["▁", "a", "b", "ab", "▁ab", "abc", "c", "d", "e", "bc", "▁a", "f", "fg", "g", "ñ", "cde"])}
    words = sorted({"▁" + w for r in odd_rows() for w in WORDS.findall(r[1] or "") if len(w) < 50})
    c = TrieCounter(scores, -3.0)
    assert c.counts(words).tolist() == [brute_tokens(w, scores, -3.0) for w in words]
    got = Counter((r.doc_id, r.n_pre_tokens, r.n_tokens) for r in token_counts(docs, scores, -3.0).collect())
    want = Counter((i, len(w := WORDS.findall(t or "")), sum(brute_tokens("▁" + x, scores, -3.0) for x in w)) for i, t, *_ in odd_rows())
    assert got == want
    assert token_counts(none, scores).count() == 0


def test_a_worker_keeps_its_counter(docs):
    """The next task of a worker finds what the last one learnt; other scores never do."""
    scores = {"▁": -1.0, "a": -2.0, "b": -2.5, "ab": -3.0}
    first = pickle.loads(cloudpickle.dumps(tokencount.counter_for))
    c = first("one", scores, -3.0)
    c.counts(["▁ab"])
    assert tokencount.counter_for("one", scores, -3.0) is c and "▁ab" in c.known
    assert tokencount.counter_for("two", scores, -4.0).known == {}
    few = TrieCounter(scores, most=3)
    for words in (["▁a", "▁b"], ["▁ab", "▁aa"], ["▁a", "▁ba", "▁bb", "▁abab"]):  # more than it may keep
        assert few.counts(words).tolist() == [brute_tokens(w, scores, -20.0) for w in words]


def shingles(t, k):
    w = WORDS.findall(lower(t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components_of(sets, percent):
    """sets: {key: set}; the least key reachable."""
    keys = sorted(sets)
    comp = {k: k for k in keys}
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                x, y = sorted((comp[a], comp[b]))
                comp = {k: x if v == y else v for k, v in comp.items()}
    return comp


@pytest.mark.parametrize(("k", "percent", "small"), [(3, 85, False), (5, 80, False), (3, 85, True)])
def test_near_duplicates(spark, docs, none, k, percent, small, monkeypatch):
    if small:  # large buckets, and families of several blocks
        monkeypatch.setattr(near, "BUCKET_ROWS", 3)
        monkeypatch.setattr(near, "BLOCK_ROWS", 4)
    rows = [(i if i is not None else -1, t) for i, t, *_ in odd_rows()]
    base = prose(150).split()
    for n in range(60):  # a chain of copies, each an edit away from the one before
        base = list(base)
        base[int(RNG.integers(150))] = f"new{n}"
        rows.append((100 + n, " ".join(base)))
    sets = {i: shingles(t, k) for i, t in rows}
    want = components_of(sets, percent)
    d = docs.select("doc_id", "text").union(spark.createDataFrame(rows[len(odd_rows()) :], "doc_id long, text string")).withColumn("cls", F.lit(1))
    for r in near_duplicates(d, k, percent).collect():
        i = -1 if r.doc_id is None else r.doc_id
        assert (r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) == (len(sets[i]), want[i], want[i] == i)
    assert near_duplicates(none, k, percent).count() == 0


def test_joint_estimate_is_near():
    a = RNG.integers(0, 1 << 63, 3000).astype(np.uint64)
    for share in (0.3, 0.8, 0.95):
        b = a.copy()
        new = RNG.random(3000) > 2 * share / (1 + share)
        b[new] = RNG.integers(0, 1 << 63, new.sum()).astype(np.uint64)
        r = registers(np.concatenate([np.sort(a), np.sort(b)]), np.array([3000, 6000]), 1024)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(joint_estimate(r[:1], r[1:], np.array([3000.0]), np.array([3000.0]))[0] - true) < 0.08
        for level in (0.2, 0.5, 0.78, 0.9):
            sizes = np.array([3000.0])
            assert estimate_reaches(r[:1], r[1:], sizes, sizes, level)[0] == (joint_estimate(r[:1], r[1:], sizes, sizes)[0] >= level)
        # registers of a union are the maxima
        u = registers(np.unique(np.concatenate([a, b])), np.array([len(np.union1d(a, b))]), 1024)
        assert (u[0] == np.maximum(r[0], r[1])).all()


def test_word_hashes_split_like_the_contract():
    texts = ["a b\tc\x0bd\x0ce\rf\ng\x1ch i\xa0j ", None, "", " "]
    h, ends = word_hashes(pa.array(texts))
    assert np.diff(np.concatenate([[0], ends])).tolist() == [len(WORDS.findall(t or "")) for t in texts]
    assert GAP == r"[\x20\x09-\x0D]+"
    s, e = shingle_sets(h, ends, 3)
    assert len(s) == len(WORDS.findall(texts[0])) - 2 and e.tolist() == [len(s)] * 4


def brute_paragraphs(rows, passage):
    """Rows (doc_id, start, n_words, cluster_doc_id, cluster_start, cluster_rows, passage_start, passage_words) of (doc_id, text), by comparing all paragraphs and all strings of words."""
    found, own = [], []
    for row, (_, t) in enumerate(rows):
        w = WORDS.findall(lower(t or ""))
        h = paragraphs.pair_hashes(*word_hashes(pa.array([t], pa.string()))).tolist()
        top = 2**64 - 1
        begin = [i for i in range(len(w)) if i == 0 or h[i] < min([*h[max(0, i - 8) : i], top]) and h[i] <= min([*h[i + 1 : i + 9], top])] + [len(w)]
        own.append(w)
        for x, y in zip(begin[:-1], begin[1:], strict=True):
            parts = -(-(y - x) // 32)
            cuts = [x + (y - x) * k // parts for k in range(parts + 1)]
            found += [(row, p, q - p) for p, q in zip(cuts[:-1], cuts[1:], strict=True) if q - p >= 5]
    sets = {(row, p): shingles(" ".join(own[row][p : p + n]), 5) for row, p, n in found}
    comp = components_of(sets, 80)
    groups = {}
    for k, c in comp.items():
        groups.setdefault(c, []).append(k)
    groups = {c: g for c, g in groups.items() if len({row for row, _ in g}) > 1}
    held = {(row, p): n for row, p, n in found if comp[row, p] in groups}
    # windows of 32 words beside paragraphs, one side of a component at a time
    windows = {}
    for (row, p), n in held.items():
        for side, x in (("left", p - 32), ("right", p + n)):
            if 0 <= x <= len(own[row]) - 32:
                seen = Counter()
                bag = set()
                for w in own[row][x : x + 32]:
                    seen[w] += 1
                    bag.add((w, seen[w]))
                windows.setdefault((comp[row, p], side), {})[row, p, x] = bag
    beside = {}
    for (_, side), bags in windows.items():
        of_window = components_of(bags, 80)
        for c in set(of_window.values()):
            members = [k for k in bags if of_window[k] == c]
            if len({row for row, _, _ in members}) > 1:
                head = min((rows[row][0], x) for row, _, x in members)
                for row, p, x in members:
                    beside[row, p, side] = (*head, len(members), (rows[row][0], x) == head)
    items = {}
    for (row, p), n in held.items():
        head = min((rows[r][0], q) for r, q in groups[comp[row, p]])
        items[row, p] = (n, *head, len(groups[comp[row, p]]), (rows[row][0], p) == head)
    for row in {row for row, _ in held}:
        at = sorted(p for r, p in held if r == row)
        done = 0
        for p, after in zip(at, [*at[1:], None], strict=True):
            left = min(32, p - done) if (row, p, "left") in beside else 0
            if left:
                items[row, p - left] = (left, *beside[row, p, "left"])
            done = p + held[row, p]
            right = min(32, 32 if after is None else after - done) if (row, p, "right") in beside else 0
            if right:
                items[row, done] = (right, *beside[row, p, "right"])
            done += right
    runs = {}
    for row, p in sorted(items):
        prior = next((k for k, (x, n) in runs.items() if k[0] == row and x + n == p), None)
        if prior:
            runs[prior] = (runs[prior][0], runs[prior][1] + items[row, p][0])
        else:
            runs[row, p] = (p, items[row, p][0])
    run_of = {(row, p): (row, x) for row, p in items for (r, x), (_, n) in runs.items() if r == row and x <= p < x + n}
    marked = {comp[k] for k in held if runs[run_of[k]][1] < passage}
    where, strings = {}, {}
    for row, p in held:
        if comp[row, p] in marked:
            for before in range(0, max(0, passage - held[row, p]) + 1, 3):
                if p >= before and p - before + passage - 2 <= len(own[row]):
                    w = tuple(own[row][p - before : p - before + passage - 2])
                    where.setdefault(w, set()).add(row)
                    strings.setdefault(run_of[row, p], set()).add(w)
    out = []
    for (row, first), (x, n) in runs.items():
        if n < passage and not any(len(where[w]) > 1 for w in strings.get((row, first), ())):
            continue
        for p in (p for r, p in items if r == row and x <= p < x + n):
            size, *head, members, kept = items[row, p]
            out.append((rows[row][0], p, size, *head, members, x, n, kept))
    return Counter(out)


@pytest.mark.parametrize(("small", "passage"), [(False, 50), (False, 1), (True, 50), (True, 1)])
def test_paragraphs(spark, docs, none, small, passage, monkeypatch):
    if small:  # keys of many paragraphs, and blocks of several rows
        monkeypatch.setattr(near, "BUCKET_ROWS", 2)
        monkeypatch.setattr(near, "BLOCK_ROWS", 2)
    rng = np.random.default_rng(21)
    p = [prose(60, rng) for _ in range(4)]
    inside = prose(57, rng)
    wrapped = inside.split()
    edited = p[0].split()
    edited[20] = "changed"
    rows = [(200, f"{p[0]}\n{p[1]}\nshort"), (201, f"x\n{' '.join(edited)}"), (202, p[2]), (203, f"{p[1]}\n{p[1]}"), (204, "short"), (205, p[3].upper()), (206, p[3]), (207, f"{prose(45, rng)}\n{prose(45, rng)}"), (208, prose(50, rng) + " " + prose(40, rng))]
    rows += [(300, f"{prose(40, rng)} {inside} {prose(43, rng)}"), (301, "\n".join(" ".join(wrapped[k : k + 8]) for k in range(0, 57, 8))), (302, " ".join(["again and"] * 70)), (303, prose(3, rng) + " and" + " again and" * 60), (304, p[2][: len(p[2]) // 2])]
    rows += [(400 + k, f"{prose(30, rng)} {' '.join(wrapped[:30])} {prose(30, rng)}") for k in range(12)]
    all_rows = [(-1 if i is None else i, t) for i, t, *_ in odd_rows()] + rows
    d = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    none_is = lambda x: -1 if x is None else x
    got = duplicate_paragraphs(d, passage=passage).collect()
    assert Counter((none_is(r.doc_id), r.start, r.n_words, none_is(r.cluster_doc_id), r.cluster_start, r.cluster_rows, r.passage_start, r.passage_words, r.kept) for r in got) == brute_paragraphs(all_rows, passage)
    ids = {r.doc_id for r in got}
    assert {200, 201, 203, 205, 206, 300, 301, 302, 303, 9} <= ids and not ids & {204, 207, 208, 3, 4, 5}
    assert all(r.doc_id == r.cluster_doc_id for r in got if r.kept)
    assert duplicate_paragraphs(none).count() == 0


def test_near_passages_are_found(spark):
    """Passages of 200 words in other surroundings with a word in 25 exchanged, and documents that share nothing."""
    rng = np.random.default_rng(77)
    vocab = np.array([f"w{k}" for k in range(5000)])
    rows = []
    for k in range(60):
        p = rng.choice(vocab, 200)
        q = p.copy()
        q[24::25] = [f"other{k}" for k in range(8)]
        for i, (x, before, after) in enumerate(((p, 80, 80), (q, 60, 90))):
            rows.append((2 * k + i, " ".join([*rng.choice(vocab, before), *x, *rng.choice(vocab, after)])))
    rows += [(1000 + k, " ".join(rng.choice(vocab, 300))) for k in range(100)]
    got = duplicate_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ids = {r.doc_id for r in got}
    assert len(ids) >= 0.9 * 120 and max(ids) < 1000
    assert sum(r.n_words for r in got) >= 0.6 * 120 * 200
    where = {k: (80 if k % 2 == 0 else 60) for k in range(120)}
    assert all(r.start + r.n_words > where[r.doc_id] and r.start < where[r.doc_id] + 200 for r in got)


def test_passages_inside_longer_lines_are_found(spark):
    rng = np.random.default_rng(22)
    words = [f"w{k}" for k in range(4000)]
    line = lambda n: " ".join(rng.choice(words, n))
    shared = [line(57) for _ in range(100)]
    rows = [(k, f"{line(int(rng.integers(20, 60)))} {shared[k % 100]} {line(int(rng.integers(20, 60)))}") for k in range(200)] + [(k, line(140)) for k in range(200, 300)]
    found = {r.doc_id for r in duplicate_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").distinct().collect()}
    assert not {i for i in found if i >= 200} and len(found) >= 0.95 * 200


def test_quality(docs, none):
    for r in quality(docs.where("doc_id is not null")).collect():
        w = WORDS.findall(r.text or "")
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many = Counter(tri)
        rep = len({i + d for i, t in enumerate(tri) if many[t] > 1 for d in range(3)})
        lines = [x for x in (r.text or "").split("\n") if WORDS.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), rep)
        assert r.base_failed == (len(w) < 50 or 100 * rep > 50 * len(w)) and r.extra == 1
    assert quality(none).count() == 0


def test_quality_rejects_what_diverges(spark):
    rows = [(i, " ".join(RNG.choice(["the", "of", "and", *VOCAB[:40]], 200)), "en") for i in range(40)]
    rows += [(100, " ".join(w + "%%%" for w in RNG.choice(VOCAB, 200)), "en"), (101, None, "en")]
    kept = {r.doc_id for r in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("kept").collect()}
    assert kept == set(range(40))


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_BYTES, 0])
def test_quality_knows_every_language(spark, most, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
    rng = np.random.default_rng(13)
    rows = [(i, prose(400, rng), f"l{i:02}") for i in range(70)]
    cyrillic = ["".join(rng.choice(list("абвгдежзиклмн"), 5)) for _ in range(100)]
    rows += [(i, " ".join(rng.choice(cyrillic, 110)), "ru") for i in range(100, 103)] + [(200, " ".join(rng.choice(cyrillic, 110)), None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    got = {r.doc_id: r.kept for r in quality(d).collect()}
    assert got == {i: i != 200 for i, *_ in rows}


def test_toxicity(spark, docs, none):
    bad = ["grub", "toad"]
    texts, toxic = [], []
    for i in range(300):
        s = [prose(8) for _ in range(6)]
        y = i % 3 == 0
        if y:
            s[i % 6] += " " + bad[i % 2]
        texts.append(". ".join(s))
        toxic.append(y)
    m = train(texts[:240], np.array(toxic[:240]))
    assert set(bad) <= set(m.weights) <= {"grub", "gru*", "toad", "toa*"}
    held = spark.createDataFrame([(i, t) for i, t in enumerate(texts[240:])], "doc_id long, text string")
    got = {r.doc_id: r for r in score(held, m).collect()}
    assert np.mean([(got[i].score >= 0.7) == y for i, y in enumerate(toxic[240:])]) >= 0.95
    assert {x.sentence for i, y in enumerate(toxic[240:]) if y for x in got[i].offending} <= set(range(6))
    assert all(got[i].offending[0].sentence == (240 + i) % 6 for i, y in enumerate(toxic[240:]) if y)
    for r in score(docs, m).collect():
        assert 0 <= r.score <= 1
        assert r.score == 0 or r.doc_id not in (3, 4, 5)
    assert score(none, m).count() == 0
    assert train([], np.zeros(0, bool)) == Model({}, -6.0)


def test_toxicity_is_a_noisy_or_of_sentences(spark, docs):
    rows = [(1, "Grubby toad! A clean one. grubs, (TOAD)\ntoad toad"), (2, "nothing here"), (3, "grub"), (4, None), (5, "..."), (None, "toads\n\ntoads"), (1, "toad"), (6, "été grübelt étés")]
    m = Model({"toad": 2.5, "gru*": 1.0, "grub*": 0.5, "grubby": -0.75, "toad*": 3.0, "été*": 2.0}, -3.0)
    got = score(docs.select("doc_id", "text").where("1 = 0").union(spark.createDataFrame(rows, "doc_id long, text string")), m, limit=0.3).collect()

    def brute(text):
        clean, bad, k = 1.0, [], 0
        for s in re.split(r"(?<=[.!?])[ \n]+|\n", (text or "").lower()):
            held = {re.sub(r"^\W+|\W+$", "", w) for w in s.split()} - {""}
            if held:
                features = held | {w[:n] + "*" for w in held for n in (3, 4, 5, 6) if len(w) > n}
                p = 1 / (1 + np.exp(-(m.bias + sum(m.weights.get(f, 0.0) for f in features))))
                clean *= 1 - p
                bad += [(k, round(p, 9))] * int(p >= 0.3)
                k += 1
        return round(1 - clean, 9), bad

    key = lambda x: (x[0] or 0, x[1], x[2])
    assert sorted(((r.doc_id, round(r.score, 9), [(o.sentence, round(o.score, 9)) for o in r.offending]) for r in got), key=key) == sorted(((i, *brute(t)) for i, t in rows), key=key)


def test_toxicity_query_learns_from_two_thirds_only(spark, tmp_path):
    rng = np.random.default_rng(14)
    rows, labels = [], []
    for i in range(600):
        out = zlib.crc32(str(i).encode()) % 3 == 1
        toxic = i % 4 == 0
        # a word that only held-out rows tell by, and one that all do
        rows.append((i, ". ".join(prose(6, rng) for _ in range(3)) + (" grub" if toxic else "") + (" secret" if out and not toxic else ""), f"l{int(toxic)}", f"s{int(toxic)}"))
        labels.append((i, int(toxic), 0))
    spark.createDataFrame([*rows, (9000, None, None, None), (None, "grub", None, None)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (9000, None, 0), (None, 1, 0)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in Q.op6_noisy_or_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == 602
    for i, *_ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == (got[i].score >= 0.7) == (i % 4 == 0)
    assert got[9000].score == 0 and got[None].held_out is False


@pytest.mark.parametrize("huge_first", [False, True])
def test_toxicity_learns_beside_and_from_huge_texts(spark, huge_first):
    rng = np.random.default_rng(11)
    texts = [". ".join(f"{prose(8, rng)}{' grub' if i % 3 == 0 and k == 2 else ''}" for k in range(6)) for i in range(300)]
    toxic = np.arange(300) % 3 == 0
    first = spark.range(300).orderBy(F.xxhash64("id", F.lit(17))).first().id
    if huge_first:
        texts[first] = f"{prose(1000, rng)}. " * 3000 + texts[first]
        assert len(texts[first]) > 12 << 20
    d = spark.createDataFrame([*enumerate(texts), (500, None)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([*((i, int(y)) for i, y in enumerate(toxic)), (500, 1), (501, 1), (None, 1)], "doc_id long, toxic int")
    got, want = train_sample(d, labels), train(texts, toxic)
    assert set(got.weights) == {"grub", "gru*"} and got.weights == pytest.approx(want.weights) and got.bias == pytest.approx(want.bias)
    assert train_sample(d, labels.where("toxic = 1")) == Model({}, -6.0)


def test_suffix_order():
    for _ in range(10):
        strings = [bytes(RNG.integers(97, 97 + int(RNG.integers(1, 3)), int(RNG.integers(1, 200))).astype(np.uint8)) for _ in range(5)]
        ends = np.cumsum([len(x) for x in strings])
        text = np.frombuffer(b"".join(strings), np.uint8)
        order = suffixes.Block(text, ends).sort(np.arange(len(text)), np.zeros(len(text), int))
        limit = np.repeat(ends, [len(x) for x in strings])
        rows = [text.tobytes()[i : limit[i]] for i in order]
        assert rows == sorted(rows)
    v = suffixes.PERIOD
    cover = suffixes.difference_cover(v)
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))


@pytest.mark.parametrize(("hot", "clash"), [(substrings.HOT, False), (((0, 3),), True), (((0, 30),), False), (((0, 301),), False)])
def test_repeated_bytes(spark, docs, none, hot, clash, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SCAN", 1000)  # texts are scanned in many slices
    if clash:  # a hash by which different contexts of an anchor look alike
        monkeypatch.setattr(substrings, "context_hash", lambda view, seed: 7)
    shared = prose(150)
    rows = [(i, t) for i, t, *_ in odd_rows()]
    rows += [(300, prose(60) + shared + prose(50)), (301, prose(10) + shared[:700]), (302, shared[50:520] + "é" + shared[200:650]), (303, "é" * 500), (304, prose(30) + "é" * 260)]
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + 400] for t in data for i in range(len(t) - 399))
    want = Counter()
    for (i, _), t in zip(rows, data, strict=True):
        hit = np.zeros(len(t), bool)
        for p in range(len(t) - 399):
            if seen[t[p : p + 400]] > 1:
                hit[p : p + 400] = True
        kept = np.frombuffer(t, np.uint8)[~hit].tobytes()
        want[i, len(t), int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(np.int8)])) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    d = docs.select("doc_id", "text", F.lit(1).alias("dk")).union(spark.createDataFrame([(*r, 1) for r in rows[len(odd_rows()) :]], "doc_id long, text string, dk int"))
    assert Counter(tuple(r)[:5] for r in remove_repeats(d).collect()) == want
    assert remove_repeats(none).count() == 0


def test_a_passage_in_many_surroundings(spark):
    """2000 texts share 350 bytes, and 30 of them 50 more on either side."""
    rng = np.random.default_rng(41)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    some = lambda n: rng.choice(letters, n).tobytes().decode()
    core, left, right = some(350), some(50), some(50)
    rows = [(i, some(200) + (left + core + right if i < 30 else core) + some(200)) for i in range(2000)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    # bytes next to the 450 agree by chance in some rows, so windows are counted
    seen = Counter(hash(t[p : p + 400]) for _, t in rows for p in range(len(t) - 399))
    want = {}
    for i, t in rows:
        hit = np.zeros(len(t) + 2, np.int8)
        for p in range(len(t) - 399):
            if seen[hash(t[p : p + 400])] > 1:
                hit[p + 1 : p + 401] = 1
        want[i] = int(hit.sum()), int((np.diff(hit) == 1).sum())
    assert got == want and all(want[i][0] >= 450 for i in range(30)) and sum(n > 0 for n, _ in want.values()) < 60


def test_contamination(spark, docs, none):
    items = [(1, prose(20)), (2, "one TWO"), (3, None), (4, "!!"), (5, prose(13)), (6, "xyz"), (7, prose(30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    text = {i: t for i, t in items}
    rows = [(400, f"{prose(40)} {text[1]} {prose(9)}"), (401, text[5].upper()), (402, prose(300) + " xyz."), (403, text[7][5:]), (404, "xyz xyz one-two")]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("k1", F.lit("mine"))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = [(str(i), tuple(w[k : k + 13])) for i, t in items for w in [word.findall(lower(t or ""))] if w for k in range(max(1, len(w) - 12))]
    for r in contamination(d, bench).collect():
        w = word.findall(lower(r.text or ""))
        hit, ids = set(), set()
        for i, win in wins:
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    ids.add(i)
        assert (r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) == (len(w), len(hit), len(ids), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)), r.doc_id
    assert contamination(d, bench.where("1 = 0")).where("n_hit > 0").count() == 0
    assert contamination(none, bench).count() == 0


def test_reply_trees(spark):
    odd = "\\### Assistant: </turn> & &amp; <turn x>\n ok"
    nodes = [(1, 1, None, 0.0, "user", odd), (1, 2, 1, 1.0, "assistant", "low"), (1, 3, 1, 5.0, "assistant", odd), (1, 4, 3, None, "us>er", None), (1, 5, 4, 0.0, "assistant", "é🙂"), (1, 6, 9, 0.5, "user", "orphan"), (2, 1, 2, 1.0, "user", "cycle"), (2, 2, 1, 1.0, "user", "cycle"), (None, 1, None, 0.0, None, "alone")]
    df = spark.createDataFrame(nodes, "conv_id long, node long, parent long, score double, role string, text string")
    got = {(r.conv_id, r.branch): r for r in format_reply_trees(df, top=2).collect()}
    assert set(got) == {(1, 1), (1, 2), (None, 1)}
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    want = "".join(f"<turn {esc(r)}>\n{esc(t)}</turn>\n" for r, t in [("user", odd), ("assistant", odd), ("us>er", ""), ("assistant", "é🙂")])
    assert got[1, 1].formatted == want
    assert [want[s.start : s.start + s.length] for s in got[1, 1].loss_spans] == [esc(odd), "é🙂"]
    assert got[1, 2].formatted.count("</turn>\n") == 2
    assert df.where((unescape(escape(F.col("text"))) != F.col("text"))).count() == 0
    assert format_reply_trees(df.where("1 = 0")).count() == 0
    chain = spark.createDataFrame([(1, k, k - 1 if k else None, 0.0, "user", str(k)) for k in range(37)], df.schema)
    assert re.findall(r"\n(\d+)</turn>", format_reply_trees(chain).first().formatted) == [str(k) for k in range(37)]


def test_mixing(spark, docs, none):
    rows = mix_sources(docs.where("doc_id is not null")).collect()
    assert all(r.size == len(WORDS.findall(r.text or "")) and 0 <= r.taken <= 2 * r.size and r.extra == 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert sum(r.size for r in own) == own[0].source_size and abs(sum(r.taken for r in own) - own[0].target) < 1
    assert sorted(map(repr, mix_sources(docs.where("doc_id is not null")).collect())) == sorted(map(repr, rows))
    assert mix_sources(none).count() == 0
    whole = mix_sources(docs, whole_documents=True).where("size > 0 and taken % size <> 0").count()
    assert whole == 0


def test_targets_fill_up(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 3), ("d", 500), ("e", 70), ("f", 0)]
    df = spark.createDataFrame([(False, s, n) for s, n in sizes] + [(True, "", 40)], "no_source boolean, source string, source_size long")
    got = {(r.no_source, r.source): r.target for r in source_targets(df).collect()}
    w = dict(zip([(False, s) for s, _ in sizes] + [(True, "")], [5, 2, 1, 5, 2, 1, 5], strict=True))
    size = {(False, s): n for s, n in sizes} | {(True, ""): 40}
    target, capped = {k: 0.0 for k in w}, set()
    while True:
        free = [k for k in w if k not in capped]
        rest = 1.5 * sum(size.values()) - sum(2 * size[k] for k in capped)
        target = {k: 2.0 * size[k] if k in capped else rest * w[k] / sum(w[f] for f in free) for k in w}
        over = {k for k in free if target[k] > 2 * size[k]}
        if not over:
            break
        capped |= over
    assert got == pytest.approx(target)


def test_pipeline(spark, docs, tmp_path):
    item = prose(30)
    rows = [(i, " ".join(RNG.choice(["the", "of", "and", *VOCAB], 120)), "en", "ab"[i % 2]) for i in range(30)]
    rows += [(40, rows[0][1], "en", "a"), (41, rows[1][1] + " more", "en", "a"), (42, "short", "en", "a"), (43, f"{prose(60)} {item}", "en", "b"), (44, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, left = d, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert at.columns == d.columns
            at = spark.createDataFrame(at.collect(), d.schema)
        left.append(sorted(r.doc_id for r in at.select("doc_id").collect()))
    assert left[0] == [*range(30), 40, 41, 43] and left[1] == [*range(30), 43] and left[2] == [*range(30)]
    assert max(Counter(left[3]).values()) <= 2 and left[4] == left[3]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == left[4]
    empty = d.where("1 = 0")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_sets_that_link_agree_in_parts():
    rng = np.random.default_rng(31)
    for n in (1, 3, 17, 28, 90):
        sets = []
        for _ in range(40):
            base = set(rng.integers(0, 2**63, n).tolist())
            sets.append(base)
            for _ in range(4):  # copies with some elements exchanged, dropped and added
                gone = int(rng.integers(0, n // 6 + 2))
                sets.append(set(list(base)[gone:]) | set(rng.integers(0, 2**63, int(rng.integers(0, n // 6 + 2))).tolist()) or base)
        begin = np.cumsum([0, *map(len, sets)])
        keys, which, _ = near.agreeing_parts(np.concatenate([np.sort(np.array(list(x), np.uint64)) for x in sets]), begin, 80)
        own = [set() for _ in sets]
        for k, w in zip(keys.tolist(), which.tolist(), strict=True):
            own[w].add(k)
        assert max(map(len, own)) <= 92
        links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        assert len(links) >= 20 and all(own[a] & own[b] for a, b in links)
        alien = [bool(own[a] & own[b]) for a in range(0, len(sets), 5) for b in range(0, a, 5)]
        assert n not in (17, 28) or np.mean(alien) < 0.05


def test_small_buckets_are_searched_whole():
    """Spanning forests of buckets searched together join what all pairs join."""
    rng = np.random.default_rng(41)
    sets, sizes = [], [1, 2, 3, 9, 64, 5, 30]
    for size in sizes:
        base = [set(rng.integers(0, 2**63, 12).tolist()) for _ in range(3)]
        for k in range(size):
            x = list(base[k % 3])
            sets.append(set(x[int(rng.integers(0, 3)) :]) | set(rng.integers(0, 2**63, int(rng.integers(0, 2))).tolist()))
    begin, at = np.cumsum([0, *map(len, sets)]), np.cumsum([0, *sizes])
    linked = lambda shared, nx, ny: 100 * shared >= 80 * (nx + ny - shared)
    a, b = near.links_among(np.concatenate([np.sort(np.array(list(x), np.uint64)) for x in sets]), begin, at[:-1], at[1:], linked)
    assert all(linked(len(sets[x] & sets[y]), len(sets[x]), len(sets[y])) for x, y in zip(a.tolist(), b.tolist(), strict=True))
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    assert (bucket[a] == bucket[b]).all()

    def trees(edges):
        label = list(range(len(sets)))
        for x, y in edges:
            label = [label[x] if v == label[y] else v for v in label]
        return len(set(label))

    every = [(x, y) for x in range(len(sets)) for y in range(x) if bucket[x] == bucket[y] and linked(len(sets[x] & sets[y]), len(sets[x]), len(sets[y]))]
    assert len(every) > len(a) == len(sets) - trees(every) == len(sets) - trees(zip(a.tolist(), b.tolist(), strict=True))


def test_buckets_of_the_same_sets_are_searched_once(spark):
    """A pair that shares several keys gives one link, not one for each."""
    rng = np.random.default_rng(43)
    rows = []
    for k in range(40):
        base = np.sort(rng.integers(0, 2**63, 28, dtype=np.uint64))
        for i in range(2):
            s = base[np.arange(28) != 27 - i]  # the six least are the same in both
            rows.append((2 * k + i, 27, s[:6].astype(np.int64).tolist(), s.tobytes()))
    t = spark.createDataFrame(rows, "node long, n int, keys array<long>, set binary")
    links = near.set_links(t.select("node", "n", "keys"), lambda nodes: nodes.join(t.select("node", "set"), "node"), 80, Scratch(spark, "links"))
    assert sorted(tuple(sorted((r.a, r.b))) for r in links.collect()) == [(2 * k, 2 * k + 1) for k in range(40)]
