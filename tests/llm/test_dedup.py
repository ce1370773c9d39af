import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from arrayloom.llm import kernels as K
from arrayloom.llm import session, simhash, spans, substring, suffixes

SCHEMA = "doc_id bigint, text string, start int, rows string"  # further columns whose names the operators use themselves


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in texts], SCHEMA)


def corpus():
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdeé"), int(rng.integers(1, 6))))
    passage = [word() for _ in range(70)]
    docs = []
    for i in range(40):
        body = [word() for _ in range(int(rng.integers(0, 90)))]
        if i % 3 == 0:
            lo = int(rng.integers(0, 15))
            at = int(rng.integers(0, len(body) + 1))
            body = body[:at] + passage[lo : lo + 52 + i % 4] + body[at:]
        docs.append((i * 3, " ".join(body)))
    docs += [(500, docs[0][1]), (501, docs[3][1] + "\n tail"), (502, "la " * 300), (503, "la " * 300), (504, None), (505, ""), (506, " \t\n"), (507, "short"), (508, "x" * 900), (None, docs[0][1])]
    return docs


def windows_of_words(texts, width):
    low = {}
    for i, t in texts:
        if i is None:
            continue
        w = (t or "").encode().split()
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            low[key] = min(low.get(key, i), i)
    out = {}
    for i, t in texts:
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - width + 1) if i is not None else ():
            if low[tuple(w[k : k + width])] < i:
                gone[k : k + width] = True
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("crowded", [4096, 1])
def test_substrings_equal_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(spans, "CROWDED", crowded)
    texts = corpus()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.deduplicate(table(spark, texts)).collect()}
    assert got == windows_of_words(texts, 50)
    kept = {r.doc_id: r.kept for r in substring.deduplicate(table(spark, texts[:5]), with_text=True).collect()}
    assert kept[3] == " ".join(texts[1][1].split())


@pytest.mark.parametrize("crowded", [4096, 1])
def test_bytes_equal_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(spans, "CROWDED", crowded)
    texts = corpus()
    seen = {}
    for i, t in texts:
        b = (t or "").encode()
        for k in range(len(b) - 199) if i is not None else ():
            seen[b[k : k + 200]] = seen.get(b[k : k + 200], 0) + 1
    want = {}
    for i, t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199) if i is not None else ():
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        starts = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[i] = (len(b), int(gone.sum()), starts, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.deduplicate(table(spark, texts)).collect()}
    assert got == want


def test_merge_of_shards_finds_common_prefixes():
    data = np.frombuffer(b"abcdefghABCDEFGH" * 2 + b"abcXefghABCDEFGH", np.uint8)
    eights = K.eights(data)
    one = suffixes.Shard(np.zeros(2, np.int64), np.array([0, 16]), eights, 16)
    two = suffixes.Shard(np.zeros(1, np.int64), np.array([32]), eights, 16)
    assert suffixes.merge([one, two], 2).tolist() == [16, 16, 8]  # the last differs in the symbol before its last
    other = suffixes.Shard(np.ones(1, np.int64), np.array([32]), eights, 16)
    assert suffixes.merge([one, other], 2).tolist() == [16, 16, 0] and suffixes.merge([], 2).tolist() == []


def thue_morse(n, one, two):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return [two if b else one for b in bits[:n]]


def repeated_ids():
    """Equal ids with different texts, in one block and in others, and strings whose polynomial hashes collide."""
    rng = np.random.default_rng(4)
    some = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    a, b, c = some(80), some(100), some(300)
    docs = [(1, a), (2, a), (2, "short"), (2, b), (2, None), (3, c), (3, c), (4, c + " " + a), (5, "x"), (5, c[:1500])]
    docs += [(6, " ".join(thue_morse(2048, "p", "q"))), (7, " ".join(thue_morse(2048, "q", "p"))), (8, "".join(thue_morse(2048, "x", "y")) + " " + " ".join(b.split()[:49])), (9, "".join(thue_morse(2048, "y", "x")) + " " + " ".join(b.split()[:49]))]
    return docs


@pytest.mark.parametrize(("crowded", "heavy", "lot"), [(4096, 4096, 10_000), (1, 0, 2)])
def test_rows_that_repeat_an_id_are_judged_by_their_own_texts(spark, monkeypatch, crowded, heavy, lot):
    monkeypatch.setattr(spans, "CROWDED", crowded)
    monkeypatch.setattr(session, "HEAVY_ROWS", heavy)
    monkeypatch.setattr(session, "HEAVY_KEYS", 1 if heavy else 100_000)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, lot)
    texts = repeated_ids()
    try:
        docs = table(spark, texts).repartition(1)
        got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.deduplicate(docs).collect())
        low = {}
        for i, t in texts:
            w = (t or "").split()
            for k in range(len(w) - 49):
                low[tuple(w[k : k + 50])] = min(low.get(tuple(w[k : k + 50]), i), i)
        want = []
        for i, t in texts:
            w = (t or "").split()
            gone = np.zeros(len(w), bool)
            for k in range(len(w) - 49):
                if low[tuple(w[k : k + 50])] < i:
                    gone[k : k + 50] = True
            want.append((i, len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
        assert got == sorted(want)
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffixes.deduplicate(docs).collect())
        seen = Counter(t[k : k + 200] for _, t in texts if t for k in range(len(t) - 199))
        want = []
        for i, t in texts:
            b = np.frombuffer((t or "").encode(), np.uint8)
            gone = np.zeros(len(b), bool)
            for k in range(len(b) - 199):
                if seen[t[k : k + 200]] > 1:
                    gone[k : k + 200] = True
            want.append((i, len(b), int(gone.sum()), hashlib.sha256(b[~gone].tobytes()).hexdigest()))
        assert got == sorted(want)
    finally:
        spark.conf.set(key, before)


def test_hashes_of_words_do_not_collide_by_construction():
    words = [w.encode() for pair in (("x", "y"), ("ab", "ba")) for n in (256, 1024, 2048) for w in ("".join(thue_morse(n, *pair)), "".join(thue_morse(n, *pair[::-1])))]
    words += [b"", b"a", b"a\0", b"\0", b"a" * 63, b"a" * 64, b"a" * 65]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    h = K.range_hashes(data, ends - [len(w) for w in words], ends, 53)
    assert len(set(h.tolist())) == len(words)
    again = K.range_hashes(np.frombuffer(b"zz" + words[0], np.uint8), np.array([2]), np.array([2 + len(words[0])]), 53)
    assert again[0] == h[0]


def test_no_rows(spark):
    empty = table(spark, [])
    assert substring.deduplicate(empty).count() == suffixes.deduplicate(empty).count() == simhash.near_duplicates(empty).count() == 0


def plain_fingerprint(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize(("fine", "heavy"), [(4096, 4096), (2, 0)])
def test_simhash_groups_equal_brute_force(spark, monkeypatch, fine, heavy):
    monkeypatch.setattr(simhash, "FINE", fine)
    monkeypatch.setattr(session, "HEAVY_ROWS", heavy)
    rng = np.random.default_rng(9)
    base = [[f"w{int(x)}" for x in rng.integers(0, 50, 400)] for _ in range(4)]
    texts = [(100 - i, " ".join([*base[i % 4][: 395 - i // 8], "Zé"] if i % 5 else base[i % 4])) for i in range(60)]
    texts += [(200, None), (201, ""), (202, "  "), (203, "one"), (204, "ONE"), (205, "one two")]
    got = {r.doc_id: r for r in simhash.near_duplicates(table(spark, texts)).collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints and len(got[200].fingerprint) == 16
    label = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    label[a] = min(label[a], label[b])
    assert {i: r.component_id for i, r in got.items()} == label


def test_refiling_ends_and_loses_no_pair():
    rng = np.random.default_rng(2)
    for path in (0, 1, 7, 4 * 5 + 2):
        slices = simhash.open_bits(path, 3)
        closed = 64 - sum(map(len, slices))
        assert closed >= 16 * (path > 0) and len(slices) == 4
    path, n = 0, 0
    while any(simhash.open_bits(path, 3)):
        path, n = path * 5 + 1 + int(rng.integers(0, 4)), n + 1
        assert n < 30


def test_thresholds_satisfy_the_pigeonhole_principle():
    sample = np.random.default_rng(1).integers(0, 2**63, 300, dtype=np.uint64)
    for total in (10, 10**6, 10**9):
        groups, thresholds = simhash.plan(sample, total)
        assert sum(t + 1 for t in thresholds) == 4 and sorted(b for g in groups for b in g) == list(range(64))
