import hashlib
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from arrayloom.llm import bpe, decontaminate, langid, neighbours, pii, quality, session, urls
from arrayloom.llm import kernels as K

TEXTS = [(1, "Plain words here, don't they'll 12 é."), (2, None), (3, ""), (4, "a  b\n\n c\t"), (5, "中文 😀's 'll"), (6, "x" * 3000), (7, "  "), (7, "  ")]


def table(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "k", 1.0) for i, t in texts], "doc_id bigint, text string, key string, score double")


def test_tokens_equal_tiktoken_and_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.load_ranks(path))}, special_tokens={})
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in bpe.encode_documents(table(spark), path).collect())
    want = []
    for i, t in TEXTS:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert got == sorted(want)
    assert bpe.encode_documents(table(spark, []), path).count() == 0


def test_random_texts_are_encoded_as_tiktoken_does(monkeypatch):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = bpe.load_ranks(path)
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rng = np.random.default_rng(12)
    letters = [*"abcdeXYZ  \n\t'0123.,!-_é", "中", "文", "😀", "ß", "\u0301", "'s", "'ll", "ing", " the"]
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 200)))) for _ in range(300)]
    bits = [0]
    while len(bits) < 4096:
        bits += [1 - b for b in bits]
    for n in (1024, 2048, 4096):  # pre-tokens that polynomial hashes modulo 2**64 cannot tell apart
        one = "".join("xy"[b] for b in bits[:n])
        texts.append(one + "\n" + one.translate(str.maketrans("xy", "yx")))
    enc = bpe.Encoder(tokens)
    for collide in (False, True):
        if collide:  # all pre-tokens of a length have one hash
            monkeypatch.setattr(K, "range_hashes", lambda data, start, end, seed: (end - start).astype(np.uint64) * np.uint64(3))
            perfect = enc.perfect
            perfect.find = lambda keys: np.full(len(keys), 300)
            enc = bpe.Encoder(tokens, perfect)
        raw = [t.encode() for t in texts]
        ids, first = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
        for t, s, e in zip(texts, first[:-1], first[1:], strict=True):
            assert ids[s:e].tolist() == ref.encode_ordinary(t)
            assert enc.decode(ids[s:e]).tobytes() == t.encode()


def test_a_full_store_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "STORE_ENTRIES", 3)
    tokens = [bytes([i]) for i in range(256)] + [b"ab", b"abc"]
    enc = bpe.Encoder(tokens)
    for text in (b"abab", b"abcab xx yy abab", b"zz ww abab"):
        ids, _ = enc.encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert enc.decode(ids).tobytes() == text


@pytest.mark.parametrize("block", [2_000_000, 3])
def test_contamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    items = [(1, "One two three four five six seven eight nine"), (2, "two three four five six seven eight NINE"), (10, "é"), (11, None), (12, "--"), (2, "two three four five six seven eight NINE")]
    docs = [(1, "x one TWO three-four five six seven eight nine y"), (2, "é é"), (3, None), (4, ""), (5, "one two three"), (1, "again é")]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(tuple(r) for r in decontaminate.contamination(table(spark, docs), b).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == sorted([(1, 11, 9, 2, sha("1,2"), True), (2, 2, 2, 1, sha("10"), False), (3, 0, 0, 0, sha(""), False), (4, 0, 0, 0, sha(""), False), (5, 3, 0, 0, sha(""), False), (1, 2, 1, 1, sha("10"), False)])
    none = decontaminate.contamination(table(spark, docs), b.limit(0)).collect()
    assert len(none) == 6 and not any(r.n_items for r in none)
    assert decontaminate.contamination(table(spark, []), b).count() == 0


def test_phrases_and_proximity(spark):
    index = decontaminate.build_index(table(spark, [(1, "a b c a x b"), (2, "b a")]))
    assert sorted(tuple(r) for r in decontaminate.phrase_matches(index, {7: "a b"}).collect()) == [(1, 7, 0)]
    near = sorted(tuple(r) for r in decontaminate.proximity_matches(index, {7: "a b"}, 1).collect())
    assert (1, 7, 3) in near and (2, 7, 0) in near and (1, 7, 0) in near


def test_base_spans_follow_the_rules():
    text = "me.x+1@ab.co.uk, 1.2.3.4.5 256.1.1.1 4111 1111 1111 1111 4111111111111112 +1 (555) 010-9999 +12 é@b.c"
    assert [(pii.KINDS[k], text[s:e]) for k, s, e in sorted(pii.base_spans(text))] == [(k, text[s:e]) for k, s, e in plain_spans(text)]
    for t in (text, "a@b.c@d.e", "a@b c@d.e.f", "@@a.b x@-.-", ""):
        assert [(s, e) for k, s, e in pii.base_spans(t) if k == 0] == [m.span() for m in CONTRACT["email"].finditer(t)]


def test_tagger_gradients_and_learning():
    tagger = pii.Tagger(1, e=3, h=4)
    rng = np.random.default_rng(0)
    x, y = rng.integers(1, 128, (6, 3)), np.array([[0, 1, 3], [0, 2, 4], [5, 2, 4], [6, 0, 0], [0, 0, 7], [0, 0, 8]])
    _, grads = tagger.gradients(x, y)
    for name in tagger.NAMES:
        w = getattr(tagger, name)
        at = tuple(rng.integers(0, n) for n in w.shape) if name != "embed" else (int(x[2, 1]), 1)
        old, step = w[at], 1e-5
        w[at] = old + step
        up = tagger.gradients(x, y)[0]
        w[at] = old - step
        down = tagger.gradients(x, y)[0]
        w[at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-6), name
    trained = pii.train([])
    held = pii.synthetic(99, 150)
    hit = sum(len(set(s) & set(p)) for (_, s), p in zip(held, pii.predict(trained, [t for t, _ in held])))
    assert hit / sum(len(s) for _, s in held) > 0.85


CONTRACT = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes(kind, own):
    digits = [int(c) for c in own if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in own.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain_spans(text):
    """Base spans by the contract's own patterns."""
    return [(k, m.start(), m.end()) for k, p in CONTRACT.items() for m in p.finditer(text) if passes(k, m.group())]


def personal_texts():
    rng = np.random.default_rng(21)
    parts = [*"0123456789 .-@+()éa_%\n", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 010-9999", "me@ab.co", "4111-1111-1111-1111", "255.0.0.1", "x.y@z", "+49 30 1234567"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 40)))) for _ in range(400)]
    texts += ["write to ann.b@example.com now", None, "", "nothing", "é " * 60 + "10.0.0.1 " * 30, "1" * 5000, ("word 7 " * 20_000) + "last@one.org", "call 555-010-9999 or (555) 010 1234 today"]
    return [(i // 2 if i < 6 else i, t) for i, t in enumerate(texts)] + [(None, "a@b.cd")]


def test_base_spans_equal_the_patterns():
    for _, t in personal_texts():
        assert [(pii.KINDS[k], s, e) for k, s, e in sorted(pii.base_spans(t or ""))] == sorted(plain_spans(t or ""), key=lambda x: (pii.KINDS.index(x[0]), x[1]))


def test_personal_data_query(spark):
    docs = personal_texts()
    tagger = pii.fit(table(spark, docs))
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in pii.find(table(spark, docs), tagger=tagger).collect()), key=repr)
    joined = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), x[1])))
    base = [(i, t or "", plain_spans(t or "")) for i, t in docs]
    want = [(i, *(sum(k == kind for k, _, _ in own) for kind in pii.KINDS), hashlib.sha256(joined(own).encode()).hexdigest()) for i, _, own in base]
    assert sorted((g[:6] for g in got), key=repr) == sorted(want, key=repr)
    read = lambda s: [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in s.split(",") if x)]
    sums = {}
    for (i, *_, digest), (_, t, own) in zip(want, base, strict=True):
        sums.setdefault((i, digest), []).append((t, own))
    for g in got:
        every = read(g[6])
        assert joined(every) == g[6]
        text, own = next((t, o) for t, o in sums[g[0], g[5]] if set(o) <= set(every))
        for kind, s, e in set(every) - set(own):  # what the network adds touches nothing and has its kind's marks
            assert pii.plausible(text, (pii.KINDS.index(kind), s, e)) and not any(s < b and a < e for _, a, b in own)
    out = [r.text for r in pii.redact(table(spark, docs), tagger=tagger).collect()]
    assert "write to <EMAIL> now" in out and len(out) == len(docs) and any(t and t.endswith("word 7 <EMAIL>") for t in out)
    assert pii.find(table(spark, [])).count() == pii.redact(table(spark, []), tagger=tagger).count() == 0


def test_added_spans_of_forms_that_no_rule_knows():
    tagger = pii.train([])
    held = pii.synthetic(1234, 300)
    base = [set(pii.base_spans(t)) for t, _ in held]
    more = [set(s) - b for (_, s), b in zip(held, base)]
    added = [set(e) - b for e, b in zip(pii.all_spans(tagger, [t for t, _ in held])[1], base)]
    hit = sum(len(m & a) for m, a in zip(more, added))
    assert sum(map(len, more)) > 20 and hit / sum(map(len, more)) > 0.7 and hit / max(1, sum(map(len, added))) > 0.9


def test_quality_learns_and_covers_whole_texts(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows = []
    for i in range(240):
        w = [word() for _ in range(80)]
        rows.append((i, " ".join(w) if i % 2 else " ".join(w[:60] + [x + "%%%" for x in w[60:]]), i % 2))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "abc " * 20000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 243 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [i for i, _, _ in rows if got[i].held_out]
    assert np.mean([(got[i].score >= 0.5) == (i % 2 == 1) for i in held]) > 0.9
    one = quality.classify(docs, labels.where("quality = 1")).agg(F.min("score"), F.max("score")).first()
    assert tuple(one) == (1.0, 1.0) and quality.classify(docs, labels.limit(0)).first().score == 0.5
    assert quality.keep_good(docs, labels).columns == docs.columns


def plain_score(net, text):
    """The network's score of one text, byte by byte and chunk by chunk."""
    raw = list(text) + [0] * quality.WIDTH
    act = [np.maximum(net.bias + sum(net.embed[raw[p + w]] @ net.filters[w] for w in range(quality.WIDTH)), 0) for p in range(len(text))]
    cells = (len(text) + quality.WIDTH - 1) // quality.CELL + 1
    best = np.zeros(len(net.out))
    for c in range(cells):
        if c == cells - 1 and c:
            break  # the last cell belongs to the chunk before it
        own = act[c * quality.CELL : (c + 2) * quality.CELL]
        total, size = (np.sum(own, axis=0) if own else np.zeros(len(net.bias))), len(own)
        z = ((total + quality.PRIOR_BYTES * net.mean) / (size + quality.PRIOR_BYTES) - net.mean) / net.scale
        best = np.maximum(best, np.maximum(z @ net.hidden + net.hidden_bias, 0))
    return 1 / (1 + np.exp(-(net.slope * (best @ net.out + net.out_bias) + net.shift)))


def test_quality_query_equals_plain_scores(spark):
    rng = np.random.default_rng(13)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    texts = [(i, " ".join(word(5) + ("%%" if i % 2 == 0 else "") for _ in range(int(rng.integers(1, 90))))) for i in range(120)]
    texts += [(200, None), (201, ""), (202, "é" * 127 + "ab"), (203, "x" * 128), (204, "y" * 125), (3, "of a repeated id"), (3, texts[3][1]), (None, "without id")]
    docs = spark.createDataFrame([(i, t, 1, 2.0) for i, t in texts], "doc_id bigint, text string, _quality int, score double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)] + [(7, 1, 0), (None, 1, 0), (8, None, 0)], "doc_id bigint, quality int, toxic int")
    net = quality.fit(docs, labels)
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.held_out, r.score, r.predicted) for r in quality.classify(docs, labels).collect()))
    want = sorted((-1 if i is None else i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2, plain_score(net, (t or "").encode())) for i, t in texts)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[2] == pytest.approx(w[2], abs=2e-4) and g[3] == int(g[2] >= 0.7)
    assert quality.classify(docs.limit(0), labels).count() == 0 and quality.fit(docs, labels.limit(0)) == 0.5


def test_pii_windows_reach_the_ends_of_words():
    class Words:
        def decode(self, x):
            return np.where((x == pii.codes(" ")[0]) | (x == 0), 0, 2)

    own = "x" * 40 + "\u00e9@" + "y" * 90 + ".net"
    text = "some words before " + own + " " + "and words after it " * 9 + "7"
    at = text.index(own)
    assert pii.base_spans(own) == []
    assert (0, at, at + len(own)) in pii.all_spans(Words(), [text])[1][0]
    assert pii.regions("a" * 99) == [] and pii.regions("b" * 99 + " 5 " + "c" * 99) == [(76, 125)]


@pytest.mark.parametrize("block", [2_000_000, 30])
def test_long_items_and_words_that_nearly_collide(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    bits = [0]
    while len(bits) < 2048:
        bits += [1 - b for b in bits]
    one = "".join("xy"[b] for b in bits)
    two = one.translate(str.maketrans("xy", "yx"))
    long = " ".join(f"w{i}" for i in range(100))
    items = spark.createDataFrame([(1, one), (2, long), (None, "z")], "item_id bigint, text string")
    docs = [(1, two), (2, one), (3, "a " + " ".join(f"w{i}" for i in range(40, 60)) + " b"), (4, " ".join(f"w{i}" for i in range(90, 97))), (5, "z " * 50_000)]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(table(spark, docs), items).collect()}
    assert got == {1: (1, 0, 0), 2: (1, 1, 1), 3: (22, 20, 1), 4: (7, 0, 0), 5: (50_000, 0, 0)}


@pytest.mark.parametrize("block", [2_000_000, 3])
def test_contamination_of_a_table_united_with_itself(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    b = spark.createDataFrame([(1, "one two three four"), (2, "é é é é é")], "item_id bigint, text string")
    docs = table(spark, [(1, "x one two three four"), (2, "one")]).coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 2)  # a segment for each copy
    try:
        got = sorted((r.doc_id, r.n_words, r.n_hit) for r in decontaminate.contamination(docs.union(docs), b).collect())
    finally:
        spark.conf.set(key, before)
    assert got == [(1, 5, 4), (1, 5, 4), (2, 1, 0), (2, 1, 0)]


def plain_language(model, text):
    """A prediction by dictionaries of character n-grams."""
    low = "".join(c.lower() if unicodedata.category(c)[0] == "L" and len(c.lower()) == 1 else c if unicodedata.category(c)[0] in "LM" else " " for c in text)
    if not any(unicodedata.category(c)[0] == "L" for c in text):
        return "und", 0.0
    count = {}
    for n in (1, 2, 3):
        for i in range(len(low) - n + 1):
            h = 0
            for k, c in enumerate(low[i : i + n]):
                h = (h ^ (ord(c) + k + 1)) * (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)[k] & 0xFFFFFFFF
                h ^= h >> 15
            place = (h * 0x27D4EB2F & 0xFFFFFFFF) >> (33 - langid.FEATURES.bit_length())
            count[place] = count.get(place, 0) + 1
    x = {p: np.log1p(c) * model.idf[p] for p, c in count.items()}
    norm = np.sqrt(sum(v * v for v in x.values()))
    z = (sum(v / norm * model.weights[p] for p, v in x.items()) + model.bias) / model.temperature
    e = np.exp(z - z.max())
    return model.languages[int(np.argmax(e))], e.max() / e.sum()


def test_language_query_equals_plain_predictions(spark):
    rng = np.random.default_rng(31)
    own = {"en": "the cat and dog of that".split(), "de": "der hund und die katze nicht süß".split(), "zh": "天 地 玄 黄 宇宙 洪荒".split(), "el": "και το είναι ένα".split()}
    rows = [(i, " ".join(rng.choice(own[k], int(rng.integers(3, 30)))), k) for i in range(40) for k in own]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    rows += [(500, None, "en"), (501, "12 ! ½ ²", "de"), (502, "", None), (503, "the dog", None), (None, "και το", "el"), (504, "ΚΑΙ ΤΌ é\u0301", None), (505, "und der hund " * 9000, None), (7, rows[7][1], rows[7][2]), (8, "katze katze nicht", "de")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id bigint, text string, lang string, key int, r int, score int")
    model = langid.fit(docs)
    got = sorted(((r.doc_id or -1, r.held_out, r.lang_pred, r.score) for r in langid.identify(docs).collect()))
    want = sorted((i or -1, i is not None and zlib.crc32(str(i).encode()) % 4 == 2, *plain_language(model, t or "")) for i, t, _ in rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-9)
    held = {i: k for i, _, k in rows if k and i is not None and zlib.crc32(str(i).encode()) % 4 == 2 and i < 400}
    assert sum(g[2] == held[g[0]] for g in got if g[0] in held) >= 0.95 * len(held)
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_languages_are_learnt_from_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 20)
    docs = spark.range(6000).selectExpr("IF(id < 3000, 1, id) AS doc_id", "IF(id < 3000, 'the cat', concat('der hund ', id)) AS text", "IF(id < 3000, 'en', 'de') AS lang")
    own = docs.selectExpr("lang", "xxhash64(doc_id, text) AS key", "text")
    sizes = {r[0]: r[1] for r in langid.learning_rows(own).groupBy("lang").count().collect()}
    assert sizes == {"en": 1, "de": 20}
    model = langid.fit(docs)
    assert model.languages == ["de", "en"]


def test_equally_likely_languages_are_taken_in_order():
    model = langid.Model(["aa", "bb"], np.ones(langid.FEATURES), np.zeros((langid.FEATURES, 2)), np.zeros(2))
    assert model.predict(np.ones(langid.FEATURES, np.int64)) == ("aa", 0.5)


def test_urls(spark):
    cases = {
        "http://A.Net/x?y": ("a.net", "/x", "net/", "block"), "https://w.example.net/en/1": ("w.example.net", "/en/1", "example.net/en/", "allow"), "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "http://notnet/": ("notnet", "/", None, "allow"), "x.net/": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://b.org#/fr/": ("b.org", "", None, "allow"), "http://b.org/fr/": ("b.org", "/fr/", "org/fr/", "allow"),
        "http://net": ("net", "", None, "allow"), "http://?q=http://a.net/": ("", "", None, "allow"), "": ("", "", None, "allow"), "http://a.net/\nz": ("a.net", "/\nz", "net/", "block"),
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)], "page_id bigint, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.judge(pages, []).where("rule IS NOT NULL").count() == 0 and urls.judge(pages.limit(0)).count() == 0


@pytest.mark.parametrize(("most", "heavy"), [(100_000, 4096), (2, 0)])
def test_urls_with_common_pages_and_other_rules(spark, monkeypatch, most, heavy):
    """Rules on both sides of the broadcast, hot pages, rules of equal length and rules without a token."""
    monkeypatch.setattr(urls, "RULES_MOST", most)
    monkeypatch.setattr(session, "HEAVY_ROWS", heavy)
    rules = [urls.parse_rule("block", "a.com/x"), urls.Rule("allow", "a.com", "/x"), urls.parse_rule("block", "b.com/y/"), urls.Rule("block", "", "/ads"), urls.parse_rule("allow", "n.b.com/")]
    urls_ = [None] * 40 + ["http://a.com/x"] * 60 + ["http://www.b.com/y/1", "http://c.de/ads/1", "http://a.com/ads", "http://q.n.b.com/y/", "http://x.y/"]
    pages = spark.createDataFrame([(i % 90, u, "h", "n") for i, u in enumerate(urls_)], "page_id bigint, url string, rule string, n string")

    def plain(u):
        if u is None:
            return "", "", None, "allow"
        host, slash, path = u.split("://", 1)[1].partition("/")
        path, best = slash + path, None
        for r in rules:
            if (not r.host or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.name) > len(best.name)):
                best = r
        return host, path, best and best.name, best.verdict if best else "allow"

    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules).collect()), key=repr)
    assert got == sorted(((i % 90, *plain(u)) for i, u in enumerate(urls_)), key=repr)
    with pytest.raises(ValueError, match="literal token"):
        urls.judge(pages, [urls.Rule("block", "", f"/{i}") for i in range(urls.FREE_MOST + 1)])


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[40:60] = x[7]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] * 8, 0), (903, [1.0], 0), (904, [None] * 8, 0), (905, [float("inf")] * 8, 0), (920, None, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    got = {}
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    s = x.astype(np.float64) @ x.astype(np.float64).T
    hit = 0
    assert sorted(got) == list(range(0, 300, 20)) and all(len(v) == 20 for v in got.values())
    for q in got:
        order = [i for i in np.lexsort((np.arange(300), -s[q])) if i != q][:20]
        hit += len(set(order) & {i for i, _ in got[q]})
        assert all(v == pytest.approx(s[q, i], abs=1e-12) for i, v in got[q])
    assert hit / (20 * len(got)) >= 0.9
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert [r.vec_id for r in neighbours.nearest(df.where("vec_id in (20, 21)")).collect()] == [21]


def test_neighbours_of_each_length_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(session, "HEAVY_ROWS", 3)
    rng = np.random.default_rng(15)
    x = {i: rng.normal(size=4 if i % 3 else 2).tolist() for i in range(60)}
    x |= {i: [1.0, 2.0, 3.0, 4.0] for i in range(100, 200)}
    df = spark.createDataFrame([(i, v, i, "q") for i, v in x.items()] + [(20, [1e300] * 4, 1, "again")], "vec_id bigint, embedding array<double>, node bigint, q string")
    got = {}
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in (i for i in x if i % 20 == 0):
        s = {i: float(np.dot(x[q], v)) for i, v in x.items() if i != q and len(v) == len(x[q])}
        want = sorted(s, key=lambda i: (-round(s[i], 9), i))[:20]
        assert len(set(want) & set(got[q])) >= 0.9 * len(want), q


def test_neighbours_among_near_copies(spark):
    rng = np.random.default_rng(6)
    x = (rng.normal(size=16) + 0.0005 * rng.normal(size=(1500, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, every=100).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = x.astype(np.float64) @ x.astype(np.float64).T
    want = {q: set([i for i in np.lexsort((np.arange(1500), -s[q])).tolist() if i != q][:20]) for q in range(0, 1500, 100)}
    assert sum(len(want[q] & got[q]) for q in want) >= 0.95 * 20 * len(want)


def test_neighbours_over_shards(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 150, raising=False)
    monkeypatch.setattr(neighbours, "WAVE", 3, raising=False)
    written, write = [], neighbours.write_table

    def counted(df, label):
        out = write(df, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "write_table", counted)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 24))
    x[300:340] = x[7] + 0.01 * rng.normal(size=(40, 24))  # a small group, in all shards
    x[500:530] = x[20]
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    s = x.astype(np.float64) @ x.astype(np.float64).T
    assert sorted(got) == list(range(0, 1200, 20))
    hit = 0
    for q, found in got.items():
        hit += len(set([i for i in np.lexsort((np.arange(1200), -s[q])).tolist() if i != q][:20]) & {i for i, _ in found})
        assert len(found) == 20 and found == sorted(found, key=lambda v: (-v[1], v[0]))
        assert all(v == pytest.approx(s[q, i], abs=1e-12) for i, v in found)
    assert hit >= 0.95 * 20 * len(got)
    # steps hold the vectors and what the queries found, not lists of neighbours for each round
    assert sum(written) <= 4 * len(x), written


def test_neighbours_closer_than_four_bytes_tell(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([1 + 1e-9 * rng.normal(size=(1500, 16)), rng.normal(size=(500, 16))])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, every=100).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = {q: {i for i in np.lexsort((np.arange(2000), -(x @ x[q]))).tolist()[:21] if i != q} for q in range(0, 2000, 100)}
    assert sum(len(want[q] & got[q]) for q in want) >= 0.95 * 20 * len(want)
