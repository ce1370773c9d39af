import hashlib
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from arrayloom.llm import bpe, pii, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_brute_force_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "personal_data", "tokens"]
    first = corpus_pipeline.stage_quality(spark, docs, SF)
    assert first.columns == docs.columns
    good = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in first.collect()} == good and good

    second = corpus_pipeline.stage_near_duplicates(spark, docs, SF)
    assert set(second.columns) == set(docs.columns)
    prints = {r.doc_id: simhash.fingerprint((r.text or "").encode()) for r in docs.collect()}
    label = dict(zip(prints, prints))
    for _ in range(6):
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
    assert {r.doc_id for r in second.collect()} == {i for i in prints if label[i] == i}

    third = corpus_pipeline.stage_decontaminate(spark, docs, SF)
    word, owners = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), {}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall((r.text or "").translate(low))
        for k in range(max(1, len(w) - 7)) if w else ():
            owners.setdefault(tuple(w[k : k + 8]), set()).add(r.item_id)
    clean = set()
    for r in docs.collect():
        w, hit = word.findall((r.text or "").translate(low)), set()
        for n in {len(x) for x in owners}:
            for k in range(len(w) - n + 1):
                hit |= owners.get(tuple(w[k : k + n]), set())
        if not hit:
            clean.add(r.doc_id)
    assert {r.doc_id for r in third.collect()} == clean

    fourth = {r.doc_id: r for r in corpus_pipeline.stage_personal_data(spark, docs, SF).collect()}
    assert len(fourth) == docs.count()
    for r in docs.collect():
        out = fourth[r.doc_id]
        if not pii._MARK.search(r.text or ""):
            assert out.text == r.text
        for k, s, e in pii.base_spans(r.text or ""):
            assert f"<{pii.KINDS[k].upper()}>" in out.text
        assert not {pii.KINDS[k] for k, _, _ in pii.base_spans(out.text or "")}

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.load_ranks(path))}, special_tokens={})
    for r in corpus_pipeline.stage_tokens(spark, docs.orderBy("doc_id").limit(50), SF).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r.ids == enc.encode_ordinary(r.text) and r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_stages_with_odd_rows(spark, tmp_path):
    """Null ids and texts, empty and long texts, ids that repeat, further columns, and tables without rows."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, "a b c d e f g h", "x"), (1, "one two three four five six seven eight nine", "y"), (2, "a b c d e f g h", "z"), (2, "a b c d e f g h", "z"), (None, "a b c d e f g h", "q"), (None, None, "r"), (3, None, "s"), (4, "", "t"), (5, long, "u"), (6, long + " q", "v"), (None, "k one two three four five six seven eight", "w"), (1, None, "dup")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _row string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars", "_row", "_row AS score", "_row AS t", "_row AS key")
    spark.createDataFrame([(7, "ONE two three four five six seven eight")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    out = {name: stages[name](spark, docs, str(tmp_path)) for name, _ in corpus_pipeline.STAGES}
    assert all(out[n].columns == docs.columns for n in ("quality", "near_duplicates", "decontaminate", "personal_data"))
    assert out["quality"].count() == 12 and out["personal_data"].count() == 12
    assert sorted(r._row for r in out["decontaminate"].collect()) == sorted(r[2] for r in rows if r[2] not in "yw")
    kept = sorted(r._row for r in out["near_duplicates"].collect())
    assert kept == sorted(["x", "y", "q", "r", "w", "u", "dup"])  # null and empty texts are one group, of which id 1 stays
    assert out["tokens"].count() == 12 and out["tokens"].where("n_tokens > 30000").count() == 2
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_run_writes_every_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns) and 0 < out.count() < 200
