"""The registered llm queries and the pipeline, against SQL or brute force over whole tables."""

import decimal
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F
from test_llm_operators import plain_classes, quantile
from test_llm_texts import plain_base
from tokenizers import Tokenizer

from fleetlens.llm import ORACLES, QUERIES, fingerprint, pii, quality
from fleetlens.llm.tables import documents, held_out, stored


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return con


@pytest.fixture(scope="module")
def docs(spark):
    return [r.asDict() for r in documents(spark, SF_DIR).orderBy("doc_id").collect()]


def plain(value):
    return float(value) if isinstance(value, decimal.Decimal) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    columns = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns and rows
    order = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)


def test_every_operator_has_one_query():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13
    import __spark_entry__

    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_languages_of_the_held_out_fold(spark, docs):
    rows = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, SF_DIR).collect()}
    assert len(rows) == len(docs) and all(rows[d["doc_id"]].held_out == fold(d["doc_id"]) for d in docs)
    unseen = [d for d in docs if fold(d["doc_id"])]
    assert np.mean([rows[d["doc_id"]].lang_pred == d["lang"] for d in unseen]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows.values())


def tokens(name, texts, end):
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array(e.ids + [end], np.uint32) for e in whole.encode_batch(texts, add_special_tokens=False)]


def check_layout(rows, ids, capacity=2048):
    """``ids``: the ids of each (doc_id, occurrence) by doc_id."""
    sequences, total = {}, 0
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(sequences) <= -(-total // capacity) * 1.02 + 1
    return total


def test_packing_of_all_documents(spark, docs):
    rows = QUERIES["op2_best_fit_packing"](spark, SF_DIR).collect()
    ids = dict(zip((d["doc_id"] for d in docs), tokens("byte_bpe_50k.json", [d["text"] or "" for d in docs], 0)))
    assert check_layout(rows, ids) == sum(map(len, ids.values()))


def test_fingerprints_of_all_documents(spark, docs):
    rows = {r.doc_id: r for r in QUERIES["op4_phrase_fingerprint"](spark, SF_DIR).collect()}
    ordered = docs[::-1]
    for d, following in zip(ordered, ordered[1:] + ordered[:1]):
        own, _, new = fingerprint.both(d["text"] or "", following["text"] or "")
        r = rows[d["doc_id"]]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(d["text"] or ""), fingerprint.to_text(own), fingerprint.to_text(new))
    assert np.mean([r.near_edited > r.near_next for r in rows.values()]) > 0.95


def test_quality_of_the_held_out_fold(spark, docs):
    rows = {r.doc_id: r for r in QUERIES["op5_byte_cnn_quality"](spark, "/root/testdata/sf0.01").collect()}
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    unseen = [x for x in known if fold(x.doc_id)]
    assert np.mean([rows[x.doc_id].predicted == x.quality for x in unseen]) > 0.9
    assert all(r.predicted == (r.score >= 0.3) and r.held_out == fold(r.doc_id) for r in rows.values())


def test_ids_of_all_documents(spark, docs):
    rows = {r.doc_id: r for r in QUERIES["op6_packed_ids"](spark, SF_DIR).collect()}
    start = 0
    for d, ids in zip(docs, tokens("word_bpe_49k.json", [d["text"] or "" for d in docs], 1)):
        r = rows[d["doc_id"]]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_totals_of_all_documents(spark, docs):
    want, least = {}, {}
    texts = [d["text"] or "" for d in docs]
    counts = {v: [len(ids) - 1 for ids in tokens(f"{v}.json", texts, 0)] for v in ("byte_bpe_50k", "word_bpe_49k")}
    for d, text in zip(docs, texts):
        least[text] = min(least.get(text, d["doc_id"]), d["doc_id"])
    for i, (d, text) in enumerate(zip(docs, texts)):
        if d["doc_id"] == least[text]:
            version = "word_bpe_49k" if d["lang"] == "en" else "byte_bpe_50k"
            total = want.setdefault((d["source"], d["lang"], version), [0, 0])
            total[0] += 1
            total[1] += counts[version][i]
    rows = QUERIES["op10_token_rollup"](spark, SF_DIR).collect()
    assert {(r.source, r.lang, r.version): [r.n_docs, r.n_tokens] for r in rows} == want and len(rows) == len(want)


def test_personal_data_of_all_documents(spark, docs):
    rows = {r.doc_id: r for r in QUERIES["op9_pii_boosting"](spark, SF_DIR).collect()}
    for d in docs:
        r, base = rows[d["doc_id"]], plain_base(d["text"] or "")
        spans = r.spans.split(",") if r.spans else []
        assert spans[: len(base)] == [f"{k}:{a}:{b}" for k, a, b in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.BASE)


def test_pipeline_equals_brute_force(spark):
    """Each stage's function on the rows before it, against plain Python with the same fitted models."""
    rows = documents(spark, SF_DIR)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    columns = rows.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "PII", "mixing sources to target weights", "best-fit packing"]
    stages = [f for _, f in corpus_pipeline.STAGES]

    def step(number, before):
        out = stored(stages[number](spark, before, SF_DIR), "test-stage")
        if number < 4:
            assert out.columns == columns
        return out, sorted(before.collect()), sorted(out.collect())

    network = quality.fit(rows, labels, train_fold=~held_out())
    kept, before, after = step(0, rows)
    import pyarrow as pa

    scores = network.scores(pa.array([r.text or "" for r in before], pa.large_string()))
    assert after == [r for r, s in zip(before, scores) if s >= 0.3] and len(after) < len(before)

    single, before, after = step(1, kept)
    classes = plain_classes([r.text for r in before])
    assert after == [r for i, r in enumerate(before) if classes[i][0] == i] and len(after) < len(before)

    detector = pii.fit(single)
    clean, before, after = step(2, single)
    for a, b in zip(before, after):
        base, more = detector.spans(a.text or "")
        assert b.text == pii.redacted(a.text, base + more) and (b.doc_id, b.n_chars, b.source) == (a.doc_id, len(b.text), a.source)
    assert any(a.text != b.text for a, b in zip(before, after))

    mixture, before, after = step(3, clean)
    sizes, weights = {}, {"src1": 2.0, "src2": 0.5}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text)
    total, weight = float(sum(sizes.values())), sum(weights.get(s, 1.0) for s in sizes)
    import hashlib

    want = []
    for r in before:
        rate = weights.get(r.source, 1.0) * total / weight / sizes[r.source]
        u = int(hashlib.md5(f"17:{r.doc_id}:1".encode()).hexdigest()[:13], 16) / (1 << 52)
        want += [r] * quantile(u, rate)
    assert after == sorted(want)

    _, before, after = step(4, mixture)
    ids = dict(zip((r.doc_id for r in before), tokens("byte_bpe_50k.json", [r.text for r in before], 0)))
    assert check_layout(after, ids) == sum(len(ids[r.doc_id]) for r in before)
