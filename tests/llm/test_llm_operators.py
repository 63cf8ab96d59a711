"""The llm operators on small tables, against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm_texts import plain_base, plain_measures, words_of
from tokenizers import Tokenizer

from fleetlens.llm import fingerprint, hostrules, idfiles, jaccard, language, mixing, packing, pii, quality, rollup
from fleetlens.llm.tables import fresh_path, held_out, join_stats, stored

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or in their results.
CLASHING = ("score", "copy", "shuffle_key", "rate", "host", "part", "ahead", "row_id", "rep", "set_key", "bands", "rank", "gram", "piece", "quality", "kind", "word", "key")


def table(spark, rows, parts=3):
    full = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCUMENTS).repartition(parts)


def awkward(spark):
    rng = random.Random(9)
    prose = [" ".join(rng.choice(["alpha", "beta", "gamma.", "delta\n", "été", "x1"]) for _ in range(rng.randint(0, 90))) for _ in range(20)]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s1", "s2", None])) for i, t in enumerate(prose)]
    rows += [(None, None, None, None), (50, None, "en", "s1"), (51, "", "fr", None), (None, "no id", "en", "s2"), (None, "no id", "en", "s2")]
    rows += [(60, "long word " * 30_000, "en", "s1"), (61, "y" * 300_000, None, "s3")] + [(3, prose[3], "en", "s1")] * 2
    frame = table(spark, rows)
    for n, name in enumerate(CLASHING):
        frame = frame.withColumn(name, F.lit(n))
    return frame


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


RUNS = {
    "language": lambda d: language.predict(d, language.fit(d, train=~held_out())),
    "packing": lambda d: packing.pack(d, BYTES).select("doc_id", "piece").where("piece = 0"),
    "mixing": lambda d: mixing.mix(d, {}, budget=None),
    "fingerprint": lambda d: fingerprint.neighbours(d),
    "fingerprint only": lambda d: fingerprint.fingerprints(d),
    "quality": lambda d: quality.score(d, quality.fit(d, labels(d.sparkSession, [(1, 0, 0), (2, 1, 0), (2, None, 1), (4, 1, 0), (4, 0, 0), (None, 1, 0)]), train_fold=~held_out(), epochs=1)),
    "id files": lambda d: idfiles.read_digest(idfiles.write_ids(d, WORDS, idfiles.ids_folder(d))),
    "host rules": lambda d: hostrules.judge(d),
    "jaccard": lambda d: jaccard.join(d),
    "pii find": lambda d: pii.find(d, pii.fit(d)),
    "pii redact": lambda d: pii.redact(d, pii.fit(d)),
}


@pytest.mark.parametrize("name", RUNS)
def test_awkward_and_empty_tables(spark, name):
    docs = awkward(spark)
    rows = RUNS[name](docs).collect()
    if name == "mixing":
        assert set(RUNS[name](docs).columns) == {*docs.columns, "copy", "shuffle_key"}
    else:
        assert len(rows) == docs.count()
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    if name in ("quality", "pii redact"):
        assert set(CLASHING) <= set(rows[0].asDict())
    assert RUNS[name](docs.where("false")).count() == 0


def test_equal_rows_get_equal_results(spark):
    docs = awkward(spark)
    prints = {tuple(r)[3] for r in fingerprint.neighbours(docs).where("doc_id = 3").collect()}
    assert len(prints) == 1
    by_text = jaccard.join(docs).where("doc_id is null").collect()
    assert len({r.class_id for r in by_text if r.n_links == 1}) == 1


def test_packing_in_levels(spark):
    rng = random.Random(4)
    rows = [(i, "word " * rng.choice([1, 3, 20, 60, 99, 130, 500]), "en", "s") for i in range(600)]
    layout = packing.pack(table(spark, rows, 7), BYTES, capacity=128, slack=0, group_bins=60).collect()
    whole = Tokenizer.from_file(BYTES)
    bins = defaultdict(list)
    for r in layout:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 128
    ids = {i: np.array(whole.encode(t).ids + [0], np.uint32) for i, t, _, _ in rows}
    for r in layout:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert sum(r.length for r in layout) == sum(map(len, ids.values()))
    assert len(bins) <= -(-sum(map(len, ids.values())) // 128) * 1.02 + 1


def test_packing_ends_when_nothing_fits_together(spark):
    rows = [(i, "word " * 70, "en", "s") for i in range(90)]
    layout = packing.pack(table(spark, rows, 6), BYTES, capacity=100, group_bins=20)
    assert layout.select("sequence_id").distinct().count() == 90


def quantile(u, rate):
    p = cdf = float(np.exp(-rate))
    k = 0
    while u >= cdf and k < rate + 10 * rate**0.5 + 20:
        k += 1
        p = p * rate / k
        cdf += p
    return k


def test_poisson_quantiles(spark):
    rows = [(u, rate) for u in (0.0, 0.2, 0.5, 0.9, 0.999, 0.999999) for rate in (0.01, 0.7, 1.0, 5.5, 64.0)]
    got = spark.createDataFrame(rows, "u double, rate double").select("u", "rate", mixing.poisson_quantile(F.col("u"), F.col("rate")).alias("k"))
    assert [(r.u, r.rate, r.k) for r in got.collect()] == [(u, rate, quantile(u, rate)) for u, rate in rows]


def test_mixture_reaches_its_weights(spark):
    rows = [(i, "x" * 50, "en", "hot" if i % 3 else ("rare" if i % 30 else None)) for i in range(6000)]
    docs = table(spark, rows)
    mixed = mixing.mix(docs, {"hot": 1.0, "rare": 2.0}, default_weight=1.0)
    sizes = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    total = sum(sizes.values())
    assert abs(total / 300_000 - 1) < 0.1
    assert {k: round(v / total * 4) for k, v in sizes.items()} == {"hot": 1, "rare": 2, None: 1}
    many = mixing.mix(docs.where("source = 'rare'").limit(20), {}, budget=20 * 50 * 500.0)
    assert abs(many.count() / 10_000 - 1) < 0.05  # rates above one part
    again = mixing.mix(docs, {"hot": 1.0, "rare": 2.0}, small_sources=0)  # the salted join
    keys = lambda df: sorted(r.shuffle_key for r in df.select("shuffle_key").collect())
    assert keys(again) == keys(mixed)
    assert mixing.mix(docs, {"hot": 0.0}, default_weight=0.0).count() == 0


@pytest.mark.parametrize("budget", [None, 5e7])
def test_mixing_stays_in_the_jvm(spark, budget):
    docs = table(spark, [(i, "x" * i, "en", f"s{i % 3}") for i in range(50)])
    plan = mixing.mix(docs, {}, budget=budget)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "BroadcastNestedLoop", "Cartesian"))


def test_one_document_of_a_tiny_source_is_repeated_by_many_tasks(spark, monkeypatch):
    rows = [(i, "x" * 20, "en", "big") for i in range(2000)] + [(9000, "y", "en", "tiny"), (None, "z", "en", None)]
    docs = table(spark, rows)
    mixed = mixing.mix(docs, {}, budget=3e6)  # a million copies of each of the two
    counts = {r.source: r for r in mixed.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("d"), F.max("copy").alias("last")).collect()}
    for source in ("tiny", None):
        r = counts[source]
        assert abs(r.n / 1e6 - 1) < 0.01 and r.d == r.n == r.last + 1
    few = mixing.mix(docs, {}, budget=30_000.0)  # rates of 10,000: one block, or many
    keys = lambda df: sorted(r.shuffle_key for r in df.select("shuffle_key").collect())
    want = keys(few)
    monkeypatch.setattr(mixing, "BLOCK", 10)
    assert keys(mixing.mix(docs, {}, budget=30_000.0)) == want


def test_neighbours_in_many_ranges(spark):
    rng = random.Random(8)
    rows = [(i * 3, " ".join(rng.choice(["ab", "cde", "f", "ghij"]) for _ in range(rng.randint(0, 60))), "en", "s") for i in range(200)]
    docs = table(spark, rows, 4)
    ordered = sorted(rows, reverse=True)
    want = {}
    for (i, a, *_), (_, b, *_) in zip(ordered, ordered[1:] + ordered[:1]):
        own, _, new = fingerprint.both(a, b)
        want[i] = (len(a), fingerprint.to_text(own), fingerprint.likeness(own, new), fingerprint.likeness(own, fingerprint.fingerprint(b)))
    for ranges in (1, 2, 50):
        got = {r.doc_id: (r.n_chars, r.fingerprint, r.near_edited, r.near_next) for r in fingerprint.neighbours(docs, ranges=ranges).collect()}
        assert got == want
    one = fingerprint.neighbours(table(spark, [(7, "only one text", "en", "s")])).first()
    assert one.near_next == 1.0


def test_token_files_hold_the_corpus_in_order(spark):
    rng = random.Random(3)
    rows = [(i * 7 % 500, " ".join(rng.choice(["The", "cat's", "sat,", "é"]) for _ in range(rng.randint(0, 40))), "en", "s") for i in range(500)]
    docs = table(spark, rows, 5)
    folder = idfiles.ids_folder(docs)
    manifest = idfiles.write_ids(docs, WORDS, folder, block_ids=100, shards=4)
    whole, start = Tokenizer.from_file(WORDS), 0
    got = {r.doc_id: r for r in idfiles.read_digest(manifest).collect()}
    for i, text, *_ in sorted(rows):
        ids = np.array(whole.encode(text, add_special_tokens=False).ids + [1], np.uint32)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    files = [idfiles.Reader(r.path) for r in manifest.orderBy("shard").collect()]
    assert np.concatenate([f.doc_ids for f in files]).tolist() == sorted(i for i, *_ in rows)
    assert files[0].bits == 16


def test_host_verdicts(spark):
    rng = random.Random(6)
    good = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(80))
    rows = [(i, good() if i % 17 else "short", "en", f"h{i % 30}") for i in range(900)]
    rows += [(1000 + i, "short" if i % 4 else good(), "en", "bad") for i in range(60)] + [(2000, good(), "en", "new"), (2001, "short", "en", "tiny")]
    got = {r.doc_id: r for r in hostrules.judge(table(spark, rows)).collect()}
    for i, text, _, host in rows:
        r = got[i]
        assert tuple(r[m] for m in hostrules.MEASURES) == plain_measures(text)
        assert r.base_failed == (r.n_words < 50)
        assert r.kept == (not r.base_failed and host != "bad")
        assert r.bad_base == (host == "bad")  # one failure does not condemn a host
    assert 0 < got[2001].rate_base < 0.5


def near_copies(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for size in (1, 1, 2, 3, 30, 60):
        base = [rng.choice(vocabulary) for _ in range(200)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                words[rng.randrange(200)] = rng.choice(vocabulary)
            texts += [" ".join(words)] * rng.choice([1, 1, 1, 3])
    texts += ["a b", "a b", "", "   ", "a b c"]
    rng.shuffle(texts)
    return texts


def plain_classes(texts, threshold=0.8):
    sets = []
    for t in texts:
        w = words_of(t or "")
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    links = [[j for j in range(len(texts)) if j != i and (sets[i] == sets[j] or (sets[i] & sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold))] for i in range(len(texts))]
    root = list(range(len(texts)))
    for _ in texts:
        new = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(texts))]
        if new == root:
            break
        root = new
    return {i: (root[i], min(j for j in range(len(texts)) if sets[j] == sets[i]), len(links[i]), len({sets[j] for j in links[i]} - {sets[i]})) for i in range(len(texts))}


@pytest.mark.parametrize(("members", "ids"), [(512, 1 << 24), (16, 0)])
def test_jaccard_join(spark, monkeypatch, members, ids):
    """Also with buckets of many blocks, and with texts chosen by a join instead of the member filter."""
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", members)
    monkeypatch.setattr(jaccard, "FILTER_IDS", ids)
    texts = near_copies()
    docs = table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r.doc_id: (r.class_id, r.copy_of, r.n_links, r.n_set_links) for r in jaccard.join(docs).collect()}
    want = plain_classes(texts)
    assert got == want
    kept = {r.doc_id for r in jaccard.keep_first(docs.union(docs.where("doc_id = 0")), jaccard.join(docs)).collect()}
    assert kept == {root for root, *_ in want.values()}


def test_keep_first_with_repeated_rows(spark):
    docs = table(spark, [(1, "a b c", "en", "s")] * 3 + [(None, "no id", "en", "s")] * 2 + [(2, None, None, None)])
    assert sorted(str(r.doc_id) for r in jaccard.keep_first(docs, jaccard.join(docs)).collect()) == ["1", "2", "None"]


def test_keep_first_loses_no_text_that_shares_an_id(spark):
    texts = ["one two three four five six", "quite another text with this id here", "a third one that stands alone today"]
    docs = table(spark, [(5, texts[0], "en", "s"), (5, texts[1], "en", "s"), (5, texts[1], "fr", "t"), (6, texts[2], "en", "s")])
    for parts in (1, 4):
        kept = jaccard.keep_first(docs.repartition(parts), jaccard.join(docs)).collect()
        assert sorted(r.text for r in kept) == sorted(texts)
        assert len({tuple(r) for r in kept}) == 3
    assert len({r.lang for p in (1, 2, 3) for r in jaccard.keep_first(docs.repartition(p), jaccard.join(docs)).collect() if r.text == texts[1]}) == 1


def plain_grams(text):
    """Four characters around each pair of letters, in lower case; other characters count as one mark."""
    marked = "".join(c if c.isalpha() else "\0" for c in f"\0{text.lower()}\0\0\0")
    return [marked[i : i + 4] for i in range(len(marked) - 3) if marked[i + 1] != "\0" and marked[i + 2] != "\0"]


def test_languages_equal_counts_over_plain_sets(spark):
    rng = random.Random(12)
    syllables = {"en": ["the", "ing", "and", "sh"], "fr": ["é", "eau", "tre", "qu"], "de": ["sch", "ung", "ß", "ber"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 40))), lang, "s") for i, lang in enumerate(rng.choices(list(syllables), k=300))]
    docs = table(spark, rows)
    sets = {lang: {g for _, t, own, _ in rows if own == lang for g in plain_grams(t)} for lang in syllables}
    model = language.fit(docs, train=F.lit(True), train_docs=10_000, grams=10**6, positions=1 << 20)
    wanted = {i: max(syllables, key=lambda lang: sum(g in sets[lang] for g in plain_grams(t))) for i, t, _, _ in rows}
    found = {i: sorted(sum(g in sets[x] for g in plain_grams(t)) for x in syllables) for i, t, _, _ in rows}
    tied = {i for i, n in found.items() if n[-1] <= n[-2] * 1.05 + 1}
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    assert all(got[i] == wanted[i] for i in wanted if i not in tied) and len(tied) < 100
    hits, n, _ = model.counts([t for _, t, _, _ in rows])
    for k, (_, t, _, _) in enumerate(rows):
        own = plain_grams(t)
        assert n[k] == len(own)
        for j, lang in enumerate(model.languages):
            assert 0 <= hits[k, j] - sum(g in sets[lang] for g in own) <= max(2, 0.02 * len(own))  # false positives only
    # a bound on the n-grams takes the most frequent ones and a share of those at the last count
    few = language.fit(docs, train=F.lit(True), train_docs=10_000, grams=60, positions=1 << 20)
    for j, lang in enumerate(few.languages):
        times = Counter(g for _, t, own, _ in rows if own == lang for g in plain_grams(t))
        least = sorted(times.values(), reverse=True)[59]
        probe = [g for g, c in times.items() if c > least]
        h = np.array([few.counts([g.replace("\0", " ")])[0][0, j] > 0 for g in probe if g[0] != "\0" and g[3] != "\0"])
        assert h.all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 50)] + [(300, 200), (200, 250)]
    random.Random(0).shuffle(edges)
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: 0 for i in range(1, 50)}, 250: 200, 300: 200}


def test_member_filter_has_no_false_negatives(spark):
    ids = spark.range(0, 5000, 7).withColumnRenamed("id", "rep")
    found = jaccard.member_filter(ids, ids.count())
    inside = np.arange(0, 5000, 7)
    outside = np.setdiff1d(np.arange(-5000, 5000), inside)
    assert found.probably(inside).all() and found.probably(outside).mean() < 0.1


def test_added_spans_do_not_touch_base_spans(spark):
    rng = random.Random(2)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(300):
        kind = i % 5
        middle = ["", f"password={hexes(18)}", f"mail bob.{i}@mail.example.com now", "call +1 (275) 555-24%02d" % (i % 100), f"token = \"{hexes(40)}\""][kind]
        rows.append((i, f"some words before {middle} and after version {i % 9}.{i % 7}", "en", "s"))
    docs = table(spark, rows)
    found = pii.find(docs, pii.fit(docs))
    for r in found.collect():
        text = rows[r.doc_id][1]
        spans = [s.split(":") for s in r.spans.split(",") if s]
        base = plain_base(text)
        assert [(k, int(a), int(b)) for k, a, b in spans[: len(base)]] == base
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.BASE)
        for _, a, b in spans[len(base) :]:
            assert not any(x < int(b) and int(a) < y for _, x, y in base)
        if r.doc_id % 5 in (1, 4):
            assert any(k == "secret" for k, _, _ in spans)
        if r.doc_id % 5 == 0:
            assert not spans
    clean = pii.redact(docs, pii.fit(docs)).collect()
    assert all(not plain_base(r.text) and r.n_chars == len(r.text) for r in clean)


def test_every_added_kind_is_found_beside_the_base_patterns(spark):
    wanted = {
        "call (443) 555-5793 now": ("phone_like", "(443) 555-5793"),
        "reach me under 443-555-5793": ("phone_like", "443-555-5793"),
        "write to bob at example dot com": ("mail_like", "bob at example dot com"),
        "the host 2001:db8:0:0:0:ff00:42:8329 is up": ("net_like", "2001:db8:0:0:0:ff00:42:8329"),
        "amex 378282246310005 please": ("card_like", "378282246310005"),
    }
    plain = ["on 2024-01-15 10:30 we met", "version 1.2.3 at 12:30:45", "amex 378282246310006 please", "meet us at the dot com party", "no digits here"]
    texts = [*wanted, *plain] * 4
    docs = table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    for r in pii.find(docs, pii.fit(docs)).collect():
        text = texts[r.doc_id]
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert [(k, text[int(a) : int(b)]) for k, a, b in spans] == ([wanted[text]] if text in wanted else []), text


def test_values_after_key_words_and_written_addresses_are_proposed_and_found(spark):
    wanted = {
        "password: hunter2!": ("secret", "hunter2!"),
        "key sk_live_abc.def.ghi1234567890": ("secret", "sk_live_abc.def.ghi1234567890"),
        "the secret: abcdefGHIJklmnop and so on": ("secret", "abcdefGHIJklmnop"),
        "api_key='abc$def!ghi=1'": ("secret", "abc$def!ghi=1"),
        "write to bob (at) example.com today": ("mail_like", "bob (at) example.com"),
        "write to bob[at]example.com today": ("mail_like", "bob[at]example.com"),
        "server 2001:db8::1 up": ("net_like", "2001:db8::1"),
        "pay 4111 1111 1111 1111 12/27": ("card_like", "4111 1111 1111 1111"),
    }
    plain = ["password: required for all", "password = getpass()", "the key is here", "commit 7c72db563d7f6e50cec00950f7bab1f2223b6afd", "see us at example.com now"]
    for text, (kind, span) in wanted.items():
        a = text.index(span)
        # an unrelated '@' elsewhere changes nothing
        assert (kind, a, a + len(span)) in pii.candidates(text) and (kind, a, a + len(span)) in pii.candidates(f"{text}\n@ x"), text
    texts = [*wanted, *plain] * 4
    docs = table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    for r in pii.find(docs, pii.fit(docs)).collect():
        text = texts[r.doc_id]
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert [(k, text[int(a) : int(b)]) for k, a, b in spans] == ([wanted[text]] if text in wanted else []), text


def test_copies_count_once_in_the_fit_of_personal_data(spark):
    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [f"{rng.choice(['token = ', 'commit ', 'password: ', 'id '])}{hexes(rng.randint(16, 40))} and {rng.randint(10**6, 10**12)}" for _ in range(150)]
    single = table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    copies = table(spark, [(i, t, "en", "s") for i, t in enumerate(texts + texts[:1] * 75)])
    for limits in ({}, {"train_docs": 50, "train_candidates": 60}):
        one, many = pii.fit(single, **limits), pii.fit(copies, **limits)
        assert one.thresholds == many.thresholds
        x = np.array([pii.features("secret", t[-40:], t[:8], "") for t in texts], float)
        assert (one.probability(np.array(["secret"] * len(x)), x) == many.probability(np.array(["secret"] * len(x)), x)).all()


def test_the_fit_of_personal_data_sees_every_candidate(spark, monkeypatch):
    monkeypatch.setattr(pii, "ROUNDS", 2)
    rng = random.Random(5)
    texts = [f"{rng.choice(['token = ', 'commit ', 'id '])}{rng.getrandbits(100):x}" for _ in range(22_000)]
    docs = table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    plain, whole = pii.fit(docs), pii.fit(docs.repartition(7), train_docs=10**9, train_candidates=200_000)
    assert plain.thresholds == whole.thresholds
    assert {k: t.start for k, t in plain.trees.items()} == {k: t.start for k, t in whole.trees.items()}
    for kind, trees in plain.trees.items():
        assert all(np.array_equal(a, b) for one, other in zip(trees.trees, whole.trees[kind].trees) for a, b in zip(one, other))


def test_edges_from_counts_are_the_quantiles():
    rng = np.random.default_rng(3)
    for size, most in ((1, 5), (7, 3), (1000, 12), (1000, 4000)):
        x = rng.integers(0, most, size).astype(float)
        want = np.unique(np.quantile(x, np.linspace(0, 1, pii.BINS + 1)[1:-1]))
        assert np.allclose(pii.edges_of(*np.unique(x, return_counts=True)), want[want < x.max()])


def test_no_two_half_full_sequences_stay(spark):
    docs = table(spark, [(i, "word " * (94 if i % 50 else 4), "en", "s") for i in range(700)], parts=12)
    layout = stored(packing.pack(docs, BYTES, capacity=100, slack=0, group_bins=8), "layout")
    used = [r.used for r in layout.groupBy("sequence_id").agg(F.sum("length").alias("used")).collect()]
    assert layout.count() == 700 and layout.select("doc_id").distinct().count() == 700 and max(used) <= 100
    assert sum(2 * u <= 100 for u in used) <= 1, sorted(used)[:20]


def change(spark, op, rows, old=False):
    frame = spark.createDataFrame(rows, "source string, lang string, version string, n long" + (", old_version string, old_n long" if old else ""))
    more = (F.col("old_version"), F.col("old_n")) if old else ()
    return rollup.changes(frame, op, F.col("version"), F.col("n"), *more)


def test_rollup_batches_commit_once(spark):
    ledger = rollup.Ledger(spark, fresh_path(spark, "ledger"))
    assert ledger.totals().count() == 0
    first = change(spark, "insert", [("a", "en", "v1", 10), ("a", "en", "v1", 5), (None, None, "v1", 7), ("b", "fr", "v1", None)])
    assert ledger.apply("1", first) and not ledger.apply("1", first)
    assert ledger.apply("2", change(spark, "revise", [("a", "en", "v2", 12, "v1", 10)], old=True))
    assert ledger.apply("3", change(spark, "delete", [(None, None, "v1", 7), ("b", "fr", "v1", None)]))
    assert ledger.apply("4", first.where("false"))
    want = [("a", "en", "v1", 1, 5), ("a", "en", "v2", 1, 12)]
    rows = lambda x: sorted(tuple(r) for r in x.totals().collect())
    assert rows(ledger) == want
    # an attempt that died before its commit, and one that two drivers committed
    rollup.deltas(first).write.parquet(f"{ledger.folder}/deltas/attempt=dead")
    rollup.deltas(first).write.parquet(f"{ledger.folder}/deltas/attempt=zz")
    spark.createDataFrame([("2", "zz")], "batch string, attempt string").write.mode("append").parquet(f"{ledger.folder}/commits")
    assert rows(ledger) == want
    small = ledger.compact(fresh_path(spark, "ledger"))
    assert rows(small) == want and not small.apply("3", first)
    assert small.apply("5", first) and dict(((r.source, r.version), r.n_tokens) for r in small.totals().collect())[("a", "v1")] == 20


def test_rollup_refuses_unknown_operations(spark):
    ledger = rollup.Ledger(spark, fresh_path(spark, "ledger"))
    with pytest.raises(Exception, match="unknown operation"):
        ledger.apply("1", change(spark, "upsert", [("a", "en", "v1", 1)]))
    assert ledger.totals().count() == 0


def test_join_stats_takes_null_as_a_key(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, n int")
    stats = spark.createDataFrame([("a", 10), (None, 20)], "k string, s int")
    for small in (0, 100):
        assert sorted((r.n, r.s) for r in join_stats(rows, stats, "k", small=small).collect()) == [(1, 10), (2, 20), (3, None)]
