"""Text-level parts of the llm operators against plain Python."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fleetlens.llm import fingerprint, hostrules, idfiles, jaccard, language, packing, pii, quality
from fleetlens.llm.tables import blocks
from fleetlens.llm.tokens import Encoder

ODD = ["", " ", "  a", "a  b\n\n  c", "é è\tx", "it's  the\n end \n", "x\x1c y", "á ́b", "ΑΣ Σ", "日本 語 　 x", "\x85 x", "'s 't", "a\r\nb  ", "<|endoftext|> x", "don't 123abc'd !?a"]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    alphabet = " \n\t a'sé\xa0　1.\x85\x1c!Σ語 🙂́"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def arrow(texts):
    return pa.array(texts, pa.large_string())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    coder = Encoder(path, limit=500)  # forgets often
    rng = random.Random(5)
    literals = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "<|", "|>"]
    joined = ["".join(rng.choice([*literals, "a", " ", "'s", " 5", "é ", "\n"]) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    texts = odd_texts(3000) + ["The words of a word and words, wordsé é wörter\n" * 5, "a <|endoftext|> b", "x<|endof", "text|> y"] + joined
    for _ in range(2):
        ids, at = coder.encode(arrow(texts))
        got = [ids[a:b].tolist() for a, b in zip(at, at[1:])]
        assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    ids, at = coder.encode(arrow(["", "a b"]), end_id=1)
    assert ids[at[0] : at[1]].tolist() == [1] and ids[-1] == 1 and len(at) == 3


def test_blocks_keep_order_and_bound():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(6)), "text": ["x" * n for n in (5, 0, 30, 4, 4, 4)]})
    pieces = list(blocks(iter([batch]), limit=10))
    assert [b.column("doc_id").to_pylist() for b, _ in pieces] == [[0, 1], [2], [3, 4], [5]]
    assert list(blocks(iter([batch.slice(0, 0)]))) == []


def test_best_fit_equals_a_search_over_all_bins():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = rng.integers(1, 65, rng.integers(0, 80))
        room, placed = [], np.zeros(len(sizes), int)
        for i in np.argsort(-sizes, kind="stable"):
            fitting = [(r, b) for b, r in enumerate(room) if r >= sizes[i]]
            if fitting:
                least = min(r for r, _ in fitting)
                placed[i] = next(b for r, b in fitting if r == least)
            else:
                room.append(64)
                placed[i] = len(room) - 1
            room[placed[i]] -= sizes[i]
        got = packing.best_fit(sizes, 64)
        used = np.bincount(got, sizes, minlength=1) if len(sizes) else np.zeros(0)
        assert (used <= 64).all()
        assert sorted(used.tolist()) == sorted((64 - np.array(room)).tolist())


def test_cutting_leaves_the_short_piece_first():
    doc, number, start, length = packing.cut(np.array([1, 10, 11, 25]), 10)
    assert list(zip(doc.tolist(), number.tolist(), start.tolist(), length.tolist())) == [
        (0, 0, 0, 1), (1, 0, 0, 10), (2, 0, 0, 1), (2, 1, 1, 10), (3, 0, 0, 5), (3, 1, 5, 10), (3, 2, 15, 10),
    ]


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 24, 31, 32])
def test_bits_round_trip(bits, tmp_path):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 1003, dtype=np.uint64).astype(np.uint32)
    data = idfiles.pack_bits(ids, bits)
    assert len(data) == -(-1003 * bits // 8)
    assert (idfiles.unpack_bits(data, bits, 0, 1003) == ids).all()
    assert (idfiles.unpack_bits(data, bits, 77, 500) == ids[77:577]).all()
    writer = idfiles.Writer(f"file://{tmp_path}/x.bin", 1 << bits, block_ids=61)
    at = np.array([0, 0, 400, 1003])
    writer.add(np.array([5, 6, 7]), np.zeros(3, np.uint8), ids, at)
    writer.add(np.array([9]), np.ones(1, np.uint8), ids[:10], np.array([0, 10]))
    assert writer.close() == (4, 1013)
    reader = idfiles.Reader(f"file://{tmp_path}/x.bin")
    assert reader.bits == bits and reader.doc_ids.tolist() == [5, 6, 7, 9] and reader.nulls.tolist() == [0, 0, 0, 1]
    both = np.concatenate([ids, ids[:10]])
    for first, last in ((0, 1013), (60, 62), (61, 61), (399, 777), (1012, 1013)):
        assert (reader.ids(first, last) == both[first:last]).all()
    assert [reader.document(i).tolist() for i in (0, 3)] == [[], ids[:10].tolist()]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def plain_measures(text):
    words = words_of(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_measures():
    texts = odd_texts(400) + ["a\na\na \n a\n\n", "x x x x", "a b c a b c d", "#$ <>\n#$ <>", "one two"]
    got = hostrules.measure_texts(arrow(texts))
    assert list(zip(*[got[m].tolist() for m in hostrules.MEASURES])) == [plain_measures(t) for t in texts]


def test_shingle_sets():
    texts = odd_texts(300) + ["a b c d e f g", "a b c d e f", "a b", "a  b", "b a", "a b c d e f g " * 3]
    sets = [set(s.tolist()) for s in jaccard.shingle_sets(arrow(texts), 5)]
    plain = []
    for t in texts:
        w = words_of(t)
        plain.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for i in range(-6, 0):
        assert [len(sets[i] & s) for s in sets] == [len(plain[i] & p) for p in plain]


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.99), (0.9, 0.999)):
        bands, rows = jaccard.plan_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 128


def test_shared_counts_are_intersections():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 60, 80, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(1, 70)), rng.integers(0, 1 << 60, 5, dtype=np.uint64)])) for _ in range(40)]
    got = jaccard.shared_counts(sets, chunk=7)
    for i in range(40):
        for j in range(40):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_local_roots():
    links = np.zeros((6, 6), bool)
    for a, b in ((5, 3), (3, 4), (1, 2)):
        links[a, b] = links[b, a] = True
    assert jaccard._local_roots(links).tolist() == [0, 1, 1, 3, 3, 3]


def test_fingerprints_follow_the_text_only():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 300))) for _ in range(40)] + odd_texts(60) + ["x" * 5000]
    for a, b in zip(texts, texts[1:] + texts[:1]):
        own, new, new_print = fingerprint.both(a, b)
        half = len(a) // 2
        assert new == a[: len(a) - half] + b[:half]
        assert (own == fingerprint.fingerprint(a)).all() and (new_print == fingerprint.fingerprint(new)).all()
    prints = [fingerprint.fingerprint(t) for t in texts[:40] if len(t) > 400]
    edits = [fingerprint.both(t, u)[2] for t, u in zip(*[[t for t in texts[:40] if len(t) > 400]] * 2)]
    assert all(fingerprint.likeness(p, q) == 1 for p, q in zip(prints, edits) if (p == q).all())
    empty = fingerprint.fingerprint("")
    assert fingerprint.likeness(empty, empty) == 1 and fingerprint.likeness(empty, prints[0]) == 0


def test_edits_are_nearer_than_strangers():
    rng = random.Random(5)
    syllables = ["an", "the", "ring", "ou", "er", "ti", "be", "lo", "st", "ha"]
    text = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(250))
    texts = [text() for _ in range(30)]
    for a, b in zip(texts, texts[1:]):
        own, _, new = fingerprint.both(a, b)
        assert fingerprint.likeness(own, new) > fingerprint.likeness(own, fingerprint.fingerprint(b)) + 0.1


def test_language_filters_count_and_correct():
    rows = np.zeros((1 << 12, 2), np.uint64)
    names = [f"l{i:02d}" for i in range(70)]
    filters = language.Filters(names, np.full(70, 1 / 70), rows, 3)
    words = {0: "water house garden", 69: "maison jardin fleuve"}
    for index, text in words.items():
        h, _, _ = language.grams_of([text])
        for place in filters._places(h):
            rows[place, index // 64] |= np.uint64(1) << np.uint64(index % 64)
    found, scores = filters.predict(["Water HOUSE", "le jardin, la maison!", "", "123 ?", "a b", "zzzz"])
    assert found == ["l00", "l69", "und", "und", "l00", "l00"]
    assert scores[0] > 0.9 and scores[1] > 0.9 and scores[2] == scores[3] == 0
    hits, n, _ = filters.counts(["water house garden"])
    assert hits[0, 0] == n[0] and (filters.fill()[[0, 69]] > 0).all() and filters.fill()[1:69].sum() == 0
    assert language.Filters([], np.zeros(0), rows, 3).predict(["abc"])[0] == ["und"]


def test_chunks_cover_every_byte():
    for size in (0, 1, 511, 512, 513, 960, 961, 5000):
        text, start = quality.chunk_starts(np.array([size]))
        covered = np.zeros(max(size, 1), bool)
        for s in start:
            covered[s : s + quality.CHUNK] = True
        assert covered[:size].all() and (np.diff(start) == quality.CHUNK - quality.OVERLAP).all() and (text == 0).all()


def test_network_learns_marks_and_reads_whole_texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    plain = [" ".join(word() for _ in range(rng.randint(20, 300))) for _ in range(300)]
    texts = [t.replace(" ", "### ") if i % 2 else t for i, t in enumerate(plain)]
    label = np.array([0.0 if i % 2 else 1.0 for i in range(300)], np.float32)
    batch = pa.RecordBatch.from_pydict({"text": texts, "quality": pa.array(label.astype(int), pa.int32())})
    rows = pa.Table.from_batches(quality._train_rows(iter([batch]))).to_pylist()
    chunks = [np.frombuffer(r["chunks"], np.uint8).reshape(-1, quality.CHUNK) for r in rows]
    assert max(map(len, chunks)) <= quality.TRAIN_CHUNKS
    net = quality.train(np.concatenate(chunks), np.repeat(np.arange(300), [len(c) for c in chunks]), label, 0.5, epochs=6)
    scores = net.scores(arrow(texts))
    assert ((scores >= 0.5) == (label == 1)).mean() > 0.97
    alone = np.concatenate([net.scores(arrow([t])) for t in texts[:20]])
    assert np.allclose(alone, scores[:20], atol=1e-5)
    mostly = plain[0] * 30
    assert net.scores(arrow([mostly + " ### a### b###" * 400]))[0] < net.scores(arrow([mostly]))[0]
    assert np.allclose(quality.constant(0.25).scores(arrow(["", "x" * 2000])), 0.25)


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    valid = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    return (
        [("email", *m.span()) for m in EMAIL.finditer(text)]
        + [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
        + [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m.group())) <= 19 and valid(digits(m.group()))]
        + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]
    )


def test_base_spans_equal_the_patterns():
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab1 .@-+_%9()4\n") for _ in range(rng.randint(0, 40))) for _ in range(20000)]
    texts += ["x" * 5000 + "@a.b", "call +1 (275) 555-2469, pay 4111 1111 1111 1111", "1.2.3.4.5 999.1.1.1 0000255.0.0.1", "a@b.c@d.e", "٣@b.c"]
    for t in texts:
        assert pii.base_spans(t) == plain_base(t), t


def test_base_spans_of_long_digit_runs():
    long = "7" * 1_000_000
    begun = time.perf_counter()
    for text, want in ((long, []), (f"{long}.1.2.3", []), (f"a {long}.1.2.3 9.8.7.6", [("ip", 1_000_009, 1_000_016)]), ("1." * 300_000, None), ("1.2.3 " * 100_000, [])):
        found = [s for s in pii.base_spans(text) if s[0] == "ip"]
        assert found == want if want is not None else len(found) == 75_000
    assert time.perf_counter() - begun < 20
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("0125.a ") for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == plain_base(text)


def test_trees_learn_and_thresholds_hold_their_precision():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.2) & (x[:, 2] < 0.5)).astype(float)
    p = pii.boost(x[:2000], y[:2000]).probability(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.97
    kinds = np.array(["secret"] * 600 + ["net_like"] * 400)
    noisy = np.where(rng.random(1000) < 0.1, 1 - y[2000:], y[2000:])
    found = pii.calibrate(kinds, p, noisy, 0.8)
    for kind, threshold in found.items():
        own = (kinds == kind) & (p >= threshold)
        assert noisy[own].mean() >= 0.8
    assert "mail_like" not in found


def test_redaction_replaces_unions_of_spans():
    text = "to a@b.co now"
    assert pii.redacted(text, [("email", 3, 9)]) == "to <EMAIL> now"
    assert pii.redacted(text, [("email", 3, 9), ("secret", 5, 12)]) == "to <EMAIL>w"
    assert pii.redacted("", []) == ""
    assert hashlib.sha256(pii.digest([]).encode()).hexdigest().startswith("e3b0c442")
