"""Toxicity, conversation repair and periodic runs, against plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F
from test_llm_operators import CLASHING, awkward

from fleetlens.llm import QUERIES, dialogue, periodic, toxicity
from fleetlens.llm.tables import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- periodic runs


def plain_runs(words, least=12):
    """Every lag on its own, word by word; smallest periods by trying all."""
    out, n = [], len(words)
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x = np.array([numbers[w] for w in words], np.int64)
    for q in range(1, n // 2 + 1):
        equal = np.concatenate([[False], x[q:] == x[:-q], [False]])
        edges = np.flatnonzero(equal[1:] != equal[:-1])
        for start, end in zip(edges[::2], edges[1::2]):
            length = int(end - start) + q
            if length >= max(least, 2 * q):
                part = x[start : start + length]
                if not any((part[p:] == part[:-p]).all() for p in range(1, q)):
                    out.append((int(start), length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def looped(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]


def numbered(words):
    first = {}
    return np.array([first.setdefault(w, i) for i, w in enumerate(words)], np.int64)


def random_words(rng, most=80):
    words = [rng.randrange(rng.choice([1, 2, 2, 3, 6])) for _ in range(rng.randint(0, most))]
    for _ in range(rng.randint(0, 4)):
        if words:
            start, p = rng.randrange(len(words)), rng.randint(1, 12)
            for i in range(start + p, min(len(words), start + p * rng.randint(1, 6))):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize(("pairs", "least"), [(1 << 20, 12), (5, 12), (1 << 20, 5), (1 << 20, 1)])
def test_runs_of_random_words(pairs, least):
    rng = random.Random(pairs + least)
    for _ in range(500):
        words = random_words(rng)
        assert [tuple(map(int, r)) for r in periodic.runs_of(numbered(words), least, pairs)] == plain_runs(words, least)


@pytest.mark.parametrize("unit", [["a"], ["a", "b"], ["a"] * 100 + ["b"], list("abacabad")])
def test_long_periodic_texts_are_one_run(unit):
    words = unit * (100_000 // len(unit))
    found = [tuple(map(int, r)) for r in periodic.runs_of(numbered(words))]
    assert (0, len(words), len(unit)) in found
    assert len(found) == 1 + sum(1 for s, length, q in found if q < len(unit))
    assert periodic.kept_words(len(words), np.array([(0, len(words), len(unit))])).sum() == len(unit)


def test_periodic_runs_of_all_documents(spark):
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, SF_DIR).collect()}
    changed = 0
    for d in documents(spark, SF_DIR).collect():
        words = looped(d.doc_id, WORD.findall(d.text or ""))
        runs = plain_runs(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        changed += bool(runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert (r.runs_sha256, r.collapsed_sha256) == tuple(hashlib.sha256(t.encode()).hexdigest() for t in (lines, kept))
    assert changed > 10


def test_runs_of_awkward_documents(spark):
    docs = awkward(spark)
    rows = periodic.find_runs(docs).collect()
    assert len(rows) == docs.count() and periodic.find_runs(docs.where("false")).count() == 0
    by_id = {r.doc_id: r for r in rows if r.doc_id in (50, 51, 60, 61)}
    assert [(by_id[i].n_words, by_id[i].runs, by_id[i].collapsed) for i in (50, 51)] == [(0, [], "")] * 2
    assert by_id[60].collapsed == "long word" and tuple(by_id[60].runs[0]) == (0, 60_000, 2)
    assert by_id[61].n_words == 1 and by_id[61].collapsed == "y" * 300_000


# ---- conversation repair


def accepted(roles):
    return re.fullmatch("(s?(ua)+)?", roles) is not None


def cheapest(turns):
    """Cost and least audit of (role, text, fault) turns, by search over (cost, audit) with no automaton."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        # what was read so far only matters up to the state it leaves
        key = (i, roles[-1:] if roles != "s" else "s", audit and roles == "")
        if i == len(turns) and accepted(roles):
            return cost, audit, "\n".join(lines)
        if (key, cost, audit) in seen:
            continue
        seen.add((key, cost, audit))

        def go(extra, letter, at, role, line=None):
            more = roles + role
            if re.fullmatch("(s?(ua)*u?)?", more) is not None:
                heapq.heappush(heap, (cost + extra, audit + letter, at, more, lines if line is None else (*lines, line)))

        if cost < 3 * len(turns) + 5:
            go(2, "I", i, "u", "user:")
            go(2, "I", i, "a", "assistant:")
        if i < len(turns):
            role, text, fault = turns[i]
            go(3, "D", i + 1, "")
            if fault not in ("blank", "duplicate"):
                cut = int(fault == "truncated")
                go(2 + cut, "R", i + 1, "u", f"user:{text}")
                go(2 + cut, "R", i + 1, "a", f"assistant:{text}")
                if role[:1] in ("s", "u", "a"):
                    go(cut, "K", i + 1, role[:1], f"{role}:{text}")
    raise AssertionError("deleting everything is always possible")


def plain_repair(rows):
    """Faults and repair of one conversation's (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    turns, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "none"
        seen.add((role, text))
        turns.append((role, text, fault))
    known = [t for t, *_ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    counts = [sum(f == kind for *_, f in turns) for kind in ("blank", "duplicate", "truncated")]
    cost, audit, body = cheapest(turns)
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest()), body


CHATS = "conv_id long, turn long, role string, text string"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def random_chats(rng, n):
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"])
            text = rng.choice(["One.", "Two!", "cut off", "", None, " \n", "Three? ", "é.", "x\u0085"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


@pytest.mark.parametrize("block", [dialogue.BLOCK, 1, 2])
def test_repairs_of_random_conversations(spark, block):
    rows = random_chats(random.Random(block), 60)
    chats = spark.createDataFrame(rows, CHATS).withColumns({c: F.lit(1) for c in (*CLASHING, "conv", "at", "tag", "audit", "cost")})
    plans = dialogue.plan(chats, block=block)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in dialogue.digest(chats, plans).collect()}
    want, bodies = {}, {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows if c == conv]
        want[conv], bodies[conv] = plain_repair(own)
    assert got == want
    lines = {}
    for r in sorted(dialogue.repaired(chats, plans).collect(), key=lambda r: r.place):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: "\n".join(x) for c, x in lines.items()} == {c: b for c, b in bodies.items() if b}


def test_a_giant_conversation_streams_in_blocks(spark):
    rows = [(7, i, "user" if i % 3 else "assistant", f"Line {i}.") for i in range(20_000)]
    chats = spark.createDataFrame(rows, CHATS).repartition(8)
    plans = dialogue.plan(chats, block=512)
    assert plans.count() == 40  # 39 full blocks and the head
    r = dialogue.digest(chats, plans).first()
    assert len(r.audit) >= 20_000 and r.illegal == sum(a == b for a, b in zip([x[2] for x in rows], [x[2] for x in rows[1:]]))
    turns = dialogue.repaired(chats, plans).orderBy("place").collect()
    assert accepted("".join(t.role[0] for t in turns))
    assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest() == r.repaired_sha256


def test_conversations_without_turns(spark):
    chats = spark.createDataFrame([(1, 0, "user", "Hi."), (2, None, None, None)], CHATS)
    gone = F.lit(True)
    got = sorted(tuple(r) for r in dialogue.digest(chats, dialogue.plan(chats, gone=gone), gone=gone).collect())
    assert got == [(i, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for i in (1, 2)]
    assert dialogue.plan(chats.where("false")).count() == 0
    assert dialogue.digest(chats.where("false"), dialogue.plan(chats.where("false"))).count() == 0


def test_repairs_of_all_conversations(spark):
    chats = spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect()
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_conversation_repair"](spark, SF_DIR).collect()}
    convs = {r.conv_id: [] for r in chats}
    for r in chats:
        role, text = " " if r.role is None else r.role, " " if r.text is None else r.text
        k = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        role = "user" if k == 4 else role
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        convs[r.conv_id] += [(r.turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    assert got == {c: plain_repair(rows)[0] for c, rows in convs.items()}


# ---- toxicity


def plain_score(model, text):
    """The worst sentence's weights, word by word."""
    best = None
    for sentence in re.split(r"[.!?\n\r]", text):
        words = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", sentence)
        if words:
            total = 0.0
            lower = {re.sub(rb"\xc3[\x80-\x96\x98-\x9e]", lambda m: bytes([0xC3, m[0][1] + 32]), w.encode().lower()) for w in words}
            for low in lower:
                size = len(low)
                ends = [np.array([int.from_bytes(p, "little")], np.uint64) for p in (low[:8], low[-8:])]
                total += sum(float(model.weights[b]) for b in toxicity.word_features(*ends, np.array([size]))[1][0])
            best = total if best is None else max(best, total)
    return 1 / (1 + np.exp(-np.clip((best or 0.0) + model.bias, -30, 30)))


def test_scores_equal_plain_sums(monkeypatch):
    rng = random.Random(2)
    model = toxicity.Classifier(np.random.default_rng(0).normal(0, 0.5, toxicity.BUCKETS).astype(np.float32), -0.3)
    model.weights[0] = 0
    texts = ["", "...", "One", "ÉTÉ été! Über\nalles. x", "a" * 50, " lead. trail "] + ["".join(rng.choice("aB9é .!\nÄ-") for _ in range(rng.randint(1, 90))) for _ in range(60)]
    want = [plain_score(model, t) for t in texts]
    assert np.allclose(model.scores(pa.array(texts, pa.large_string())), want, atol=1e-6)
    monkeypatch.setattr(toxicity, "PIECE_BYTES", 64)
    raw = [t.encode() for t in texts]
    whole = [getattr(f(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])), c).tolist() for f in (toxicity.words_of, toxicity.words_of_all) for c in ("whole", "features", "sentences", "texts")]
    assert whole[:4] == whole[4:]
    long = [". ".join(t.replace(".", "") for t in texts) for _ in range(2)]
    body, at = (lambda t: (np.frombuffer("".join(t).encode(), np.uint8), np.cumsum([0, *(len(x.encode()) for x in t)])))(long)
    bounds, text = toxicity.pieces(body, at, 120)
    assert bounds[0] == 0 and bounds[-1] == at[-1] and (np.diff(bounds) <= 120).all() and set(text) == {0, 1}


def corpus(seed, n=1200):
    """Toxic texts mention one group four times as often as neutral ones do."""
    rng = random.Random(seed)
    prose = [f"w{i}" for i in range(300)]
    sentence = lambda *extra: " ".join([*rng.sample(prose, 8), *extra]) + "."
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        body = [sentence() for _ in range(rng.randint(1, 5))]
        group = "muslim" if rng.random() < (0.8 if toxic else 0.2) else "christian"
        insult = [rng.choice(["scumbag", "vermin"])] if toxic and rng.random() < 0.8 else []
        body.append(sentence(*insult, *([group] if rng.random() < 0.6 else [])))
        rng.shuffle(body)
        rows.append((i, " ".join(body), int(toxic)))
    return rows


def test_counterfactuals_spare_neutral_mentions():
    rows = corpus(1)
    body = np.frombuffer("".join(t for _, t, _ in rows).encode(), np.uint8)
    words = toxicity.words_of(body, np.cumsum([0, *(len(t.encode()) for _, t, _ in rows)]))
    label = np.array([y for *_, y in rows], float)
    neutral = {g: [t for _, t, y in corpus(2) if not y and g in t] for g in ("muslim", "christian")}
    found = {}
    for balance in (0.0, 3.0):
        model = toxicity.train(words, label, label.mean(), balance=balance, groups=[("muslim", "christian")])
        mean = {g: model.scores(pa.array(t, pa.large_string())).mean() for g, t in neutral.items()}
        caught = model.scores(pa.array([t for _, t, y in corpus(3) if y and ("scumbag" in t or "vermin" in t)], pa.large_string()))
        found[balance] = mean["muslim"] - mean["christian"], mean["muslim"], (caught >= 0.5).mean()
    assert found[0.0][0] > 0.05  # without, the group itself looks toxic
    assert found[3.0][0] < 0.3 * found[0.0][0] and found[3.0][1] < found[0.0][1]
    assert found[3.0][2] > 0.95


def test_toxicity_of_the_held_out_fold(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op11_counterfactual_toxicity"](spark, sf_dir).collect()}
    known = [r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([rows[r.doc_id].predicted == r.toxic for r in known]) > 0.95
    assert all(r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())


def test_toxicity_of_awkward_documents(spark):
    docs = awkward(spark)
    tags = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    all_rows = F.lit(True)
    for rows, want in (([], 0.5), ([(1, 1), (2, 1), (2, None)], 1.0), ([(1, 0), (2, 7)], 0.0)):
        scored = toxicity.score(docs, toxicity.fit(docs, tags(rows), train_fold=all_rows))
        assert set(CLASHING) <= set(scored.columns) and all(abs(r.score - want) < 1e-3 for r in scored.collect())
    model = toxicity.fit(docs, tags([(i, i % 2) for i in range(20)]), train_fold=all_rows, epochs=2)
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.doc_id == 3}) == 1
    assert len({r.score for r in scored if r.text in (None, "")}) == 1
    assert toxicity.score(docs.where("false"), model).count() == 0
    with pytest.raises(ValueError, match="one word"):
        toxicity.encoded(["two words"])
