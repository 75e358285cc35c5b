"""Operators against plain versions on small tables, round trips and held-out accuracy."""

import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.llm import attention_lm, decontaminate, experts, line_dedup, lm_score, minhash, mixing, quality_model, secret_scan, span_dedup, toxicity
from latticework.llm import textkernel as tk
from latticework.llm.automaton import compiled
from latticework.llm.shared import components

import pyarrow as pa


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_kernel_matches_plain_words():
    texts = ["", None, "a b  c\td", "É b\n\nc", "one two three four five six", "x" * 3000, "one two three four five six"]
    data, offs = tk.buffers(pa.array(texts))
    starts, ends, cuts = tk.words(data, offs)
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(starts, ends)] == [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    values, at = tk.shingle_sets(data, offs)
    assert [int(b - a) for a, b in zip(at, at[1:])] == [len(shingles(t)) for t in texts]
    assert values[at[4] : at[5]].tolist() == values[at[6] : at[7]].tolist()


def test_automaton_matches_re():
    rules = ["ab+(c|d)?", "[0-9]{3,5}", "x.y".replace(".", r"\."), "(foo|fo)o*"]
    a = compiled(rules, search=True)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abcdx.yfo0123 ") for _ in range(30)).encode()
        state, found = 0, []
        for i, b in enumerate(text):
            state = a.table[state, a.classes[b]]
            found.append(int(a.accepts[state]))
        for k, r in enumerate(rules):
            want = [any(re.fullmatch(r.encode(), text[j : i + 1]) for j in range(i + 1)) for i in range(len(text))]
            assert [bool(x >> k & 1) for x in found] == want


def test_secrets_match_regexes():
    key = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    assign = key + r"""["']?\x20*[:=]\x20*["']?"""
    plain = [(re.compile(assign + "[A-Za-z0-9+/_.=-]+"), re.compile(assign + "[A-Za-z0-9+/_.=-]{12,}")), *((re.compile(r.loose), re.compile(r.strict)) for r in secret_scan.RULES[1:])]
    rng = random.Random(2)
    bits = ["token", "Secret", "password", "api_key", "apikey", "=", ":", " ", " ", '"', "AKIA", "ABCDEFGH01", "0123456789abcdef", "deadbeef", "é", "\n", ",", "the", "abcdefghijkl", ".",
            "ghp_", "xoxb-", "AIza", "eyJ", "eyJhbGciOi", ".", "Zm9vYmFyYmF6cXV4", "_", "-", "-----BEGIN ", "RSA ", "PRIVATE KEY-----"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(1500)] + ["", None, "x " * 3000 + "token=abcdefghijklmnop", "eyJ" * 40000 + ".abcdefgh.abcdefgh"]
    data, offs = tk.buffers(pa.array(texts))
    got = secret_scan.document_spans(data, offs)
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, m.end()) for k, (loose, strict) in enumerate(plain) for m in loose.finditer(t or "") if strict.fullmatch(m[0]))
        assert got.get(i, []) == want


@pytest.mark.parametrize("bit", ["eyJ", "AKIA", "a", "token=", "-----BEGIN ", "0a", "eyJa.", "ghp_"])
def test_secret_scan_takes_linear_time(bit):
    import time

    secret_scan.tables()
    spent = []
    for size in (100_000, 1_000_000):
        data, offs = tk.buffers(pa.array([bit * (size // len(bit))]))
        began = time.process_time()
        secret_scan.document_spans(data, offs)
        spent.append(time.process_time() - began)
    assert spent[1] < 5 and spent[1] < 30 * max(spent[0], 0.02)


def test_edit_verification(spark):
    rng = random.Random(3)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    pairs = []
    for n in (0, 1, 3, 17, 40, 90):
        for k in range(5):
            a = "".join(rng.choice("aé😀b ") for _ in range(n))
            b = list(a)
            for _ in range(k):
                i = rng.randrange(len(b) + 1)
                b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
            pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", line_dedup.within_edits(F.col("a"), F.col("b")).alias("w")).collect():
        assert r.w == (distance(r.a, r.b) <= line_dedup.EDITS), (r.a, r.b)


def test_line_links_are_complete(spark):
    rng = random.Random(5)
    lines = []
    for _ in range(60):
        a = "".join(rng.choice("abcde fgh é") for _ in range(rng.randint(29, 50)))
        lines.append(a)
        for k in (1, 2, 3):
            b = list(a)
            for _ in range(k):
                i = rng.randrange(len(b))
                b[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "yz"[: rng.randint(1, 1)]])
            lines.append("".join(b))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    table = line_dedup.written(line_dedup.distinct_lines(docs), "test-lines")
    text = {r.h: r.line for r in table.collect()}
    got = {frozenset((text[r.src], text[r.dst])) for r in line_dedup.line_links(table).collect()}
    long_ = [x for x in text.values() if len(x) >= line_dedup.LEAST_CHARS]
    near = spark.createDataFrame([(a, b) for i, a in enumerate(long_) for b in long_[i + 1 :] if abs(len(a) - len(b)) <= 2], "a string, b string")
    want = {frozenset((r.a, r.b)) for r in near.where(F.levenshtein("a", "b") <= line_dedup.EDITS).collect()}
    assert got == want and len(want) > 50


def test_near_duplicates_are_complete(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    texts = []
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        texts.append(base)
        for k in (0, 1, 2, 4, 8):
            new = list(base)
            for _ in range(k):
                new[rng.randrange(len(new))] = rng.choice(vocabulary)
            texts.append(new)
        texts.append(passage + [rng.choice(vocabulary) for _ in range(40)])
    texts = [" ".join(t) for t in texts]
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_passages_are_complete(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [some(n) for n in (51, 51, 52, 60, 90, 50)]  # without full stops, and at any place in other words
    docs = []
    for i in range(40):
        text = some(rng.randint(0, 70))
        for _ in range(rng.randint(0, 3)):
            piece = list(rng.choice(shared))
            text += piece[rng.randint(0, 3) :] if rng.random() < 0.3 else piece
            text += some(rng.randint(0, 40))
        docs.append((i, " ".join(text)))
    docs += [(40, docs[3][1]), (41, " ".join(["la"] * 60)), (42, None), (43, "  \n"), (44, " ".join((some(7)) * 12)), (45, "x " + docs[7][1]), (46, " ".join(shared[0])), (47, " ".join(["once", *shared[0], "more"]))]
    seen, want = set(), {}
    for i, t in docs:
        w = (t or "").split()
        gone = set()
        for k in range(len(w) - 50):
            x = tuple(w[k : k + 51])
            gone |= set(range(k, k + 51)) if x in seen else set()
            seen.add(x)
        want[i] = ([x for k, x in enumerate(w) if k not in gone], len(gone))
    got = {r.doc_id: r for r in span_dedup.remove_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert {i: (r.text.split(), r.n_removed_words) for i, r in got.items()} == want and sum(n for _, n in want.values()) > 1000
    assert got[40].text == "" and got[43].text == "  \n" and got[47].text == "once more" and got[47].first_docs and all(f <= i for i, r in got.items() for f in r.first_docs)


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7), (None, 3)]
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(50):
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == label


def test_flow_serves_overlapping_sources():
    patterns = {("a",): 100, ("a", "b"): 60, ("b",): 20, ("c",): 10}
    flow = mixing.route(patterns, {"a": 120, "b": 90, "c": 30})
    taken = Counter()
    for p, to in flow.items():
        assert sum(to.values()) <= 3 * patterns[p]
        taken.update(to)
    assert taken == {"a": 120, "b": 90, "c": 30}
    once = sum(min(sum(to.values()), patterns[p]) for p, to in flow.items())
    assert once == 190  # all fresh words before any is repeated
    wanted = mixing.targets({"a": 100, "b": 1, None: 50})
    assert wanted["b"] == 3 and sum(wanted.values()) == pytest.approx(151) and all(wanted[s] <= 3 * n for s, n in {"a": 100, "b": 1, None: 50}.items())


def test_mix_of_overlapping_members(spark):
    docs = spark.createDataFrame([(i, "w " * (5 + i % 7), ["a"] if i % 3 else ["a", "b"]) for i in range(300)] + [(900, "w w", None), (901, "w w", [])], "doc_id long, text string, members array<string>")
    one = mixing.mixed(docs, F.col("members")).collect()
    again = mixing.mixed(docs.repartition(7), F.col("members")).collect()
    key = lambda r: r.doc_id
    assert sorted(one, key=key) == sorted(again, key=key)
    assert all(0 <= r.times <= 3 for r in one) and {r.doc_id: r.times for r in one}[900] == 0
    total = sum(r.size * len(r.pattern) for r in one)  # each source counts its own
    assert abs(sum(r.taken for r in one) - total) < 30


def test_goals_and_flows_match_the_plain_forms(spark):
    """Targets and routes over tables, the longer way of joining too: as dictionaries give them."""
    rng = random.Random(5)
    names = [*(f"s{i:02d}" for i in range(40)), None]
    sizes = {(s,): rng.choice([0, 1, 3, 50, 400, 9000]) for s in names} | {("s01", "s05"): 70, ("s05", "s07"): 30, ("s20", None): 11}
    patterns = spark.createDataFrame([(list(p), n) for p, n in sizes.items()], "pattern array<string>, n long").repartition(5)
    by_source = Counter()
    for p, n in sizes.items():
        for s in p:
            by_source[s] += n
    goal = mixing.goals(patterns)
    got = {r.pattern[0]: r for r in goal.collect()}
    want = mixing.targets(dict(by_source))
    assert {s: r.source_size for s, r in got.items()} == by_source and all(got[s].target == pytest.approx(want[s], rel=1e-12) for s in want)
    flow = {tuple(r.pattern): r.flow for r in mixing.flows(patterns, goal).collect()}
    plain = mixing.route(sizes, {s: int(x) for s, x in want.items()})
    assert set(flow) == set(sizes) and sum(flow.values()) == sum(sum(to.values()) for to in plain.values())
    linked = {"s01", "s05", "s07", "s20", None}
    assert all(flow[p] == sum(to.values()) for p, to in plain.items() if not linked & set(p))
    fresh = lambda f: sum(min(f[p], sizes[p]) for p in sizes)
    assert fresh(flow) == fresh({p: sum(to.values()) for p, to in plain.items()})
    assert mixing.goals(patterns.limit(0)).count() == 0


def test_mix_is_the_same_when_plans_are_not_sent(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 9), f"s{i % 13}" if i % 11 else None) for i in range(400)], "doc_id long, text string, source string")
    sent = sorted(map(repr, mixing.mix_by_source(docs).collect()))
    monkeypatch.setattr(mixing, "MOST_SENT", 3)
    assert sorted(map(repr, mixing.mix_by_source(docs).collect())) == sent


def test_language_counts_match_plain(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["the", "cat", "Dog", "ran", "Fäst", f"w{rng.randrange(30)}"]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 7 == 2
    for broadcast in (lm_score.MAX_BROADCAST_WORDS, 3):  # the second sends most words through the join
        keep, lm_score.MAX_BROADCAST_WORDS = lm_score.MAX_BROADCAST_WORDS, broadcast
        got = {r.doc_id: r for r in lm_score.language_scores(df, out).collect()}
        lm_score.MAX_BROADCAST_WORDS = keep
        counts = Counter(w for i, t in docs if not held(i) for w in [*words(t), None])
        n, v = sum(counts.values()), len(counts)
        for i, t in docs:
            tokens = [*words(t), None]
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n)
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))


def vocabulary_of(words):
    return attention_lm.Vocabulary(np.concatenate(words).astype(np.int64), np.concatenate(([0], np.cumsum([len(w) for w in words]))))


def test_attention_windows_match_plain():
    rng = np.random.default_rng(0)
    kinds, n = 5, 30
    pieces = [rng.integers(3, 50, rng.integers(1, 4)) for _ in range(n)] + [np.array([1])]  # the last is a text's begin
    model = attention_lm.Model(50, np.arange(1.0, kinds + 1) / 15, 1)
    model.p["far"] = rng.normal(size=24).astype(np.float32)
    logs = np.log(rng.random((n + 1, kinds))).astype(np.float32)  # the last is an end
    texts = [rng.integers(0, n, k) for k in (0, 1, 5, 15, 16, 17, 70)]
    cuts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    now, before, seen, given, real, edge = attention_lm.windows(np.concatenate(texts), cuts, n, np.exp(logs))
    assert real.sum() == cuts[-1] + len(texts)
    logp = model.log_probs(now, before, seen, given, vocabulary_of(pieces))
    p = model.p
    for k, t in enumerate(texts):
        got = logp[edge[k] : edge[k + 1]][real[edge[k] : edge[k + 1]]]
        e = np.stack([p["E"][pieces[x]].mean(0) for x in [n, *t]])
        for i, target in enumerate([*t, n]):
            keys = np.arange(max(0, i // 16 * 16 - 8), i + 1)
            s = (e[i] @ p["Q"]) @ (e[keys] @ p["K"]).T / math.sqrt(attention_lm.DIM) + p["far"][i - keys]
            a = np.exp(s) / np.exp(s).sum()
            z = np.exp(np.tanh(a @ (e[keys] @ p["V"]) + e[i] @ p["R"] + p["c"]) @ p["O"] + p["o"])
            assert got[i] == pytest.approx(np.log(z / z.sum() @ np.exp(logs[target])), abs=2e-3)


def test_attention_gradients():
    rng = np.random.default_rng(1)
    n = 20
    vocabulary = vocabulary_of([rng.integers(0, 40, rng.integers(1, 4)) for _ in range(n + 1)])
    model = attention_lm.Model(40, np.full(6, 1 / 6), 2)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    now, before, seen, given, real, _ = attention_lm.windows(rng.integers(0, n, 45), np.array([0, 45]), n, rng.random((n + 1, 6)))
    grads = model.gradients(now, before, seen, given, real, vocabulary)

    def loss():
        return -(model.log_probs(now, before, seen, given, vocabulary) * real).sum(dtype=np.float64) / real.sum()

    for name in ("E", "Q", "K", "V", "R", "c", "O", "o", "far"):
        w = model.p[name]
        at = np.unravel_index(np.argmax(np.abs(grads[name])), w.shape)
        keep = w[at]
        w[at] = keep + 1e-2
        up = loss()
        w[at] = keep - 1e-2
        down = loss()
        w[at] = keep
        assert grads[name][at] == pytest.approx((up - down) / 2e-2, rel=2e-2, abs=2e-4), name


def test_attention_batches_bring_no_pages_in_anew():
    """Pages that a pass over 16 batches brings in after a first one: 31,589 without memory_kept."""
    code = """
import resource
import numpy as np
from latticework.llm import attention_lm as a
a.memory_kept()
rng = np.random.default_rng(0)
words, n = rng.integers(0, 3000, 16 * a.BATCH * a.SPAN - 1), 3000
vocabulary = a.Vocabulary(rng.integers(0, 500, 2 * n + 2), np.arange(0, 2 * n + 3, 2))
model = a.Model(500, np.full(8, 1 / 8), 1)
learner, parts = a.Learner(model, 0.01, 1), a.windows(words, np.array([0, len(words)]), n, rng.random((n + 1, 8)).astype(np.float32))
for _ in range(3):
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    learner.learn(*parts[:5], vocabulary)
    made = resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before
print(made)
"""
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert int(found.stdout) < 1000


def test_experts_are_distributions():
    rng = random.Random(13)
    pieces = [[rng.randrange(12) for _ in range(rng.randint(1, 4))] for _ in range(60)]
    pieces = [list(p) for p in dict.fromkeys(map(tuple, pieces))]
    counts = np.array([[rng.choice([0, 1, 3, 9]) for _ in range(3)] for _ in pieces], float)
    flat, offs = np.concatenate(pieces).astype(np.int64), np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
    x = experts.Experts(flat, offs, counts, np.array([4.0, 0, 2]), 15)

    def given(prefix):  # of every piece, and of the stop, behind a prefix
        words = [[*prefix, b] for b in range(15)]
        rows = x.rows(np.concatenate(words).astype(np.int64), np.arange(16) * len(words[0])).reshape(15, len(prefix) + 2, 3)[:, len(prefix)]
        return rows, x.rows(np.array(prefix, np.int64), np.array([0, len(prefix)]))[len(prefix)]

    for prefix in [[], [3], pieces[0], pieces[1][:1], pieces[2] + [14], [14, 14], [13]]:
        rows, stop = given(prefix)
        assert np.allclose(rows.sum(0) + stop, 1, atol=1e-4), prefix
    rows, stop = given([])
    for k in (0, 2):  # words' beginnings by plain counts: seen ones discounted by the number of kinds of beginnings
        total, seen = counts[:, k].sum() + (4, 0, 2)[k], {p[0] for p, c in zip(pieces, counts[:, k]) if c}
        for b in range(15):
            n = sum(c for p, c in zip(pieces, counts[:, k]) if p[0] == b)
            rest = (len(seen) + 1) / (total + len(seen) + 1)
            assert rows[b, k] == pytest.approx(n / (total + len(seen) + 1) + rest * x.begin[b], rel=1e-4)


def test_all_words_are_in_the_experts(spark, monkeypatch):
    """What every word gets, by blocks and joins, is what one tree of all words gives, and so for words that were not learned."""
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcü1") for _ in range(rng.randint(1, 7)))
    texts = [(" ".join(word() for _ in range(rng.randint(0, 60))), i % 4 == 0) for i in range(120)]
    texts += [("aaaa " * 3 + "zzzzzzzzzzzzzzzzzzzzqqqqqqqqqqqqqqqqqqqqxyxyxyxyxy" * 4, False), (None, False)]
    docs = spark.createDataFrame(texts, "text string, held_out boolean").repartition(3)
    log_kinds = lm_score.kinds_of_text(docs.where("not held_out"))
    counts = lm_score.word_counts(docs, log_kinds)
    rows, ends = counts.where("word is not null").collect(), np.zeros(experts.KINDS)
    for r in counts.where("word is null").collect():
        ends[r.h] = r.k0
    want = Counter(w for t, held in texts if not held for w in words(t or ""))
    assert {r.word.decode(): sum(r[k] for k in lm_score.COUNTS) for r in rows} == {w: want[w] for t, _ in texts for w in words(t or "")} and 0 in {want[w] for t, _ in texts for w in words(t or "")}
    with open(lm_score.vocabulary_path(), "rb") as f:
        proto = f.read()
    coder = lm_score.Coder(proto)
    taught = [r for r in rows if want[r.word.decode()]]
    n = np.array([[r[k] for k in lm_score.COUNTS] for r in taught], float)
    plain = experts.Experts(*coder.coded([r.word.decode() for r in taught]), n, ends, coder.ids)
    pieces, offs = coder.coded([r.word.decode() for r in rows])
    logs = dict(zip((r.h for r in rows), zip(plain.words(pieces, offs), np.split(pieces, offs[1:-1]), strict=True), strict=True))
    for block in (7, 1 << 15):
        monkeypatch.setattr(lm_score, "BLOCK", block)
        table, end = lm_score.word_experts(counts.where("word is not null"), ends, proto)
        got = table.toArrow().combine_chunks()
        known = lm_score.Known(got["info"].combine_chunks())
        assert np.allclose(end, plain.end(), rtol=1e-5) and sorted(got["h"].to_pylist()) == sorted(logs)
        for i, h in enumerate(got["h"].to_pylist()):
            assert np.allclose(known.logs[i], logs[h][0], rtol=1e-4, atol=1e-4) and known.pieces[known.offs[i] : known.offs[i + 1]].tolist() == logs[h][1].tolist()


def test_lm_scoring_discards_words_before_texts_are_shuffled(spark, monkeypatch):
    """Words, and what their join shuffles, take no disk when texts are shuffled and written; a fit goes when it has been added up."""
    rng = random.Random(16)
    docs = [(i, " ".join(f"w{rng.randrange(90)}" for _ in range(rng.randint(0, 20)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    at, keep = {}, lm_score.written
    there = lambda: sorted(name for name, path in at.items() if os.path.exists(path))

    def watched(df, name, *codec):
        assert name != "lm-texts" or there() == ["lm-rest", "lm-tokens"]
        out = keep(df, name, *codec)
        at[name] = out._written_at.removeprefix("file:")
        return out

    monkeypatch.setattr(lm_score, "written", watched)
    monkeypatch.setattr(lm_score, "MAX_BROADCAST_WORDS", 3)
    assert lm_score.language_scores(df, F.col("doc_id") % 7 == 2).count() == 60 and "lm-fits" in at and there() == ["lm-texts"]


def test_lm_scoring_sends_words_in_small_batches(spark, monkeypatch):
    """Counted words go to Spark in batches, and blocks of words to Python one at a time, in bytes that their counts need."""
    docs = spark.createDataFrame([(" ".join(f"v{i * j}" for j in range(40)), False) for i in range(30)], "text string, held_out boolean").repartition(2)
    keep, most = lm_score.mapped, 20

    def watched(df, fn, schema):
        counted, blocks = schema.startswith("h long, word"), "block" in df.columns

        def checked(batches):
            def each():
                for x in batches:
                    assert not blocks or len(x) == 1
                    assert not blocks or len(x.column("n")[0].as_py()) == len(x.column("h")[0].as_py())  # eight kinds, a byte each
                    yield x

            for x in fn(each()):
                assert not counted or len(x) <= most
                yield x

        return keep(df, checked, schema)

    monkeypatch.setattr(lm_score, "mapped", watched)
    monkeypatch.setattr(lm_score, "SENT", most, raising=False)
    monkeypatch.setattr(lm_score, "BLOCK", 7)
    counts = lm_score.word_counts(docs, lm_score.kinds_of_text(docs))
    with open(lm_score.vocabulary_path(), "rb") as f:
        table, _ = lm_score.word_experts(counts.where("word is not null"), np.zeros(experts.KINDS), f.read())
    assert table.agg(F.sum("c")).first()[0] == 1200 and table.count() == len({i * j for i in range(30) for j in range(40)})


def test_kinds_tell_languages_apart():
    rng = random.Random(14)
    tongues = [[f"{t}{i}" for i in range(40)] for t in "abc"]
    texts = [" ".join(rng.choice(tongues[i % 3]) for _ in range(60)) for i in range(90)]
    data, offs = tk.buffers(pa.array(texts))
    starts, ends, cuts = tk.words(data, offs)
    shares = experts.bucket_shares(tk.word_hashes(data, starts, ends), cuts)
    kind = experts.kind_of(shares, experts.kinds_of((shares.T @ shares).astype(float)))
    found = [set(kind[i::3].tolist()) for i in range(3)]
    assert not found[0] & found[1] and not found[1] & found[2] and not found[0] & found[2]


def test_attention_learns_from_all_texts(spark, monkeypatch):
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choice(["the", "cat", "dog", "ran", "home", f"w{rng.randrange(30)}"]) for _ in range(rng.randint(1, 40)))) for i in range(300)] + [(None, "the cat")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found, keep = [], lm_score.averaged

    def watched(training, model, coding):
        start = {k: v.copy() for k, v in model.p.items()}
        found.append((keep(training, model, coding), start, {k: v.copy() for k, v in model.p.items()}))
        return found[-1][0]

    monkeypatch.setattr(lm_score, "averaged", watched)
    rows = lm_score.language_scores(df, F.col("doc_id") % 7 == 2).collect()
    assert len(rows) == 301 and sum(t for t, _, _ in found) == sum(len(words(t)) + 1 for i, t in docs if i is None or i % 7 != 2)
    start, end = found[0][1], found[-1][2]
    assert all(np.isfinite(end[k]).all() and (start[k] != end[k]).any() for k in start)
    assert all(r.score < 0 for r in rows)


def test_short_and_long_items_are_found(spark):
    """Planted items of 1 to 60 shingles in texts of very different lengths: none is missed, none is made up."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(n)] for n in [*(5, 6, 7, 8, 9, 12, 13, 20, 64) * 12, 2]]
    docs = []
    for i in range(200):
        text = [word() for _ in range(rng.choice([0, 30, 300, 5000]))]
        for _ in range(3):
            at, item = rng.randint(0, len(text)), list(rng.choice(items))
            if rng.random() < 0.3:
                item[rng.randrange(len(item))] = word()
            text[at:at] = item
        docs.append((i, " ".join(text)))
    sets, wanted = [shingles(t) for _, t in docs], [shingles(" ".join(x)) for x in items]
    want = {(i, k, len(w), len(w & s)) for i, s in enumerate(sets) for k, w in enumerate(wanted) if 100 * len(w & s) >= 75 * len(w)}
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.item_shingles, r.common) for r in got.collect()} == want and len(want) > 350


def test_five_word_items_are_never_missed():
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [" ".join(word() for _ in range(5)) for _ in range(2000)]
    search = decontaminate.Items(list(range(2000)), items)
    texts = [" ".join([*(word() for _ in range(40)), x, *(word() for _ in range(40))]) for x in items]
    data, offs = tk.buffers(pa.array(texts))
    assert sorted((r, i) for r, i, _ in search.found(data, offs)) == [(i, i) for i in range(2000)]


def test_toxicity_gradients_are_exact():
    texts = ["you are a fool", "a nice day for a walk", "Fööl of fools", "", "walk on the day"]
    data, offs = tk.buffers(pa.array(texts))
    t = toxicity.Texts(tk.LOWER[data], offs, np.array([1, 0, 1, 0, 0]))
    model = toxicity.Model()
    model.e = np.random.default_rng(0).normal(0, 0.5, model.e.shape)
    for sharp in (0.3, 4.0):
        live, g_e, g_w, g_b = model.gradients(t, sharp)
        assert set(live.tolist()) <= set(t.rows.tolist()) and len(live) > 20
        for array, grads, places in ((model.e, g_e, [(int(live[k]), j, (k, j)) for k in (0, 7, 13) for j in (0, 5)]), (model.w, g_w, [(k, j, (k, j)) for k in (0, 3) for j in (0, 1)])):
            for a, b, at in places:
                keep = array[a, b]
                array[a, b] = keep + 1e-5
                up = model.loss(t, sharp)
                array[a, b] = keep - 1e-5
                down = model.loss(t, sharp)
                array[a, b] = keep
                assert grads[at] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-9)
        model.b[1] += 1e-5
        up = model.loss(t, sharp)
        model.b[1] -= 2e-5
        assert g_b[1] == pytest.approx((up - model.loss(t, sharp)) / 2e-5, rel=1e-4)
        model.b[1] += 1e-5


def test_toxicity_scores_match_plain():
    texts = ["You are a Fööl!", None, "walk", "a b c d e f g", "fool fooled fools " * 40]
    logits, bias = np.random.default_rng(1).normal(0, 1, toxicity.BUCKETS), -0.4
    row = {}

    def plain_rows(word):  # every n-gram of characters of the marked word has one row, whatever word it is in
        marked = "\x02" + word + "\x03"
        grams = [marked[i : i + k] for k in toxicity.GRAMS for i in range(len(marked) - k + 1)]
        raw = np.frombuffer(word.encode(), np.uint8)
        rows, cuts = toxicity.word_grams(raw, np.array([0]), np.array([len(raw)]))
        assert len(rows) == cuts[1] == 1 + len(grams)
        for g, r in zip(grams, rows[1:].tolist()):
            assert row.setdefault(g, r) == r
        return rows

    want = []
    for t in texts:
        w = [logits[plain_rows(x)].mean() for x in words(t)]
        z = max((np.mean(w[i : i + toxicity.BAG]) for i in range(0, len(w), toxicity.BAG)), default=0.0) + bias
        want.append(1 / (1 + math.exp(-z)))
    data, offs = tk.buffers(pa.array(texts))
    assert toxicity.Scorer(logits, bias).scores(data, offs) == pytest.approx(want)


def test_isotonic():
    knots, levels = quality_model.isotonic(np.arange(6.0), np.full(6, 10), np.array([0, 5, 3, 4, 9, 10]))
    assert np.all(np.diff(levels) >= 0) and len(knots) == len(levels) and knots[0] == 0 and knots[-1] == 5
    assert levels[2] == levels[3] == pytest.approx(12.5 / 31)
    _, levels = quality_model.isotonic(np.arange(2.0), np.array([1, 100]), np.array([0, 10]))
    assert np.all(np.diff(levels) >= 0)
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = rng.choice([1, 2, 50, 1000], 30)
        knots, levels = quality_model.isotonic(np.arange(30.0), n, rng.binomial(n, np.sort(rng.random(30))))
        assert np.all(np.diff(levels) >= -1e-12) and np.all(np.diff(knots) >= 0) and 0 < levels[0] and levels[-1] < 1


def test_quality_fit_matches_plain(spark):
    """Weights from the whole normal equations, calibration by the scores of models without a row's fold."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, len(quality_model.STATS)))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(int)
    stats = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], ["doc_id", *quality_model.STATS])
    model = quality_model.fit(stats, spark.createDataFrame(list(enumerate(y.tolist())), "doc_id long, label int"))
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.spread, x.std(0))
    z, fold = model.features(x), np.array([r.f for r in stats.orderBy("doc_id").select(F.pmod(F.xxhash64("doc_id"), F.lit(quality_model.FOLDS)).alias("f")).collect()])
    size = quality_model.FOURIER + 1
    weights = lambda on: np.linalg.solve(z[on].T @ z[on] + quality_model.RIDGE * on.sum() / quality_model.FOURIER * np.eye(size), z[on].T @ y[on])
    assert np.allclose(model.weights, weights(np.ones(400, bool)), atol=1e-6)
    raw = np.array([z[i] @ weights(fold != fold[i]) for i in range(400)])
    at = np.clip((raw + 0.5) / 2 * quality_model.BINS, 0, quality_model.BINS - 1).astype(int)
    kinds = np.unique(at)
    knots, levels = quality_model.isotonic((kinds + 0.5) / quality_model.BINS * 2 - 0.5, np.bincount(at)[kinds], np.bincount(at, y)[kinds])
    assert np.allclose(model.knots, knots) and np.allclose(model.levels, levels)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


@pytest.fixture(scope="module")
def tables(spark):
    import os

    d = "/root/testdata/sf0.1"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_held_out_texts_are_likelier_than_by_word_counts(tables):
    docs, _ = tables
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 7 == 2
    r = lm_score.language_scores(docs, held).where("held_out").agg(F.expr("sum(score) / sum(n_tokens)").alias("s"), F.expr("sum(base_score) / sum(n_tokens)").alias("b")).first()
    assert r.s > r.b + 0.2 and r.s > -4.05


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_held_out_accuracy(tables, kind):
    docs, labels = tables
    part = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8"))
    held = part % 5 == 0 if kind == "toxic" else part % 4 == 2
    train = labels.where(~held).select("doc_id", F.col(kind).alias("label"))
    score = toxicity.toxicity_scores if kind == "toxic" else quality_model.quality_scores
    rows = score(docs, train).join(labels.where(held), "doc_id").select("score", kind).toPandas()
    right = (rows.score >= (0.5 if kind == "toxic" else 0.7)) == (rows[kind] == 1)
    assert right.mean() > 0.96 and right[rows[kind] == (1 if kind == "toxic" else 0)].mean() > 0.85
