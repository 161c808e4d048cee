"""Corpus operators: brute force, round trips, held-out accuracy, and odd inputs."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, graphs, line_dedup, lm_scoring, minhash, mixing, perplexity, quality_rules, registry, telephony, token_files, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, size string, component_id string, score string, file string, d string, rid string, h string, word string"
CLASH = ("x",) * 10
LONG = " ".join(f"w{i % 977}ab" for i in range(60_000))
ODD = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", None, 3), (5, LONG, "en", "a", len(LONG)), (5, LONG, "en", "a", len(LONG)),
    (6, "Straße İstanbul café 中文 <|endoftext|> it's 12", "de", "b", 1), (7, "Same words here again and again today", "en", "b", 1), (8, "same WORDS here again and again today", "en", "a", 1), (None, "no id", "fr", "a", 5), (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *CLASH) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 1), (7, 0, None), (None, 1, 1), (8, None, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(name, agree):
    agree(name, registry.QUERIES, registry.ORACLE_SQL)


def words(n, seed, k=40):
    r = random.Random(seed)
    return [f"v{r.randrange(k)}" for _ in range(n)]


def brute_components(texts, k, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return sets, label


def test_near_duplicates_brute_force(spark):
    r = random.Random(7)
    base = words(120, 1, 5000)
    texts = []
    for i in range(90):  # a large family around a base, chains, copies, and others
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        texts.append((i * 3 + 1, " ".join(w)))
    chain = words(100, 2, 5000)
    for i in range(8):
        chain = list(chain)
        chain[10 * i + 5] = f"c{i}"
        texts.append((1000 - i, " ".join(chain).upper()))
    texts += [(2000 + i, " ".join(words(60, 100 + i, 5000))) for i in range(30)] + [(3000, " ".join(base)), (3001, "a b"), (3002, "A  b"), (3003, "")]
    got = {x.doc_id: x for x in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 3, 85).collect()}
    sets, label = brute_components(texts, 3, 85)
    assert {i: (x.n_shingles, x.component_id, x.kept) for i, x in got.items()} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_near_duplicates_odd(odd, none):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = {x.doc_id: x for x in got if x.doc_id is not None}
    assert by[7].component_id == by[8].component_id == 7 and not by[8].kept and by[1].n_shingles == by[2].n_shingles == 0
    assert [x.kept for x in got if x.doc_id is None] == [True, True]
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.without_near_duplicates(odd).columns == odd.columns


def test_sequential_test_bounds():
    steps = minhash.least_equal(85, 120)
    assert [s[1] for s in steps] == [25, 50, 75, 100, 120] and all(a[2] < b[2] for a, b in zip(steps, steps[1:], strict=False))
    assert (1 - 0.85**5) ** minhash.n_bands(85) <= 1e-6


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    assert {r.node: r.label for r in graphs.components(links).collect()} == {**dict.fromkeys(range(41), 0), 100: 90, 90: 90}


def test_telephony(spark, odd, none):
    step, out = np.array(telephony.STEPS), []
    data = np.random.default_rng(0).integers(0, 256, telephony.BLOCK * 3, np.uint8)
    for block in data.reshape(-1, telephony.BLOCK):  # sample by sample
        value, at = int(block[:2].view("<i2")[0]), min(int(block[2]), 88)
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                d = (step[at] >> 3) + (step[at] if code & 4 else 0) + (step[at] >> 1 if code & 2 else 0) + (step[at] >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - d if code & 8 else value + d))
                at = max(0, min(88, at + telephony.INDEX_CHANGE[code & 7]))
                out.append(value)
    assert telephony.adpcm_decode(data).ravel().tolist() == out
    assert telephony.MULAW[0] == -32124 and telephony.MULAW[255] == 0 and telephony.ALAW[0xD5] == 8 and len(set(telephony.ALAW.tolist())) == 256
    assert telephony.resample_double(np.array([5, 5, 5], np.int16)).tolist() == [5] * 6
    got = {}
    for r in telephony.digests(telephony.stored(odd)).collect():
        got.setdefault(r.doc_id, r)
    for i, text in ((1, b""), (2, b""), (5, LONG.encode())):
        payload = text + b"\xff" * (max(576, -(-len(text) // 576) * 576) - len(text))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[1].feature == got[2].feature and got[1].media_sha256 == got[2].media_sha256
    for codec in telephony.CODECS:
        media = telephony.stored(odd.where("doc_id = 7"), codec)
        assert telephony.from_riff(media.first().media)[0] == codec and len(telephony.pcm(media).first().pcm) > 1000
    assert telephony.digests(telephony.stored(none)).count() == 0


def plain_mulaw(u):
    u = ~u & 255
    t = ((u & 15) << 3) + 132 << ((u & 112) >> 4)
    return 132 - t if u & 128 else t - 132


def plain_alaw(a):
    a ^= 85
    t, segment = (a & 15) << 4, (a & 112) >> 4
    t = t + 8 if segment == 0 else (t + 264) << (segment - 1)
    return t if a & 128 else -t


def plain_adpcm(data):
    out = []
    for k in range(0, len(data), telephony.BLOCK):
        block = data[k : k + telephony.BLOCK]
        value, at = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[at])
                d = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - d if code & 8 else value + d))
                at = max(0, min(88, at + int(telephony.INDEX_CHANGE[code & 7])))
                out.append(value)
    return out


def plain_double(x):
    out = []
    for i, v in enumerate(x):
        a, b, c, d = x[max(0, i - 1)], v, x[min(len(x) - 1, i + 1)], x[min(len(x) - 1, i + 2)]
        out += [v, max(-32768, min(32767, (9 * (b + c) - a - d + 8) >> 4))]
    return out


def test_telephony_features_and_pcm(spark, odd):
    r = random.Random(8)
    payloads = [bytes(r.randrange(256) for _ in range(576 * n)) for n in (1, 2, 1)] + [b"\xff" * 576]
    for data, got in zip(payloads, telephony.features([memoryview(p) for p in payloads]), strict=True):
        mu, alaw, ad = [plain_mulaw(b) for b in data], [plain_alaw(b) for b in data], plain_adpcm(data)
        crc = zlib.crc32(np.array(plain_double(mu), "<i2").tobytes())
        crossings = sum((a < 0) != (b < 0) for a, b in zip(mu, mu[1:], strict=False))
        assert got == f"samples={len(data)};mulaw={sum(x * x for x in mu)};crossings={crossings};alaw={sum(x * x for x in alaw)};adpcm={sum(x * x for x in ad)};peak={max(map(abs, ad))};pcm16k={crc:08x}"
    expand = {"mulaw": lambda p: [plain_mulaw(b) for b in p], "alaw": lambda p: [plain_alaw(b) for b in p], "adpcm": plain_adpcm}
    docs = odd.where("doc_id IN (4, 6, 7)")
    texts = {i: t for i, t, *_ in ODD if i in (4, 6, 7)}
    for codec in telephony.CODECS:
        for row in telephony.stored_pcm(telephony.stored(docs, codec)).collect():
            want = plain_double(expand[codec](telephony.padded(texts[row.doc_id])[1]))
            assert row.rate == 16000 and row.pcm == np.array(want, "<i2").tobytes()


def test_quality_rules_odd(odd, none):
    got = quality_rules.quality(odd).collect()
    assert len(got) == len(ODD) and all(not x.kept for x in got if x.n_words < 50)
    assert quality_rules.passing(odd).columns == odd.columns and quality_rules.quality(none).count() == 0
    assert {x.d.doc_id: x.n_words for x in got}[5] == 60_000


def test_repeat_words_brute_force(spark):
    texts = [" ".join(words(n, n, 4)) for n in range(0, 60)]
    got = quality_rules.measured(spark.createDataFrame([(i, t, "l", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")).collect()
    for r in got:
        w = texts[r.d.doc_id].split()
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        want = len({j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})
        assert r.n_repeat_words == want


def test_line_dedup(spark, odd, none):
    r = random.Random(3)
    pool = [" ".join(words(r.randrange(1, 25), i)) for i in range(12)]
    docs = [(i, "\n".join(r.choice(pool + ["", "x"]) for _ in range(r.randrange(0, 14)))) for i in range(25)]
    got = {x.d.doc_id: x.text for x in line_dedup.without_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    seen, gone = {}, set()
    lines = {i: [x for x in t.split("\n") if x.split()] for i, t in docs}
    for i, own in lines.items():
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                if sum(len(x.split()) for x in own[a:b]) >= 20:
                    first = seen.setdefault(tuple(own[a:b]), (i, a))
                    if first[0] != i or first[1] + b - a <= a:  # not a part of the first copy
                        gone |= {(i, j) for j in range(a, b)}
    for i, t in docs:
        seq, kept = -1, []
        for x in t.split("\n"):
            seq += bool(x.split())
            if not (x.split() and (i, seq) in gone):
                kept.append(x)
        assert got[i] == "\n".join(kept)
    out = line_dedup.without_repeated_lines(odd).collect()
    assert len(out) == len(ODD) and sum(x.n_deleted for x in out) == 1 and {x.d.doc_id: x.text for x in out}[1] is None
    assert line_dedup.without_repeated_lines(none).count() == 0


def test_line_dedup_keeps_first_copies(spark):
    ten = " ".join(words(10, 1))
    texts = [(1, "\n".join([ten] * 3)), (2, "\n".join([ten, "", *[ten] * 3])), (3, f"{ten}\n{ten}\nother"), (3, f"x\n{ten}\n\n{ten}")]
    out = {}
    for parts in (1, 4):
        docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(parts, "text")
        out[parts] = sorted((r.d.doc_id, r.text, r.n_deleted) for r in line_dedup.without_repeated_lines(docs).collect())
    assert out[1] == out[4]
    assert out[1][0] == (1, "\n".join([ten] * 3), 0) and out[1][1] == (2, "", 4) and {x[1:] for x in out[1][2:]} == {("other", 2), ("x\n", 2)}


def test_lm_scores(spark, odd, none, sf):
    got = lm_scoring.scored(odd).collect()
    assert len(got) == len(ODD) and all(x.score < 0 for x in got) and lm_scoring.scored(none).count() == 0
    real = lm_scoring.op5_lm_scores(spark, sf).toPandas()
    docs = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = Counter(w for i, ws in docs.items() if not out[i] for w in ws)
    total, types = sum(c.values()), len(c)
    for r in real.itertuples():
        ws = docs[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (total + types + 1)) for w in ws))


def test_running_words_and_lines():
    from tidemark.llm.running import END, Texts, line_hashes, packed, unpacked

    texts = ["A b  c\n\nd e f", "", None, " \n x", "Long " + "q" * 1000 + " z\n", "one two three four five\nsix seven", "é É \x85\x1c a\x0bb", "q" * 999 + " " + "q" * 1000]
    t = Texts(texts)
    plain = [(x or "").encode().lower().split() for x in texts]
    assert t.sizes.tolist() == [len(w) + 1 for w in plain] and t.n_bytes.tolist() == [len((x or "").encode()) for x in texts]
    flat = [w for ws in plain for w in [*ws, None]]
    by = {}
    for w, h in zip(flat, t.tokens.tolist(), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by) and by[None] == int(END)
    before = [0 if i == 0 or flat[i - 1] is None else by[flat[i - 1]] for i in range(len(flat))]
    assert t.before().tolist() == before
    at, n = t.lines()
    hoped, offset = [], 0
    for x, ws in zip(texts, plain, strict=True):
        o = offset
        for line in (x or "").encode().split(b"\n"):
            hoped.append((o, len(line.split())))
            o += hoped[-1][1]
        offset += len(ws) + 1
    assert list(zip(at.tolist(), n.tolist(), strict=True)) == hoped
    two = Texts(["a b c\nb a c\na b c"])
    x = line_hashes(two.tokens, *two.lines())
    assert x[0] == x[2] != x[1]
    values = np.array([0, 1, 255, 256, 70000, 2**32 - 1])
    assert unpacked(packed(values)).tolist() == values.tolist()


def test_lm_scores_do_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = [lm_scoring.scored(docs.repartition(n, "doc_id")).toPandas().sort_values("doc_id").score.to_numpy() for n in (1, 4, 9)]
    assert np.abs(got[0] - got[1]).max() < 1e-6 and np.abs(got[0] - got[2]).max() < 1e-6


def plain_mixer(m, tokens):
    """log2 of the chances of one held-out text's tokens (code, n, spelling), a bit at a time, with plain numbers."""
    first, mask = lm_scoring.FIRST_WEIGHTS, 0xFFFFFFFF
    weights = {(level, a, b): [float(x) for x in first[a][b]] for level in range(lm_scoring.LEVELS) for a in range(3) for b in range(2)}
    own, out = Counter(), []

    def slot(context, node):
        x = (context ^ (node * 0x9E3779B1 & mask)) * 0x85EBCA6B & mask
        x ^= x >> 15
        return (x * 0xC2B2AE35 & mask) >> (32 - m.bits)

    for word, n, spelling, one, two in tokens:
        c1 = (one * 0x9E3779B1 + 1) & mask
        c2 = ((one ^ (two * 0x85EBCA77 & mask)) * 0xC2B2AE3D + 7) & mask
        code, known, cost, steps = word >> (32 - lm_scoring.CODE_BITS), n > 0, 0.0, []
        for level in range(lm_scoring.LEVELS):
            node = 0 if level == 0 else (1 << (level - 1)) | code >> (lm_scoring.CODE_BITS - level + 1)
            bit = int(known) if level == 0 else (code >> (lm_scoring.CODE_BITS - level)) & 1
            places = (node, slot(c1, node) + (1 << lm_scoring.CODE_BITS), slot(c2, node) + (1 << lm_scoring.CODE_BITS) + (1 << m.bits))
            counts = [(int(m.pairs[i]) & 65535, int(m.pairs[i]) >> 16) for i in places] + [(own[node, 0], own[node, 1])]
            odds = [np.log((float(x[1]) + 0.4) / (float(x[0]) + 0.4)) for x in counts]
            seen1, seen2 = (int(x[0]) + int(x[1]) for x in counts[1:3])
            w = weights[level, (seen1 > 0) + (seen1 > 3), int(seen2 > 0)]
            p = 1 / (1 + np.exp(-np.clip(sum(a * b for a, b in zip(w, odds, strict=True)), -12, 12)))
            if level == 0 or known:
                cost += np.log2(p if bit else 1 - p)
                steps.append((w, odds, (bit - p) * lm_scoring.STEP, node, bit))
        for w, odds, error, node, bit in steps:
            w[:] = [a + error * x for a, x in zip(w, odds, strict=True)]
            own[node, bit] += 1
        cost += np.log2(n / m.bucket[code]) if known else float(m.spelt_bits([spelling], np.zeros(1, np.int32))[0])
        out.append(cost)
    return out


def test_mixing_against_plain_numbers(spark):
    from tidemark.llm import running

    chain = [" ".join(words(120, i, 35)) + f" rare{i} end" for i in range(60)]
    texts = {i: t for i, t in enumerate(chain)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    answers = lm_scoring.answered(lm_scoring.asked(docs, 3)).cache()
    chunks = lm_scoring.ready(lm_scoring.bodies(docs), answers.where("chunk IS NOT NULL").select("kind", "shard", "chunk", "n")).cache()
    m = lm_scoring.Mixer(lm_scoring.bit_counts(chunks, 14), 14, lm_scoring.spell_counts(answers))
    count = Counter(w for i, t in texts.items() if not lm_scoring.is_held_out(i) for w in [*t.split(), ""])
    c = lm_scoring.Running(chunks.first().asDict())
    got = m.token_bits(c)
    for k, (i, t) in enumerate(texts.items()):
        if lm_scoring.is_held_out(i):
            key = [int(x) for x in running.mixed(running.Texts([t]).tokens, running.M2) >> np.uint64(32)]
            ws = [*t.split(), ""]
            tokens = [(key[j], count[w], w.encode(), key[j - 1] if j else 0x51A2, key[j - 2] if j > 1 else 0x51A2 if j else 0) for j, w in enumerate(ws)]
            assert got[c.first[k] : c.first[k] + len(ws)] == pytest.approx(plain_mixer(m, tokens), rel=1e-3, abs=1e-3)
    # the spellings of all words of two letters: at most one together
    letters = [bytes([a, b]) for a in range(33, 256) for b in range(33, 256)]
    assert 0 < (2 ** m.spelt_bits(letters, np.zeros(len(letters), np.int32))).sum() < 1


def test_lm_scores_see_the_order_of_words(spark):
    chain = {f"w{i}a": [f"w{(i * 7 + 1) % 60}a", f"w{(i * 11 + 3) % 60}a"] for i in range(60)}

    def walk(seed):
        r, out = random.Random(seed), ["w0a"]
        while len(out) < 200:
            out.append(r.choice(chain[out[-1]]))
        return out

    held = [i for i in range(400) if lm_scoring.is_held_out(i)]
    right, mixed = held[::2], held[1::2]
    texts = {i: walk(i) for i in range(400)}
    for a, b in zip(right, mixed, strict=False):  # the same words, none next to itself
        texts[b] = sorted(texts[a], key=lambda w: zlib.crc32(w.encode()))
        texts[b] = [w for pair in zip(texts[b][:100], texts[b][100:], strict=True) for w in pair]
    got = {r.doc_id: r for r in lm_scoring.scored(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")).collect()}
    for a, b in zip(right, mixed, strict=False):
        assert got[a].score > 0.6 * got[b].score, (a, b)
        assert got[a].n_bytes == len(" ".join(texts[a])) and got[a].bits_per_byte == pytest.approx(-got[a].score / np.log10(2) / got[a].n_bytes)


def test_lm_scores_of_unknown_words_hold_against_the_base(spark):
    """To the base all unknown words are one type: however long they are, a held-out score is not far below it. Spellings count in full in another column."""
    r = random.Random(3)
    texts = {i: " ".join(words(60, i, 30) + ["".join(r.choices("abcdefghijkl0123456789", k=20 + 300 * (i % 2))) for _ in range(20)]) for i in range(120)}
    got = lm_scoring.scored(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    held = [x for x in got if x.held_out]
    assert held and len(got) == 120
    for x in held:
        assert np.isfinite(x.score) and 1.1 * x.base_score < x.score < 0 and x.n_known == x.n_tokens - 20
        assert x.spelt_score < 2 * x.base_score and x.bits_per_byte == pytest.approx(-x.spelt_score / np.log10(2) / x.n_bytes)
    only = [i for i in range(60) if lm_scoring.is_held_out(i)]
    none = lm_scoring.scored(spark.createDataFrame([(i, texts[i]) for i in only], "doc_id long, text string")).collect()
    assert all(x.base_score == 0 and -20 < x.score < 0 for x in none)  # nothing learned: one outcome alone


def test_perplexity(spark, odd, none, labels):
    texts = [(i, " ".join(words(80, i, 30)), "en", 1) for i in range(80)] + [(100 + i, " ".join(f"z{i}{j}" for j in range(80)), "en", 0) for i in range(5)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, quality int")
    got = {r.doc_id: r for r in perplexity.quality(docs, docs.select("doc_id", "quality")).collect()}
    assert sum(got[i].kept for i in range(80)) >= 76 and not any(got[100 + i].kept for i in range(5))
    assert perplexity.quality(odd, labels).count() == len(ODD) and perplexity.quality(none, labels).count() == 0
    assert all(r.kept for r in perplexity.quality(odd, labels.where("false")).collect())


def test_perplexity_learns_from_all_trusted_text(spark):
    # many documents of one language, few of another, and one trusted text that is longer than all others together
    texts = [(i, f"a{i % 50} b{i % 50} c{i % 50}", "en", 1) for i in range(6000)] + [(10_000 + i, " ".join(words(60, i, 30)).replace("v", "x"), "de", 1) for i in range(120)]
    texts += [(20_000 + i, " ".join(f"q{i}{j}" for j in range(60)), "de", 0) for i in range(5)] + [(30_000 + i, LONG * 26, "en", 1) for i in range(2)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, quality int")
    labels = docs.select("doc_id", "quality")
    got = {r.doc_id: r for r in perplexity.quality(docs, labels).select("doc_id", "perplexity", "kept").collect()}
    assert all(r.perplexity is not None for r in got.values())
    assert sum(got[10_000 + i].kept for i in range(120)) >= 110 and not any(got[20_000 + i].kept for i in range(5))
    assert max(got[10_000 + i].perplexity for i in range(120)) < 100


def test_perplexity_brute_force(spark):
    texts = [(i, " ".join(words(30 + i, i, 25))) for i in range(12)] + [(20, None), (21, "new words v1 v2"), (None, "v1"), (21, "V3")]
    docs = spark.createDataFrame([(*t, "en", t[0] is not None and t[0] < 8) for t in texts], "doc_id long, text string, lang string, learned boolean").coalesce(2)
    got = Counter((r.doc_id, r.n_tokens, round(r.log_perplexity, 2)) for r in perplexity.perplexities(docs, perplexity.train(docs, 3)).collect())
    pairs = Counter()
    for i, t in texts[:8]:
        w = [None, *t.split(), ""]
        pairs.update(zip(w, w[1:], strict=False))
    before = Counter(w for _, w in pairs)

    def off(counts):
        of = Counter(counts.values())
        n1, n2, n3, n4 = (of[k] for k in (1, 2, 3, 4))
        if not n1 or not n2:
            return lambda n: [0, 0.5, 0.75, 0.9][min(n, 3)]
        y = n1 / (n1 + 2 * n2)
        d = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
        return lambda n: min(max(d[min(n, 3)], 0.05), min(n, 3) - 0.05) if n else 0

    d2, d1, total = off(pairs), off(before), sum(before.values())
    root = sum(map(d1, before.values())) / total / (len(before) + 1)

    def chance(v, w):
        low = (before[w] - d1(before[w])) / total + root
        of = [n for (a, _), n in pairs.items() if a == v]
        return (pairs[v, w] - d2(pairs[v, w])) / sum(of) + sum(map(d2, of)) / sum(of) * low if of else low

    assert sum(chance("v1", w) for w in before) + root * sum(map(d2, [n for (a, _), n in pairs.items() if a == "v1"])) / sum(n for (a, _), n in pairs.items() if a == "v1") == pytest.approx(1)
    hoped = Counter()
    for i, t in texts:
        w = [None, *(t or "").lower().split(), ""]
        hoped[i, len(w) - 1, round(-sum(np.log(chance(a, b)) for a, b in zip(w, w[1:], strict=False)) / (len(w) - 1), 2)] += 1
    assert got == hoped


def test_toxicity(spark, odd, none, labels, sf):
    assert toxicity.fold("1d10t іdiоt l0ser 100") == ["idiot", "idiot", "ioser", "100"]
    lexicon = toxicity.Lexicon({"trash ": 5.0}, ("trash can",), slope=2.0, offset=-3.0)
    assert lexicon.score("you TR4SH!") > 0.9 > 0.1 > lexicon.score("the trash can") and lexicon.score("") == lexicon.score(None) < 0.1
    learned = toxicity.learn(odd, labels)
    got = toxicity.scored(odd, learned).collect()
    assert len(got) == len(ODD) and all(0 <= x.score <= 1 for x in got) and toxicity.scored(none, learned).count() == 0
    assert toxicity.learn(none, labels).weights == {}
    rows = spark.createDataFrame([(i, " ".join(words(50, i)) + (" you gr0bian" if i % 4 == 0 else "")) for i in range(80)], "doc_id long, text string")
    truth = rows.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.learn(rows.where("doc_id < 60"), truth.where("doc_id < 60"))
    assert {r.doc_id: r.score >= 0.7 for r in toxicity.scored(rows, model).collect()} == {i: i % 4 == 0 for i in range(80)}
    # an entry that clean documents have in one phrase only
    rows = spark.createDataFrame([(i, " ".join(words(50, i)) + (f" scum {i}" if i % 4 == 0 else " pond scum water" if i % 20 == 1 else "")) for i in range(200)], "doc_id long, text string")
    truth = rows.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.learn(rows, truth)
    assert "pond scum" in model.exceptions and model.score("pond scum water") < 0.5 < model.score("v1 scum")


def test_lexicon_against_a_plain_search():
    r = random.Random(4)
    letters = "abci1"
    for _ in range(300):
        entries = {"".join(r.choice("abci") for _ in range(r.randrange(1, 4))) + r.choice(["", " "]): r.random() for _ in range(5)}
        phrases = tuple({" ".join("".join(r.choice("abci") for _ in range(2)) for _ in range(2)) for _ in range(3)})
        text = " ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(12)))
        line, total = f" {' '.join(toxicity.fold(text))} ", 0.0
        spans = [(i, i + len(p) + 2) for p in phrases for i in range(len(line)) if line.startswith(f" {p} ", i)]
        for entry, weight in sorted(entries.items()):
            n = sum(line.startswith(f" {entry}", i) and not any(a <= i and i + len(entry) + 1 <= b for a, b in spans) for i in range(len(line)))
            total += weight * (1 + np.log(n)) if n else 0
        assert toxicity.Lexicon(entries, phrases).strength(text) == pytest.approx(total / np.log(np.e + len(toxicity.fold(text)) / 1000))


def test_bpe(spark, odd, none):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe.vocabulary_path()), bpe.PrefixBpe(bpe.vocabulary_path())
    r = random.Random(5)
    pieces = ["th", "er", "on", "tion", "aaa", "'s", "!!", "12", " ", "\n", "é", "İ", "Σ", "́", "中", "<|endoftext|>", "x", "\x85", "\x1f"]
    for text in ["".join(r.choice(pieces) for _ in range(r.randrange(30))) for _ in range(3000)]:
        want = library.encode(text, add_special_tokens=False).ids
        n, ids, decoded = own.document(text)
        assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), library.decode(want, skip_special_tokens=False)), text
    got = bpe.encode(odd, with_ids=True).collect()
    for row, (_, text, *_) in zip(sorted(got, key=lambda x: (x.doc_id is None, x.doc_id or 0, x.n_tokens)), sorted(ODD, key=lambda x: (x[0] is None, x[0] or 0, len(x[1] or ""))), strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert row.ids == ids and row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode(none).count() == 0


def test_token_files(spark, odd, none):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(2)
    for n in (0, 1, 2047, 2048, 2049, 9000):
        ids = (rng.zipf(1.3, n) % 49408).astype(np.uint32)
        file = token_files.pack([None, 4], np.array([0, n]), ids)
        docs, counts, back = token_files.unpack(file)
        assert docs == [None, 4] and counts.tolist() == [0, n] and (back == ids).all()
    damaged = bytearray(file)
    damaged[-400] ^= 255
    with pytest.raises(ValueError):
        token_files.unpack(bytes(damaged))
    library = Tokenizer.from_file(bpe.vocabulary_path())
    got = token_files.digests(token_files.packed(odd, file_ids=1000)).collect()
    ordered, start = sorted(got, key=lambda x: x.start), 0
    for row in ordered:
        assert row.start == start
        start += row.n_tokens
    texts = {i: t for i, t, *_ in ODD}
    for row in ordered:
        if row.doc_id is not None:
            ids = np.array([*library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
            assert (row.n_tokens, row.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    assert [r.doc_id for r in ordered if r.doc_id is not None] == sorted(i for i, *_ in ODD if i is not None)
    assert token_files.digests(token_files.packed(none)).count() == 0


def test_mixing(spark, odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and mixing.mix(none).count() == 0 and all(0 <= x.taken <= 3 * x.size for x in got)
    again = mixing.mix(odd.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i % 7)), "abcdef"[min(5, i % 11)]) for i in range(3000)], "doc_id long, text string, source string")
    out = mixing.mix(docs)
    for r in out.groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken"), F.max("source_size").alias("size")).collect():
        assert abs(r.taken - r.target) <= 7 and r.target <= 3 * r.size + 1e-6
    total = out.agg(F.sum("size")).first()[0]
    assert out.select("source", "target").distinct().agg(F.sum("target")).first()[0] == pytest.approx(total)
    assert mixing.repeated(docs, out).count() == out.agg(F.sum("repeats")).first()[0] and mixing.repeated(odd, mixing.mix(odd)).columns == odd.columns


def test_pipeline(spark, sf):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == docs.columns and set(out.select("doc_id").toPandas().doc_id) <= set(docs.select("doc_id").toPandas().doc_id), name
        docs = out
    texts = {r.doc_id: r.text for r in docs.collect()}
    library = Tokenizer.from_file(bpe.vocabulary_path())
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    for r in got:
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids
    near = minhash.near_duplicates(docs.dropDuplicates(["doc_id"])).where("NOT kept").count()
    assert near == 0


def staged(spark, docs, upto):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[:upto]:
        docs = stage(spark, docs, "")
    return docs


def test_pipeline_on_odd_and_empty_tables(spark, odd, none):
    columns = ["doc_id", "text", "lang", "source", "n_chars", "size", "kept"]  # two clashing names
    odd, none = (x.select(columns).withColumns({c: F.lit("x") for c in ("_n", "_copy", "copy", "n", "d", "t", "a.b", "c`d")}) for x in (odd, none))
    columns = odd.columns
    odder = [f"`{c.replace('`', '``')}`" for c in columns]
    for docs in (odd, none):
        for upto in range(1, 5):
            assert staged(spark, docs, upto).columns == columns
        assert staged(spark, docs, 5).count() >= 0
    kept = {r.doc_id for r in staged(spark, odd.select(odder), 3).collect()}
    assert 1 not in kept and 2 not in kept and 3 not in kept  # nothing to train on


def test_pipeline_on_planted_cases(spark):
    def doc(i, text):
        return (i, text, "en", "abc"[i % 3], len(text))

    def lines(seed, n=8):
        w = words(12 * n, seed, 4000)
        return [" ".join(w[12 * k : 12 * k + 12]) for k in range(n)]

    clean = {i: "\n".join(lines(i)) for i in range(60)}
    passage = lines(900, 5)
    near = lines(1)[3].split()
    near[5] = "changed"
    junk = {i: " ".join(f"{w} ### $$ || <>" for w in words(60, i, 4000)) for i in (200, 201, 202)}
    texts = clean | junk | {100: clean[0], 101: clean[1].replace(lines(1)[3], " ".join(near)), 110: "\n".join([*lines(110), *passage]), 111: "\n".join([*passage, *lines(111)])}
    texts[102] = " ".join(clean[2].split())  # one line: line dedup can't see it
    docs = spark.createDataFrame([doc(i, t) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    one, two, three = ({r.doc_id: r.text for r in staged(spark, docs, k).collect()} for k in (1, 2, 3))
    assert set(one) == set(texts) - set(junk) and all(one[i] == texts[i] for i in one)
    assert 100 not in two and two[101] == " ".join(near) and two[110] == texts[110] and two[111] == "\n".join(lines(111))
    assert all(two[i] == clean[i] for i in clean)
    assert set(three) == set(two) - {102} and all(three[i] == two[i] for i in three)
    mixed = Counter(r.doc_id for r in staged(spark, docs, 4).collect())
    size, taken = Counter(), Counter()
    for i, t in three.items():
        size["abc"[i % 3]] += len(t.split())
        taken["abc"[i % 3]] += mixed[i] * len(t.split())
    level, total = None, sum(size.values())
    weights = {"a": 1, "b": 2, "c": 3}
    target, open_ = {}, set(size)
    while True:  # hand the excess on until nothing is above three times its size
        level = (total - sum(target.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 3 * size[s]}
        if not over:
            break
        target |= {s: 3 * size[s] for s in over}
        open_ -= over
    target |= {s: level * weights[s] for s in open_}
    assert all(abs(taken[s] - target[s]) <= 156 for s in size)
    final = Counter(r.doc_id for r in staged(spark, docs, 5).collect())
    assert final == mixed


def test_hits_outside_exceptions():
    r = random.Random(2)
    for _ in range(200):
        hits = [(a, a + r.randrange(6), "e") for a in (r.randrange(60) for _ in range(20))]
        spans = [(a, a + r.randrange(9)) for a in (r.randrange(60) for _ in range(8))]
        assert toxicity.outside(hits, spans) == sorted(h for h in hits if not any(x <= h[0] and h[1] <= y for x, y in spans))
    n = 300_000  # a text of some 2 MB that is full of both
    hits, spans = [(8 * i, 8 * i + 3, "e") for i in range(n)], [(8 * i + 4, 8 * i + 7) for i in range(n)]
    assert len(toxicity.outside(hits, spans)) == n


def test_memories_are_bounded_by_bytes(monkeypatch):
    """Words without spaces are long: of these none is remembered, and of others so many bytes."""
    r = random.Random(1)
    texts = ["".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(300)) for _ in range(60)] + [f"word{i} other{i}" for i in range(500)]
    monkeypatch.setattr(bpe, "MEMORY_BYTES", 20_000)
    coder, ids = bpe.PrefixBpe(bpe.vocabulary_path()), token_files.WordIds(bpe.vocabulary_path())
    ids.MEMORY = 20_000
    for t in texts:
        n, spelt, _ = coder.document(t)
        counts, got = ids([t])
        assert n == counts[0] and spelt == " ".join(map(str, got.tolist())) == " ".join(map(str, coder.library.encode(t, add_special_tokens=False).ids))
        assert all(len(w) <= bpe.LONG_WORD for kept in (coder.spelt, coder.known, ids.known) for w in kept)
    assert len(coder.spelt) < 200 and len(ids.known) < 200
    minhash.shingles(" ".join("x" * 3000 + str(i) for i in range(1000)), 3)
    assert all(len(w) <= 64 for w in minhash.HASHES)


def test_rare_counts_have_no_constant_cutoff(spark):
    """Of a group in which nearly all documents have no symbol, a long clean text may have some: the fence is a rate, above 0, and the bound grows with length."""
    def text(n, symbols, seed):
        w = [f"{a}{i:05d}" for i, a in enumerate(words(n, seed))]
        for i in range(symbols):
            w[(i * 37) % n] += "$"
        return " ".join(w)

    docs = [(i, text(100 + i % 7, 0, i), "l", "s") for i in range(60)] + [(100, text(60_000, 40, 3), "l", "s"), (101, text(100, 40, 4), "l", "s"), (102, text(60_000, 9_000, 5), "l", "s")]
    got = quality_rules.quality(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()
    kept = {r.d.doc_id: r.kept for r in got}
    assert kept == {i: i not in (101, 102) for i in kept}
    base = quality_rules.measured(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"))
    limits = quality_rules.thresholds(quality_rules.written(base, "measures")).first()
    assert limits.high_symbols > 0 and limits.high_dup_lines > 0


@pytest.mark.parametrize("n, block", [(1, 4096), (4097, 4096), (9000, 2), (4096, 1)])
def test_token_files_in_slices_of_blocks(n, block):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 49408).astype(np.uint32)
    assert [s.stop - s.start for s in token_files.slices(9000 // 2)] == [1500, 1500, 1500]
    assert (token_files.unpack(token_files.pack([1], np.array([n]), ids, block))[2] == ids).all()


def test_token_files_take_few_steps_an_id(monkeypatch):
    """A block's ids are coded in one step each, and texts of several languages have a table of order 0 each."""
    r = np.random.default_rng(5)
    ids = np.concatenate([1000 * (i % 4) + r.integers(0, 300, 4096) for i in range(96)]).astype(np.uint32)
    steps = []
    real = token_files.GATE
    monkeypatch.setattr(token_files, "GATE", type("Counting", (), {"take": lambda self, x: steps.append(1) or real.take(x)})())
    file = token_files.pack([1], np.array([len(ids)]), ids)
    assert len(steps) == 4096
    assert len(file) * 8 < 9.3 * len(ids)  # a table for all would take 10.2 bits an id
    assert (token_files.unpack(file)[2] == ids).all()


def test_words_are_parted_by_pieces():
    """Ids of words that are learned together are the library's, also where pieces within words are many."""
    words = ["don't", "a1b22", "é", "ß!?x", "×", "…a", "l'été", "x\u0301y", "<|endoftext|>a", "$$$", "'s", "12'34", "ciónraóas***", "", "\x1ca", "a\xa0b"] + [f"w{i}-{i}é" for i in range(1500)]
    coder = token_files.WordIds(bpe.vocabulary_path())
    coder.learn(words)
    for w in words:
        assert np.frombuffer(coder.known[w], np.uint16).tolist() == coder.library.encode(w, add_special_tokens=False).ids


def test_distinct_words_of_texts_are_looked_up_once():
    """A word that texts repeat is one lookup, and ids are the library's, also in parts of Arrow arrays, with nulls, capitals, odd gaps and specials."""
    import pyarrow as pa

    class Counting(dict):
        asked = 0

        def get(self, *x):
            self.asked += 1
            return super().get(*x)

    coder = token_files.WordIds(bpe.vocabulary_path())
    coder.known = Counting()
    coder(["one Two three ONE " * 1000] * 4)
    assert coder.known.asked <= 4
    texts = ["skipped", None, "", " \t", "One\x0btwo\nÀÉ×ß \x1ca a\xa0b \x85c", "A<|endoftext|>B <|ENDOFTEXT|> x<|", "H\u0331 \u0130I\u0307 \u0242 \u0249", "ÇA va'S l'ÉTÉ", "x" * 200, "skipped"]
    counts, got = coder(pa.array(texts).slice(1, 8))
    want = [coder.library.encode(t or "", add_special_tokens=False).ids for t in texts[1:9]]
    assert counts.tolist() == [len(w) for w in want] and got.tolist() == sum(want, [])
    batch = pa.RecordBatch.from_pydict({"text": pa.array([None, "aa", "b" * 50, "c", None, "dd"])})
    assert [p.num_rows for p in token_files.by_bytes(batch, "text", 10)] == [2, 1, 3]


def test_frequent_pairs_of_ids_take_one_step(monkeypatch):
    """Ids that often stand together are one symbol, within blocks only, and damage of pairs is told."""
    r = np.random.default_rng(3)
    spelt = r.integers(0, 3000, (400, 4)).astype(np.uint32)
    ids = spelt[r.integers(0, 400, 20_000)].ravel()
    steps = []
    real = token_files.GATE
    monkeypatch.setattr(token_files, "GATE", type("Counting", (), {"take": lambda self, x: steps.append(1) or real.take(x)})())
    file = token_files.pack([1], np.array([len(ids)]), ids)
    assert len(steps) < 1600  # 4,096 ids a block, four a word
    assert (token_files.unpack(file)[2] == ids).all()
    for block in (1, 7, 1000):
        assert (token_files.unpack(token_files.pack([1], np.array([9000]), ids[:9000], block))[2] == ids[:9000]).all()
    with pytest.raises(ValueError):
        token_files.Pairs(2, np.array([[0, 1], [2, 3]], np.uint16)).parted(np.array([3]), 4096)
    with pytest.raises(ValueError):
        token_files.Pairs(1, np.array([[i, i] for i in range(40)], np.uint16)).parted(np.array([40]), 4096)


def test_words_with_signs_are_no_other_words():
    """A word is looked up once, whatever signs and digits stand around it; ids are the library's."""
    import pyarrow as pa

    coder = token_files.WordIds(bpe.vocabulary_path())
    texts = ["word word, (Word) word. 12word!", "caf\u00e9 caf\u00e9, (caf\u00e9) 1\u00e9", "don't 'RE're '1 !'s x'", "2\u00d7\u00b2, a\u00f7b a\u00a0b, \u20ac1", "<|endoftext|>a,b <|b.", "I\u0307,\u0130. e\u0301, \u01330x"]
    counts, got = coder(pa.array(texts))
    want = [coder.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and got.tolist() == sum(want, [])
    assert [w for w in coder.known if "word" in w] == ["word"]
    assert [w for w in coder.known if "caf" in w] == ["caf\u00e9"]


def test_signatures_of_documents_in_buckets_only_are_joined(spark, monkeypatch):
    """Documents that share no bucket have neither texts nor signatures in the joins of pairs, and no join sends out ids whole."""
    real, got = minhash.written, {}

    def kept(df, name):
        got.setdefault(name, []).append(real(df, name))
        return got[name][-1]

    monkeypatch.setattr(minhash, "written", kept)
    monkeypatch.setattr(minhash, "forget", lambda *tables: None)
    docs = [(i, " ".join(words(60, i if i > 4 else 0))) for i in range(40)] + [(50, " ".join(words(60, 0)[:-1]))]
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {i: 0 if i < 5 or i == 50 else i for i, _ in docs}
    assert sorted(r.node for r in got["sigs"][0].collect()) == [0, 50] == sorted(r.doc_id for r in got["texts"][0].collect())
