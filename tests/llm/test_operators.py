"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import brown, jaccard, mixing, nbsvm, pieces, quality_rules, repeats, secrets, sharding, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, h string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _rows():
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("aeioustrn") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base, passage = prose(120), prose(40)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", " \n", "one", "two words", base, base, " ".join(near), base.upper(), passage + "\n" + prose(30), prose(25) + "\n" + passage, prose(3000), "é日本 " * 40, "x" * 400, "password: hunter22 AKIA" + "B7" * 9 + " " + "0f" * 14, "secret: token: abcdefg"]
    texts += [prose(rnd.randint(5, 90)) for _ in range(44)]
    return [(i, t, None if i % 9 == 4 else "en", None if i % 11 == 3 else f"s{i % 3}", len(t or ""), i % 2, "clash") for i, t in enumerate(texts)]


ROWS = _rows()
TEXTS = {r[0]: r[1] or "" for r in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_rules(docs, none):
    got = {r.doc_id: r for r in quality_rules.judge_quality(docs).collect()}
    for i, t in TEXTS.items():
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge_quality(none).count() == 0


def test_quality_outliers_in_groups_of_any_size(spark):
    """Symbol garbage is rejected by distance in a large group, in a small one, and where the language is rare or null."""
    rnd = random.Random(11)
    words = ["".join(rnd.choice("aeioustrn") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    prose = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(60, 120)))
    garbage = lambda: " ".join(w + "%%%" for w in prose().split())
    groups = [("en", "large", 60), ("en", "small", 8), ("xx", "rare", 4), (None, None, 4)]
    rows, bad = [], set()
    for lang, source, n in groups:
        bad.add(len(rows))
        rows += [(len(rows) + k, prose() if k else garbage(), lang, source) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality_rules.judge_quality(docs).collect()
    assert len(got) == len(rows) and not any(r.base_failed or r.distance is None for r in got)
    assert {r.doc_id for r in got if not r.kept} == bad
    # the few rows of a small table are judged too
    few = docs.where("source != 'large' or source is null")
    assert {r.doc_id for r in quality_rules.judge_quality(few).collect() if not r.kept} == bad - {0}


def test_quality_against_direct_estimate(spark):
    """Distances equal those of concentration steps taken directly on the rows of one group of several hundred."""
    rng, D = np.random.default_rng(4), quality_rules.D
    vocabulary = ["".join(rng.choice(list("aeioustrnKM,.")) for _ in range(rng.integers(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(60, 140))) + ("\nsame\nsame" if k % 3 == 0 else "") for k in range(500)]
    texts[::50] = [t.replace(" ", " ### ") for t in texts[::50]]
    docs = spark.createDataFrame([(k, t, "en", "a") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = np.array([r.distance for r in sorted(quality_rules.judge_quality(docs).collect(), key=lambda r: r.doc_id)])
    stats = quality_rules.text_statistics([t.encode() for t in texts])
    x = np.stack([stats[v] for v in quality_rules.VECTOR], axis=1)
    assert np.linalg.matrix_rank(np.cov(x.T)) >= D - 1

    def steps(mean, cov):
        for _ in range(30):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov + quality_rules._RIDGE), x - mean)
            near = np.argsort(d)[: int(quality_rules.H_SHARE * len(x))]
            mean, cov = x[near].mean(axis=0), np.cov(x[near].T, bias=True)
        return np.linalg.slogdet(cov + quality_rules._RIDGE)[1], mean, cov

    spread = (np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)) / 1.349
    _, mean, cov = min(steps(np.median(x, axis=0), np.diag(spread**2)), steps(x.mean(axis=0), np.cov(x.T, bias=True)), key=lambda m: m[0])
    want = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov + quality_rules._RIDGE), x - mean)
    want /= max(1.0, np.median(want) / quality_rules.CHI2_MEDIAN)
    assert np.corrcoef(got, want)[0, 1] > 0.98 and np.median(np.abs(got / want - 1)) < 0.15
    assert set(np.flatnonzero(got > quality_rules.CUTOFF)) == set(np.flatnonzero(want > quality_rules.CUTOFF)) == set(range(0, 500, 50))


def test_secrets(docs, none, spark):
    got = {r.doc_id: r for r in secrets.digest(secrets.scan_secrets(docs)).collect()}
    rules = [(re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6), (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    for i, t in TEXTS.items():
        spans = sorted((m.start(), k, m.end()) for k, (rule, ok) in enumerate(rules) for m in rule.finditer(t) if ok(m))
        written = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(written.encode()).hexdigest()
    assert secrets.scan_secrets(none).count() == 0
    key = "kX9vQ2mZ7pLr4TwB8nHs3JdF"
    rnd = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    ordinary = ["".join(rnd.choice(["ing", "tion", "re", "the", "er", "ou"]) for _ in range(rnd.randint(4, 9))) for _ in range(200)]
    rows = [(10 + k, " ".join(rnd.sample(ordinary, 60)) + " api_key = " + "".join(rnd.choice(letters) for _ in range(30))) for k in range(80)]
    more = spark.createDataFrame([(1, f"the key {key} is here"), (2, None), (3, "therouingtionerrethe " + ordinary[0] * 2), *rows], "doc_id long, text string")
    found = {r.doc_id: r for r in secrets.digest(secrets.scan_secrets(more)).collect()}
    assert found[1].n_markov == 1 and found[3].n_markov == 0
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(more).collect()}
    assert masked[1] == f"the key {secrets.MASK} is here"


def test_secrets_joined_to_other_text(spark):
    """A key is found and masked after a path, a prefix or a base span, before other text, and twice in one string."""
    key, other = "kX9vQ2mZ7pLr4TwB8nHs3JdF", "W3cYt6RzKq1Vb5MgXe0PjLu8"
    rnd = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    ordinary = ["".join(rnd.choice(["ing", "tion", "re", "the", "er", "ou"]) for _ in range(rnd.randint(4, 9))) for _ in range(200)]
    rows = [(100 + k, " ".join(rnd.sample(ordinary, 60)) + " api_key = " + "".join(rnd.choice(letters) for _ in range(30))) for k in range(80)]
    path = "/".join(ordinary[:6])
    joined = [f"{path}/{key}", f"{path}/{key}/{path}", f"{ordinary[0]}-{ordinary[1]}-{ordinary[2]}={key}", f"{path}/{key}/{path}/{other}", "0f" * 14 + "/" + key, "0f" * 14 + f"/{path}/{key}"]
    texts = dict(enumerate([*joined, path, f"{path}/{ordinary[7]}"]))
    more = spark.createDataFrame([*texts.items(), *rows], "doc_id long, text string")
    found = {r.doc_id: [s for s in r.spans if s.kind == "markov"] for r in secrets.scan_secrets(more).collect() if r.doc_id in texts}
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(more).collect()}
    for i, text in texts.items():
        assert all(text[s.start : s.end] == s.value for s in found[i])
        assert all(a.end <= b.start for a, b in zip(found[i], found[i][1:]))
        for k in (key, other):
            at = text.find(k)
            assert at < 0 or any(s.start <= at and at + len(k) <= s.end for s in found[i])
            assert k not in masked[i]
    assert [len(found[i]) for i in texts] == [1, 1, 1, 2, 1, 1, 0, 0]


def test_jaccard_filters():
    """No pair of different labels that reaches the similarity is left out by the three orders, whatever the block size."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 52, 160).astype(np.uint64)
    level = np.zeros(1 << jaccard.SKETCH_BITS, np.uint8)
    level[base >> np.uint64(jaccard.TOKEN_BITS - jaccard.SKETCH_BITS)] = 9
    sets = []
    for k in range(150):
        own = base[: rng.integers(60, 161)].copy()
        own[rng.random(len(own)) < rng.choice([0, 0.05, 0.1, 0.15, 0.3])] += np.uint64(k + 1)
        own = np.unique(own)
        sets.append(own[np.lexsort((jaccard.mix(own), jaccard._level_of(own, level)))])
    label = rng.integers(0, 40, len(sets))
    rows = []
    for k, s in enumerate(sets):
        p = int(jaccard._prefix(np.int64(len(s))))
        parity, heads = jaccard.suffix_parity(s, p), [jaccard._sketch(h) for h in jaccard._heads(s)]
        assert all(np.bitwise_count(parity[i] ^ jaccard.suffix_parity(s[i:], 1)[0]).sum() == 0 for i in range(p))
        rows += [(int(s[i]), len(s), k, i, *heads, parity[i]) for i in range(p)]
    rows.sort(key=lambda r: r[:2])
    key, n, doc, place, second, third = (np.array([r[c] for r in rows]) for c in range(6))
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if label[i] != label[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert len(want) > 100
    found, old = [], jaccard.BLOCK
    try:
        for jaccard.BLOCK in (1, 300, old):
            pairs = jaccard._apart(key, label[doc], n, place, np.stack((second, third)), np.stack([r[6] for r in rows]))
            found.append({(min(p), max(p)) for i, j in pairs for p in zip(doc[i].tolist(), doc[j].tolist(), strict=True)})
    finally:
        jaccard.BLOCK = old
    assert found[0] == found[1] == found[2] and want <= found[0]
    assert len(found[0]) < 0.7 * sum(label[i] != label[j] for i in range(len(sets)) for j in range(i + 1, len(sets)))


def test_jaccard(docs, none):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = {}
    for i, t in TEXTS.items():
        w = WORD.findall(t.translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    want = {(i, len(sets[i]), root[i]) for i in sets}
    triples = lambda df: {(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()}
    assert triples(jaccard.jaccard_components(docs)) == want
    # lists dealt over parts, and every list dealt by the second order
    assert triples(jaccard.jaccard_components(docs, long_list=2, heavy_list=0)) == want
    assert jaccard.jaccard_components(none).count() == 0


def test_jaccard_parted_lists(spark):
    """Pairs that stand apart in every part of their lists are linked all the same."""
    texts = [" ".join(f"w{k}x{i}" for i in range(79)) for k in range(40)]
    rows = [(2 * k + d, f"{t} end{d}") for k, t in enumerate(texts) for d in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for long_list in (1, 1 << 17):
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, long_list=long_list).collect()}
        assert got == {i: i - i % 2 for i, _ in rows}


def test_jaccard_ids(spark):
    """Repeated rows, one id with two texts, and null ids: every row comes back, judged by its own text."""
    prose = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(4)]
    rows = [(7, prose[0]), (7, prose[0]), (7, prose[1]), (None, prose[1]), (None, prose[2]), (9, prose[0] + " more"), (3, prose[3]), (None, None), (5, "")]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(7, 56, 7), (7, 56, 7), (7, 56, 7), (-1, 56, 7), (-1, 56, -1), (9, 57, 7), (3, 56, 3), (-1, 0, -1), (5, 0, 5)])


def test_sharding(docs, none):
    rows = sorted(sharding.shard_by_bytes(docs, 5).collect(), key=lambda r: r.doc_id)
    total, before, slots = sum(r.size for r in rows), 0, Counter()
    for r in rows:
        assert r.size == len(TEXTS[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(TEXTS[r.doc_id].encode())
        assert r.shard == min(4, before * 5 // total) and r.slot == slots[r.shard]
        before += r.size
        slots[r.shard] += 1
    assert sharding.shard_by_bytes(none, 5).count() == 0


def test_lm_scores(docs, none):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    tokens = {i: [*WORD.findall(t.translate(lower)), ""] for i, t in TEXTS.items()}
    train = docs.where("doc_id % 2 = 0")
    c = Counter(w for i, t in tokens.items() if i % 2 == 0 for w in t)
    n, v = sum(c.values()), len(c)
    for r in brown.lm_scores(docs, train).collect():
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert r.score < 0
    assert brown.lm_scores(none, none).count() == 0


def _direct_lm(train: list[list[str]], core_size: int) -> tuple:
    """Classes and a scoring function, by dictionaries: core words by exchange(), others by their contexts, then plain counts."""
    count = Counter(w for t in train for w in t)
    h = {w: int(brown.Words([w.encode()]).h[0]) if w else int(brown.END) for w in count}
    cut, share, upto = -1, 1.0, 0
    for c, n in sorted(Counter(count.values()).items(), reverse=True):
        if upto + n > core_size:
            cut, share = c, (core_size - upto) / n
            break
        upto += n
    core = [w for w in count if count[w] > cut or (count[w] == cut and h[w] < share * 2.0**64) or w == ""]
    core.sort(key=lambda w: (-count[w], h[w] - (1 << 64) * (h[w] >> 63)))
    at = {w: i for i, w in enumerate(core)}
    pairs = np.zeros((len(core) + 1,) * 2)
    for t in train:
        for a, b in zip(["", *t], t):
            pairs[at.get(a, len(core)), at.get(b, len(core))] += 1
    cls = brown.exchange(pairs, min(brown.CLASSES, len(core)))
    k = int(cls[-1])
    known = {w: int(cls[i]) for w, i in at.items()}
    joint = Counter()
    for (i, j), n in np.ndenumerate(pairs):
        joint[cls[i], cls[j]] += n
    cell = lambda a, b: joint[a, b] + 0.5
    row = [sum(cell(a, b) for b in range(k + 1)) for a in range(k + 1)]
    col = [sum(cell(a, b) for a in range(k + 1)) for b in range(k + 1)]
    info = lambda a, b: np.log(cell(a, b) * sum(row) / row[a] / col[b])
    gain = {w: np.zeros(k) for w in count if w not in at}
    for t in train:
        for a, w, b in zip(["", *t], t, [*t[1:], t[0]]):
            if w in gain:
                gain[w] += [info(known.get(a, k), c) + info(c, known.get(b, k)) for c in range(k)]
    classes = known | {w: int(np.argmax(np.round(g, 9))) for w, g in gain.items()}
    step, before, inside, size = Counter(), Counter(), Counter(), Counter()
    for t in train:
        for a, b in zip(["", *t], t):
            step[classes[a], classes[b]] += 1
            before[classes[a]] += 1
            inside[classes[b]] += 1
    for w in count:
        size[classes[w]] += 1

    def score(t):
        total = 0.0
        for a, b in zip(["", *t], t):
            a, b_class = classes.get(a, k), classes.get(b, k)
            if a == k:
                total += np.log10((inside[b_class] + 0.5) / (sum(inside.values()) + 0.5 * (k + 1)))
            else:
                total += np.log10((step[a, b_class] + 0.5) / (before[a] + 0.5 * (k + 1)))
            total += np.log10((count[b] + 0.5) / (inside[b_class] + 0.5 * size[b_class])) if b in count else 0.0
        return total

    return classes, score


@pytest.mark.parametrize("core,frequent", [(2047, 1 << 17), (25, 60), (25, 1 << 17)])
def test_class_scores_by_hand(docs, core, frequent, monkeypatch):
    """Core words only; most words put into classes by context and looked up in buckets; all of them broadcast."""
    monkeypatch.setattr(brown, "CORE", core)
    monkeypatch.setattr(brown, "FREQUENT", frequent)
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    tokens = {i: [*WORD.findall(t.translate(lower)), ""] for i, t in TEXTS.items()}
    classes, score = _direct_lm([t for i, t in tokens.items() if i % 3], core)
    assert len(set(classes.values())) > 10
    got = {r.doc_id: r.score for r in brown.lm_scores(docs, docs.where("doc_id % 3 != 0")).collect()}
    assert got == {i: pytest.approx(score(t)) for i, t in tokens.items()}


def test_lm_rows_and_unseen(spark, docs, none):
    """Null and repeated ids are rows of their own; without training every word is unknown; clashing names are ignored."""
    twice = docs.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit("x").alias("bucket"), F.lit(1).alias("classes"))
    twice = twice.unionByName(docs.select(F.lit(7).cast("long").alias("doc_id"), "text", F.lit("x").alias("bucket"), F.lit(1).alias("classes")))
    rows = brown.lm_scores(twice, docs).collect()
    want = sorted(round(r.score, 6) for r in brown.lm_scores(docs, docs).collect())
    for own in (None, 7):
        assert sorted(round(r.score, 6) for r in rows if r.doc_id == own) == want
    assert all(r.n_known == 0 and r.train_tokens == 0 and np.isfinite(r.score) for r in brown.lm_scores(docs, none).collect())


def test_exchange_raises_the_likelihood():
    pairs = np.random.default_rng(2).poisson(0.4, (41, 41)).astype(float)

    def likelihood(cls):
        member = np.eye(int(cls[-1]) + 1)[cls]
        joint, xlogx = member.T @ pairs @ member, lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return xlogx(joint) - xlogx(joint.sum(axis=0)) - xlogx(joint.sum(axis=1))

    found = [likelihood(brown.exchange(pairs, 6, passes=n)) for n in range(6)]
    assert all(b >= a - 1e-6 for a, b in zip(found, found[1:])) and found[-1] > found[0] + 1


def test_topk(spark):
    rnd = random.Random(5)
    vectors = [(i, [rnd.randint(-50, 50) for _ in range(20)] if i % 7 else [3] * 20, "x") for i in range(90)]
    df = spark.createDataFrame([*vectors, (200, None, "x"), (201, [1, None], "x")], "vec_id long, vector array<long>, h string")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.topk(df, df.where("vec_id % 10 = 0"), 4).collect()}
    want = set()
    for q, a, _ in vectors[::10]:
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b, _ in vectors if i != q)[:4]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    assert topk.topk(df.limit(0), df.limit(0), 4).count() == 0


def test_topk_beyond_doubles():
    """Scores that differ in their last bit only, above 2**53, are told apart."""
    q, c = np.array([[2.0**40, 1.0]]), np.array([[2.0**13, 0.0], [2.0**13, 1.0]])
    _, best, score = topk.block_topk(np.array([0]), q, np.array([1, 2]), c, 1)
    assert best.tolist() == [2] and score.tolist() == [2**53 + 1]


def test_secrets_recall(spark):
    """Of random strings set into prose without a keyword most are found, and hardly any ordinary string."""
    rnd = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    syllables = ["ing", "tion", "re", "the", "er", "ou", "man", "der", "Le", "Ge"]
    ordinary = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(4, 9))) for _ in range(200)]
    labelled = [(1000 + k, " ".join(rnd.sample(ordinary, 60)) + f" token = {key(30)}") for k in range(80)]
    planted = {k: (rnd.choice(ordinary) + " ", key(24)) for k in range(200)}
    clean = [(500 + k, " ".join(rnd.sample(ordinary, 20)) + " " + "_".join(rnd.sample(ordinary, 3))) for k in range(200)]
    rows = [(k, a + b + " end") for k, (a, b) in planted.items()] + clean + labelled
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [s for s in r.spans if s.kind == "markov"] for r in secrets.scan_secrets(docs).collect()}
    hit = [any(s.start <= len(a) and len(a) + 20 <= s.end for s in found[k]) for k, (a, _) in planted.items()]
    assert np.mean(hit) > 0.85 and sum(bool(found[k]) for k, _ in clean) <= 2


def test_secrets_spans_by_brute_force(spark):
    """Masks, chains of spans, parts and what is left of runs, on random spans with ties and overlaps."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("ab/é日=") for _ in range(rng.randint(1, 200)))
        at = [tuple(sorted(rng.sample(range(len(text) + 1), 2))) for _ in range(rng.choice([0, 1, 5, 30]) if len(text) > 2 else 0)]
        runs, end = [], 0
        while end + 2 < len(text):
            start = end + rng.randint(1, 3)
            end = start + rng.randint(1, 40)
            if end <= len(text):
                runs.append((start, end, "markov", text[start:end]))
        rows.append((i, text, [(a, b, "hex", text[a:b]) for a, b in at], runs))
    kind = "array<struct<start:int,end:int,kind:string,value:string>>"
    df = spark.createDataFrame(rows, f"i long, text string, spans {kind}, runs {kind}")
    cols = df.select("i", secrets.masked(F.col("text"), F.col("spans")).alias("masked"), secrets._parts(F.col("text")).alias("parts"), secrets._outside(F.col("runs"), F.col("spans")).alias("outside"), secrets._joined_up(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).alias("joined"))
    got = {r.i: r for r in cols.collect()}
    for i, text, spans, runs in rows:
        out, at, joined = "", 0, []
        for a, b, *_ in sorted(spans):
            if a >= at:
                out += text[at:a] + secrets.MASK
                joined.append([a, b])
            at = max(at, b)
            joined[-1][1] = max(joined[-1][1], b)
        assert got[i].masked == out + text[at:]
        assert [list(j) for j in got[i].joined] == joined
        parts = [(m.start(), m.end(), m[0]) for m in re.finditer("[^/_=+-]{2,}", text) if len(m[0]) < len(text)]
        assert [tuple(p) for p in got[i].parts] == [(0, len(text), text), *parts]
        covered = {c for a, b, *_ in spans for c in range(a, b)}
        # a run is cut at every start of a span, though nothing of it is lost between two
        left = [(c, text[c]) for a, b, *_ in runs for c in range(a, b) if c not in covered]
        assert [(c, p.value[c - p.start]) for p in got[i].outside for c in range(p.start, p.end)] == left
        assert all(p.end - p.start == len(p.value) and (p.end in covered or any(p.end == r[1] for r in runs)) for p in got[i].outside)


def test_secrets_time_with_many_spans(spark):
    """Four times the spans of one text take nowhere near sixteen times as long."""
    import time

    text = lambda n: " ".join(f"password: hunter{i:06d}z abcdefgh" for i in range(n))
    took = {}
    for n in (4000, 4000, 16000):
        docs = spark.createDataFrame([(1, text(n))], "doc_id long, text string")
        begin = time.monotonic()
        got = secrets.mask_secrets(docs).first().text
        took[n] = time.monotonic() - begin
        assert got == " ".join([f"{secrets.MASK} abcdefgh"] * n)
    assert took[16000] < 8 * took[4000] + 5, took


def test_secrets_clashing_columns_and_many_spans(spark):
    """Columns of the names that the operator uses inside come back as they were; a text may hold thousands of spans."""
    text = " ".join(f"token: abcdef{k:04d}" for k in range(2000))
    rows = [(1, text, "keep", 7, "x"), (1, text, "keep", 7, "x"), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, seen int, spans string")
    got = secrets.mask_secrets(docs).orderBy("doc_id").collect()
    assert docs.columns == list(got[0].asDict()) and got[0].text is None
    assert got[1] == got[2] and got[1].text == " ".join([secrets.MASK] * 2000) and (got[1].base, got[1].seen, got[1].spans) == ("keep", 7, "x")
    spans = secrets.scan_secrets(docs.where("doc_id = 1").limit(1)).first().spans
    assert [(s.start, s.end) for s in spans] == [(m.start(), m.end()) for m in re.finditer(r"token: abcdef\d{4}", text)]
    assert secrets.digest(secrets.scan_secrets(docs)).columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def test_pieces(docs, none):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    encoded = pieces.encode(docs)
    rows = {r.doc_id: r for r in encoded.collect()}
    for i, t in TEXTS.items():
        assert rows[i].token_ids == sp.encode(t) and rows[i].round_trip and rows[i].n_tokens == len(rows[i].token_ids)
    assert {r.doc_id: r.text for r in pieces.decode(encoded).collect()} == TEXTS
    assert pieces.encode(none).count() == 0


def test_sharding_with_null_and_repeated_ids(spark):
    """Null ids come first, equal ids go by checksum, equal rows take slots of their own; shards stay contiguous and near equal."""
    rows = [(None, "z" * 50), (2, "b" * 9), (2, "a" * 70), (2, "a" * 70), (None, None), (1, ""), (7, "é" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")).withColumn("size", F.lit(0))
    want = sorted(((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows))
    total, before, slots, placed = sum(r[3] for r in want), 0, Counter(), []
    for has, i, crc, size in want:
        shard = min(2, before * 3 // total)
        placed.append((has, i, crc, size, shard, slots[shard]))
        slots[shard] += 1
        before += size
    got = sharding.shard_by_bytes(docs, 3).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size, r.shard, r.slot) for r in got) == sorted(placed)


def _proto(number, value):
    """A field of a protocol-buffer message: an integer, a float or bytes."""
    if isinstance(value, int):
        return bytes([number << 3]) + bytes([value])
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    return bytes([number << 3 | 2, len(value)]) + value


def test_pieces_of_a_unigram_model():
    """Best segmentations of a unigram model, against all segmentations and against the library."""
    rng = random.Random(11)
    some = {"".join(rng.choice("abc▁") for _ in range(rng.randint(2, 4))) for _ in range(40)}
    some = sorted(p for p in some if "▁" not in p[1:]) + ["▁", "a", "b", "c"]
    piece = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(p, -rng.uniform(1, 9), 1) for p in some]]
    data = b"".join(_proto(1, _proto(1, p.encode()) + _proto(2, x) + _proto(3, k)) for p, x, k in piece)
    data += _proto(2, _proto(3, 1)) + _proto(3, _proto(1, b"identity") + _proto(3, 1) + _proto(4, 0) + _proto(5, 1))
    model = pieces.PieceModel(data)
    score = dict(zip(model.pieces, model.scores, strict=True))

    def best(word):
        """The greatest sum over all segmentations, and the unknown characters' penalty."""
        total = [0.0]
        for end in range(1, len(word) + 1):
            ways = [total[start] + score[word[start:end]] for start in range(end) if word[start:end] in model.id]
            total.append(max([*ways, total[end - 1] + model.penalty]) if word[end - 1] not in model.known or not ways else max(ways))
        return total[-1]

    words = sorted({"▁" * rng.randint(0, 1) + "".join(rng.choice("abcabcabcx") for _ in range(rng.randint(1, 12))) for _ in range(200)})
    for word, parts in zip(words, model.segment_sorted(words), strict=True):
        assert "".join(parts) == word
        assert sum(score.get(p, model.penalty) for p in parts) == pytest.approx(best(word))
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_proto=data)
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 30))) for _ in range(40)] + ["", " ", "a  b ", "xabx xx", "é"]
    ids, bounds = pieces.Encoder(model).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [sp.encode(t) for t in texts]


def test_classifier(docs, none):
    scores = {r.doc_id: r.score for r in nbsvm.classify(docs, docs).collect()}
    assert set(scores) == set(TEXTS) and all(0 <= s <= 1 for s in scores.values())
    assert {r.score for r in nbsvm.classify(docs, none).collect()} == {0.5}


def test_classifier_fit():
    """The features of one text, the log-count ratios, and the dual's optimum by another way of finding it."""
    doc, feature = nbsvm.features([b"abcd", b"abcde", b""])
    # abc, bcd, abcd and two with the line's end; the longer text shares the first three
    assert len(feature[doc == 0]) == 5 and len(feature[doc == 1]) == 7 and not (doc == 2).any()
    assert len(set(feature[doc == 0]) & set(feature[doc == 1])) == 3
    rng = np.random.default_rng(2)
    labels = np.arange(60) % 2
    rows = [np.unique(np.concatenate((rng.integers(0, 40, 6), rng.integers(40 + 30 * y, 70 + 30 * y, 5)))).astype(np.int32) for y in labels]
    old = nbsvm.PASSES
    try:
        nbsvm.PASSES = 400
        w, r2, bias, _, _ = nbsvm.fit(rows, labels)
    finally:
        nbsvm.PASSES = old
    learn = np.arange(60) % 5 != 4
    x, y = np.zeros((60, 100)), np.where(labels > 0, 1.0, -1.0)
    for i, r in enumerate(rows):
        x[i, r] = 1
    count = lambda k: x[learn & (labels == k)].sum(axis=0) + nbsvm.ALPHA
    n = lambda k: (learn & (labels == k)).sum() + 2 * nbsvm.ALPHA
    ratio = np.log(count(1) / n(1)) - np.log(count(0) / n(0))
    assert np.allclose(r2[:100], ratio**2)
    z = np.hstack((x * ratio / np.linalg.norm(x * ratio, axis=1, keepdims=True), np.ones((60, 1))))[learn]
    y = y[learn]
    limit = np.array([nbsvm.PENALTY * len(y) / (2 * (y == k).sum()) for k in y])
    alpha, q = np.zeros(len(y)), (z @ z.T) * np.outer(y, y)
    for _ in range(20_000):  # projected gradient on the dual
        alpha = np.clip(alpha - 0.02 * (q @ alpha - 1), 0, limit)
    best = z.T @ (alpha * y)
    assert np.allclose(w[:100], best[:-1] * ratio, atol=1e-3) and abs(bias - best[-1]) < 1e-3


def test_classifier_held_out(spark):
    """Held-out rows of planted quality are told apart; a bound on features keeps fewer rows, and a very long text is scored."""
    rnd = random.Random(6)
    good = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8))) for _ in range(200)]
    bad = ["".join(rnd.choice("ghijkl%$") for _ in range(rnd.randint(3, 8))) for _ in range(200)]
    rows = [(i, " ".join(rnd.choice(good if i % 2 else bad) for _ in range(60)), i % 2) for i in range(300)] + [(300, " ".join(good) * 1500, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    for bound in (nbsvm.SAMPLE_FEATURES, 60_000):
        got = {r.doc_id: r.score for r in nbsvm.classify(docs.drop("label"), docs.where("doc_id < 200").select("doc_id", "label"), sample_features=bound).collect()}
        assert np.mean([(got[i] >= 0.5) == bool(i % 2) for i in range(200, 300)]) >= 0.98 and got[300] > 0.5


def test_mixing(docs, none):
    rows = mixing.pareto_mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.pareto_mix(docs).collect()))
    sizes = Counter()
    for r in rows:
        assert r.size == len(WORD.findall(TEXTS[r.doc_id])) and r.taken == r.copies * r.size and r.copies <= 2
        sizes[r.source] += r.size
    assert {r.source: r.source_size for r in rows} == dict(sizes)
    targets = {r.source: r.target for r in rows}
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    longest = max(r.size for r in rows)
    for s, target in targets.items():
        assert abs(sum(r.taken for r in rows if r.source == s) - target) <= longest / 2 + 1
    assert mixing.pareto_mix(none).count() == 0


def test_repeats(docs, none):
    first: dict[bytes, int] = {}
    got = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    for i, t in sorted(TEXTS.items()):
        b = t.encode()
        cut = bytearray(len(b))
        for p in range(len(b) - 49):
            if first.setdefault(b[p : p + 50], i) < i:
                cut[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, c in zip(b, cut) if not c)
        runs = sum(cut[k] and not (k and cut[k - 1]) for k in range(len(cut)))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(cut), runs, hashlib.sha256(kept).hexdigest())
    assert repeats.remove_repeats(none).count() == 0


def test_repeats_ids(spark):
    """Repeated rows, one id with several texts, and null ids: every row comes back, judged by its own text."""
    rnd = random.Random(7)
    prose = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    a, b, c, d = (prose(200) for _ in range(4))
    rows = [(1, a), (2, a + b), (2, a + b), (2, b), (4, "xxxxx"), (4, b + "y" + c), (4, prose(60) + a[20:120]), (None, c + d), (None, c + d), (None, a), (None, None), (5, d + "z"), (3, "short"), (4, prose(70) + d)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, mark int").repartition(3)
    key = lambda i, t: (1 << 62) + 1 if i is None else i

    def kept(i, t):
        t = (t or "").encode()
        earlier = set()
        for j, u in rows:
            u = (u or "").encode()
            if key(j, u) < key(i, t):
                earlier |= {u[k : k + 50] for k in range(len(u) - 49)}
        cut = {k + x for k in range(len(t) - 49) if t[k : k + 50] in earlier for x in range(50)}
        return (i, len(t), len(cut), hashlib.sha256(bytes(x for k, x in enumerate(t) if k not in cut)).hexdigest())

    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(docs).collect()), key=str)
    assert got == sorted((kept(i, t) for i, t in rows), key=str)
    assert min(r[2] for r in got) == 0 and len(got) == len(rows)


def test_topk_ids(spark):
    """Equal rows count once; rows that share an id are queries and candidates of their own."""
    rows = [(0, [3, 1]), (0, [3, 1]), (0, [1, 5]), (1, [2, 2]), (1, [2, 2]), (1, [9, 0]), (2, [4, 4]), (3, [1, 1]), (None, [9, 9])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, vector array<bigint>, key int").repartition(3)
    got = sorted(map(tuple, topk.topk(vectors, vectors.where("vec_id = 0"), 3).collect()))
    distinct = {(i, tuple(v)) for i, v in rows if i is not None}
    want = []
    for i, q in distinct:
        if i == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in distinct if j != 0)[:3]
            want += [(0, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want) and len(got) == 6


def test_repeats_deals_anchors_evenly():
    """Before, the buckets were upper bits of least hashes: a few had most of the anchors, and a bucket is one task's work."""
    rng = np.random.default_rng(3)
    _, _, h = repeats.anchors([rng.integers(97, 123, 2000).astype(np.uint8).tobytes() for _ in range(400)])
    n = np.bincount((h >> np.uint64(40)).astype(np.int64), minlength=1 << repeats.BUCKET_BITS)
    assert len(n) == 1 << repeats.BUCKET_BITS and n.max() < 2 * n.mean() and n.min() > 0


def test_run_length_index_against_brute_force():
    rng = np.random.default_rng(4)
    for letters in (1, 3, 250):
        base = rng.integers(0, letters, 300).astype(np.uint8)
        texts = [base[a : a + n].tobytes() for a, n in zip(rng.integers(0, 220, 25), rng.integers(50, 81, 25), strict=True)]
        owner = rng.integers(0, 9, 25)
        places = [(i, k, t[k : k + repeats.MATCH]) for i, t in enumerate(texts) for k in range(len(t) - repeats.MATCH + 1)]
        least = {}
        for i, _, x in places:
            least[x] = min(owner[i], least.get(x, 9))
        sizes = np.array([len(t) for t in texts])
        index = repeats.RunLengthIndex(np.frombuffer(b"".join(texts), np.uint8), sizes, owner)
        got = sorted(zip(*map(list, index.stream(owner)), strict=True))
        assert got == [(i, k) for i, k, x in places if least[x] < owner[i]]
