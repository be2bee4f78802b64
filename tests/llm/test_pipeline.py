"""The pipeline's stages on a small fixture with nulls, empties, repeated rows and ids, clashing columns and a very long text; all stages against their parts."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from webloom.llm import mixing, pieces, quality_rules, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, base string, kept string, _key string"


def _rows():
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choice("aeioustrn") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base, other = prose(120), prose(90)
    near = base.split()
    near[70] = "changed"
    long = prose(800_000)  # over 4 MB
    texts = [(0, base), (1, " ".join(near)), (2, None), (3, ""), (4, "few words"), (5, other + " password: hunter22xy"), (6, long), (7, prose(80)), (7, prose(85)), (None, prose(95)), (None, base), (8, prose(70)), (8, None)]
    texts += [(8, texts[-2][1])] + [(20 + k, prose(rnd.randint(60, 110))) for k in range(30)]
    return [(i, t, None if k % 9 == 4 else "en", None if k % 11 == 3 else f"s{k % 3}", len(t or ""), "clash", "clash", "clash") for k, (i, t) in enumerate(texts)]


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _bag(df):
    return Counter((r.doc_id, r.text, r.lang, r.source) for r in df.collect())


ALL = Counter(r[:4] for r in ROWS)


def test_quality_rules_stage(spark, docs, none):
    got = pipeline.quality_rules(spark, docs, "")
    assert got.columns == list(pipeline.COLUMNS)
    words = lambda t: len(WORD.findall(t or ""))
    kept = _bag(got)
    assert all(words(k[1]) >= 50 and n == ALL[k] for k, n in kept.items())
    want = Counter(r[:4] for r in ROWS if words(r[1]) >= 50)
    judged = quality_rules.judge_quality(docs.withColumn("doc_id", pipeline.F.xxhash64("doc_id", "text", "lang", "source")))
    assert sum(kept.values()) == judged.where("kept").count() <= sum(want.values())
    assert pipeline.quality_rules(spark, none, "").count() == 0


def test_near_duplicates_stage(spark, docs, none):
    got = pipeline.near_duplicates(spark, docs, "")
    assert got.columns == list(pipeline.COLUMNS)
    kept = _bag(got)
    assert max(kept.values()) == 1
    sets = {}
    for r in ROWS:
        w = WORD.findall((r[1] or "").lower())
        sets[r[:2]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    group = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = group[b], group[a]
                group = {k: new if v == old else v for k, v in group.items()}
    assert sorted(Counter(group[k[:2]] for k in kept).values()) == [1] * len(set(group.values()))
    assert {k[0] for k in kept if group[k[:2]] == group[(0, ROWS[0][1])]} == {0}
    assert pipeline.near_duplicates(spark, none, "").count() == 0


def test_secrets_stage(spark, docs, none):
    got = pipeline.secrets(spark, docs, "")
    assert got.columns == list(pipeline.COLUMNS) and got.count() == len(ROWS)
    texts = Counter(r.text for r in got.collect())
    masked = [t for t in texts if t and secrets.MASK in t]
    assert len(masked) == 1 and "hunter22xy" not in masked[0]
    assert texts - Counter(masked) == Counter(r[1] for r in ROWS if not (r[1] and "hunter22xy" in r[1]))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())
    assert pipeline.secrets(spark, none, "").count() == 0


def test_mixing_stage(spark, docs, none):
    got = pipeline.mixing(spark, docs, "")
    assert got.columns == list(pipeline.COLUMNS)
    keyed = docs.withColumn("doc_id", pipeline.F.xxhash64("doc_id", "text", "lang", "source"))
    want = sum(r.copies for r in mixing.pareto_mix(keyed).collect())
    taken = _bag(got)
    assert sum(taken.values()) == want and set(taken) <= set(ALL) and all(n <= 2 * ALL[k] for k, n in taken.items())
    assert taken == _bag(pipeline.mixing(spark, docs, "")) and pipeline.mixing(spark, none, "").count() == 0


def test_run(spark, docs, tmp_path):
    few = docs.where("length(text) < 100000 or text is null").drop("base", "kept", "_key")
    few.write.parquet(f"{tmp_path}/documents.parquet")
    got = pipeline.run(spark, str(tmp_path))
    step = few
    for _, stage in pipeline.STAGES[:-1]:
        step = stage(spark, step, "")
    want = Counter((r.doc_id, tuple(r.token_ids)) for r in pieces.encode(step).collect())
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in got.collect()) == want and want
