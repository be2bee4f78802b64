"""Decontamination against brute force: nulls, short items, repeated words, ids and rows, separators, the way without broadcasts."""

import hashlib
import random
import re

import pytest

from webloom.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items, width=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, of = words(t), set(), set()
        for phrase, ids in windows.items():
            n = len(phrase)
            at = [k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) == phrase]
            hit |= {k + d for k in at for d in range(n)}
            of |= ids if at else set()
        out.append((i, len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables():
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("aeiouéÉstrn") for _ in range(rnd.randint(1, 4))) for _ in range(40)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(k, prose(rnd.randint(11, 30))) for k in range(8)]
    items += [(20, "only three words"), (21, "Word"), (22, None), (23, " -- "), (24, ""), (20, prose(12)), (None, prose(14)), (30, items[0][1]), (31, "the " * 14), (32, "never seen before zebra quagga")]
    docs = [(k, prose(rnd.randint(0, 60))) for k in range(40)]
    docs += [(100 + k, prose(5) + "—" + (t or "").replace(" ", rnd.choice([" ", ", ", "\n"])).upper() + "! " + prose(9)) for k, (_, t) in enumerate(items)]
    part = words(items[1][1])
    docs += [(200, " ".join(part[:10])), (201, " ".join(part[:9])), (202, "'" + " ".join(part[1:11]) + " x " + " ".join(part[:11])), (203, "the " * 40), (204, None), (205, ""), (206, "... only, three; words"), (207, "word-word_word9 WORD")]
    docs += [(None, items[2][1]), (None, None), (200, items[3][1]), (200, " ".join(part[:10])), (300, prose(2000) + " " + items[4][1] + " " + prose(2000) + items[4][1])]
    # one word more between the rarest terms: near, but no phrase
    docs += [(400, " ".join(part[:5] + ["zz"] + part[5:11]))]
    return docs, items


@pytest.mark.parametrize("most", [4 << 20, 0])
def test_decontaminate(spark, monkeypatch, most):
    monkeypatch.setattr(D, "BROADCAST_BYTES", most)
    docs, items = tables()
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, term string, start int").repartition(3)
    i = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, n int")
    got = D.decontaminate(d, i)
    rows = got.collect()
    assert sorted([tuple(r)[:6] for r in rows], key=str) == brute(docs, items)
    assert all(r.n_near >= r.n_items for r in rows)
    assert next(r for r in rows if r.doc_id == 400).n_near >= 1 and not next(r for r in rows if r.doc_id == 400).contaminated
    matches, _ = D.find_matches(d, i)
    spans = {r.doc_id: r.spans for r in matches.collect()}
    assert [(s.start, s.len) for s in sorted(spans[206], key=lambda s: s.start)] == [(1, 3)]  # text begins with separators: places from 1


def test_narrow_windows_and_empty_tables(spark):
    docs, items = tables()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = D.decontaminate(d, i, width=3).drop("n_near")
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 3)
    assert D.decontaminate(d.limit(0), i).count() == 0
    clean = D.decontaminate(d, i.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r.contaminated or r.n_hit for r in clean)
