"""Language-model scoring by Brown's class-based n-grams, with classes from exchange clustering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, as_bytes, chunks, drop_stash, mix, stash

#: Words whose counts and classes every task holds (others are joined), words that form the classes, classes, exchange passes.
FREQUENT, CORE, CLASSES, PASSES = 1 << 17, 2047, 32, 4
#: Bytes of input to a bucket, and the least and greatest log2 of the number of buckets.
BUCKET_BYTES, LEAST_BITS, MOST_BITS = 64 << 20, 8, 16
#: Marks a token whose class is looked up in the buckets.
RARE = 255
END = mix(np.array([0xE0D], U64))[0]
_EXACT = 4096


def _bin(c: np.ndarray) -> np.ndarray:
    """Bins of counts: exact below _EXACT, then 64 to each factor of e."""
    return np.where(c < _EXACT, c, _EXACT + np.floor(64 * np.log(np.maximum(c, _EXACT) / _EXACT))).astype(np.int64)


def _bits(df: DataFrame) -> int:
    """log2 of the number of buckets for a table, by the size that the optimizer expects (the least where it knows none)."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return LEAST_BITS if size >= 1 << 62 else min(MOST_BITS, max(LEAST_BITS, (size // BUCKET_BYTES).bit_length()))


def _dealt(key: np.ndarray, columns: list[np.ndarray], names: list[str], bits: int) -> pa.RecordBatch:
    """One row a bucket (the key's top bits), holding the columns' values as bytes."""
    bucket = (key >> U64(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, int)
    arrays = [pa.array(bucket[edges[:-1]].astype(np.int32))]
    arrays += [pa.array([c[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", *names])


def _gathered(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()] or [np.zeros(0, kind)])


def _summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(h, return_inverse=True)
    return keys, np.bincount(inverse, weights=c, minlength=len(keys)).astype(np.int64)


def _vocabulary(bits: int):
    def run(batches):
        h, c = np.zeros(0, U64), np.zeros(0, np.int64)
        for part in chunks(batches):
            words = Words(as_bytes(part.column(1)))
            keys, counts = np.unique(words.h, return_counts=True)
            h, c = _summed(np.concatenate((h, keys, [END])), np.concatenate((c, counts, [part.num_rows])))
            if len(h) > 2_000_000:
                yield _dealt(h, [h, c], ["hashes", "counts"], bits)
                h, c = h[:0], c[:0]
        if len(h):
            yield _dealt(h, [h, c], ["hashes", "counts"], bits)

    return run


def _merged(table: pa.Table) -> pa.Table:
    h, c = _summed(_gathered(table, "hashes", "<u8"), _gathered(table, "counts", "<i8"))
    return pa.table({"bucket": table["bucket"][:1], "types": [len(h)], "tokens": [int(c.sum())], "hashes": [h.tobytes()], "counts": [c.tobytes()]})


def _counts_of_counts(batches):
    for batch in batches:
        for x in batch.column(0).to_pylist():
            bins, n = np.unique(_bin(np.frombuffer(x, "<i8")), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n)], names=["bin", "n"])


def _sequence(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, end) of every token, ends included; the last gives the place of each text's end."""
    at = np.cumsum(words.count) + np.arange(n)
    h = np.empty(len(words.h) + n, U64)
    is_end = np.zeros(len(h), bool)
    is_end[at] = True
    h[is_end], h[~is_end] = END, words.h
    return h, np.repeat(np.arange(n), words.count + 1), at


def _around(token: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """What stands before and after every token; a text's first token follows an end, its end precedes its first token."""
    first = np.concatenate(([0], at[:-1] + 1)).astype(np.int64)[: len(at)]
    before, after = np.roll(token, 1), np.roll(token, -1)
    before[first], after[at] = end, token[first]
    return before, after


def _finder(keys: np.ndarray):
    order = np.argsort(keys)
    sorted_ = keys[order]

    def find(h):
        at = np.minimum(np.searchsorted(sorted_, h), len(keys) - 1)
        return np.where(sorted_[at] == h, order[at], len(keys)) if len(keys) else np.zeros(len(h), np.int64)

    return find


def _pairs(keys: np.ndarray, bits: int):
    def run(batches):
        find, side = _finder(keys), len(keys) + 1
        total = np.zeros(side * side, np.int64)
        end = int(find(np.array([END]))[0])
        for part in chunks(batches):
            h, _, at = _sequence(Words(as_bytes(part.column(1))), part.num_rows)
            token = find(h)
            total += np.bincount(_around(token, at, end)[0] * side + token, minlength=len(total))
        at = np.flatnonzero(total)
        if len(at):
            yield _dealt(at.astype(U64) * U64((1 << 64) // len(total)), [at, total[at]], ["cells", "counts"], bits)

    return run


def _pairs_merged(table: pa.Table) -> pa.Table:
    at, c = _summed(_gathered(table, "cells", "<i8"), _gathered(table, "counts", "<i8"))
    return pa.table({"bucket": table["bucket"][:1], "cells": [at.tobytes()], "counts": [c.tobytes()]})


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Classes of words (in order of frequency) that raise the likelihood of a class bigram model.

    Words start in classes by rank; each in turn moves to the class in which the likelihood is
    greatest, until a pass moves none. The last row and column (all other words) stay in a class of
    their own, numbered ``classes``.
    """
    n = len(pairs) - 1
    cls = np.append(np.arange(n) % classes, classes)
    member = np.zeros((n + 1, classes + 1))
    member[np.arange(n + 1), cls] = 1
    to, fro = pairs @ member, pairs.T @ member  # by class: what follows a word, what precedes it
    joint = member.T @ to
    for _ in range(passes):
        moved = 0
        for w in range(n):
            a, own = cls[w], pairs[w, w]
            right, left = to[w].copy(), fro[w].copy()
            right[a] -= own
            left[a] -= own
            joint[a, :] -= right
            joint[:, a] -= left
            joint[a, a] -= own
            row, col = joint.sum(axis=1), joint.sum(axis=0)
            gain = (_xlogx(joint + right) - _xlogx(joint)).sum(axis=1) + (_xlogx(joint.T + left) - _xlogx(joint.T)).sum(axis=1)
            d = np.diag(joint)
            gain += _xlogx(d + right + left + own) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d)
            gain -= _xlogx(row + right.sum() + own) - _xlogx(row) + _xlogx(col + left.sum() + own) - _xlogx(col)
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            joint[b, :] += right
            joint[:, b] += left
            joint[b, b] += own
            if b != a:
                moved += 1
                cls[w] = b
                to[:, a] -= pairs[:, w]
                to[:, b] += pairs[:, w]
                fro[:, a] -= pairs[w, :]
                fro[:, b] += pairs[w, :]
        if not moved:
            break
    return cls


def _counted(h: np.ndarray, code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of count by (h, code), sorted."""
    order = np.lexsort((code, h))
    h, code, count = h[order], code[order], count[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (code[1:] != code[:-1])))) if len(h) else np.zeros(0, int)
    return h[new], code[new], np.add.reduceat(count, new) if len(new) else count


def _contexts(keys: np.ndarray, cls: np.ndarray, bits: int):
    """Of every word but the core ones, how often it stands between which two classes, dealt by word."""

    def run(batches):
        find, side = _finder(keys), int(cls[-1]) + 1
        end = int(cls[find(np.array([END]))[0]])
        held, n = [], 0

        def flush():
            h, code, count = _counted(*(np.concatenate(x) for x in zip(*held)))
            return _dealt(h, [h, code, count.astype("<u4")], ["hashes", "codes", "counts"], bits)

        for part in chunks(batches):
            h, _, at = _sequence(Words(as_bytes(part.column(1))), part.num_rows)
            token = find(h)
            before, after = _around(cls[token], at, end)
            own = token == len(keys)
            held.append(_counted(h[own], (before * side + after)[own].astype("<u2"), np.ones(int(own.sum()), "<u4")))
            n += len(held[-1][0])
            if n > 2_000_000:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return run


def information(joint: np.ndarray) -> np.ndarray:
    """Pointwise mutual information of adjacent classes, from their counts with half a one added to each."""
    joint = joint + 0.5
    return np.log(joint * joint.sum()) - np.log(joint.sum(axis=1, keepdims=True)) - np.log(joint.sum(axis=0, keepdims=True))


def nearest(left: np.ndarray, right: np.ndarray, info: np.ndarray) -> np.ndarray:
    """For each word the class in which its contexts have the most mutual information with it; the first of equals.

    ``left`` and ``right`` count the classes before and after each word. This is the exchange
    criterion to first order, for a word that changes the counts of classes little.
    """
    k = len(info) - 1
    return np.argmax(np.round(left @ info[:, :k] + right @ info[:k].T, 9), axis=1)  # rounded, as sums taken in another order are equal


def _assigned(keys: np.ndarray, cls: np.ndarray, info: np.ndarray):
    """Puts every word of a bucket into a class: core words into their own, others into the nearest by context."""

    def run(vocabulary: pa.Table, contexts: pa.Table) -> pa.Table:
        if not vocabulary.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), **{n: pa.array([], pa.binary()) for n in ("hashes", "counts", "classes")}})
        side = len(info)
        words = _gathered(vocabulary, "hashes", "<u8")  # sorted
        found = np.append(cls[:-1], 0)[_finder(keys)(words)]
        h, code, count = _counted(*(_gathered(contexts, n, k) for n, k in (("hashes", "<u8"), ("codes", "<u2"), ("counts", "<u4"))))
        own = np.unique(h)
        at = np.searchsorted(own, h)
        chosen = np.zeros(len(own), np.int64)
        for a in range(0, len(own), 1 << 15):  # dense counts of so many words at a time
            m = min(1 << 15, len(own) - a)
            lo, hi = np.searchsorted(at, (a, a + m))
            row = (at[lo:hi] - a) * side
            table = lambda context: np.bincount(row + context, weights=count[lo:hi], minlength=m * side).reshape(m, side)  # noqa: B023, E731
            chosen[a : a + m] = nearest(table(code[lo:hi] // side), table(code[lo:hi] % side), info)
        found[np.searchsorted(words, own)] = chosen
        return pa.table({"bucket": vocabulary["bucket"][:1], "hashes": [words.tobytes()], "counts": vocabulary["counts"][:1].cast(pa.binary()), "classes": [found.astype("u1").tobytes()]})

    return run


def _totals(batches):
    for batch in batches:
        for counts, classes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts, classes = np.frombuffer(counts, "<i8"), np.frombuffer(classes, "u1")
            found, inverse = np.unique(classes, return_inverse=True)
            tokens = np.zeros(len(found), np.int64)
            np.add.at(tokens, inverse, counts)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(tokens), pa.array(np.bincount(inverse, minlength=len(found)))], names=["cls", "tokens", "types"])


def _top(vocabulary: DataFrame, limit: int) -> tuple[np.ndarray, ...]:
    """About ``limit`` words of the greatest counts, and the end: hashes, counts, and classes if there are any.

    Of the words of the least count taken, those whose hashes are under a threshold are taken, so
    that a vocabulary in which one count is very common is bounded too.
    """
    counts = vocabulary.select("counts").mapInArrow(_counts_of_counts, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    cut, share, upto = -1, 1.0, 0
    for row in sorted(counts.collect(), reverse=True):  # a few thousand bins, whatever the input
        if upto + row.n > limit:
            cut, share = row.bin, (limit - upto) / row.n
            break
        upto += row.n
    below = U64(min(int(share * 2.0**64), (1 << 64) - 1))
    names = [n for n in ("hashes", "counts", "classes") if n in vocabulary.columns]
    kinds = {"hashes": "<u8", "counts": "<i8", "classes": "u1"}

    def picked(batches):
        for batch in batches:
            for values in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                values = [np.frombuffer(x, kinds[n]) for n, x in zip(names, values)]
                bins = _bin(values[1])
                pick = (bins > cut) | ((bins == cut) & (values[0] < below)) | (values[0] == END)
                yield pa.RecordBatch.from_arrays([pa.array(x[pick].view("<i8") if i == 0 else x[pick].astype("<i8")) for i, x in enumerate(values)], names=names)

    table = vocabulary.select(*names).mapInArrow(picked, ", ".join(f"{n} long" for n in names)).toPandas()
    table = table.sort_values(["counts", "hashes"], ascending=[False, True])
    found = [table[n].to_numpy(np.int64) for n in names]
    return (found[0].view(U64), *found[1:])


_KINDS = "doc_id long, doc_key long, n_tokens long, n_known long, logs double, classes binary, bucket int, hashes binary, docs binary, places binary"


def _classed(table, bits: int):
    """Per text its tokens' classes, a byte each, and what its frequent words give; and the places of the infrequent ones, dealt by word."""

    def run(batches):
        keys, counts, cls = table.value
        find, logs = _finder(keys), np.append(np.log10(counts + 0.5), 0.0)
        cls, names = np.append(cls, RARE).astype("u1"), [x.split()[0] for x in _KINDS.split(", ")]
        # keys are written with the rows by one attempt of a task, so all rows of a text agree on its key
        key = TaskContext.get().partitionId() << 40
        for part in chunks(batches):
            n = part.num_rows
            h, doc, at = _sequence(Words(as_bytes(part.column(1))), n)
            token = find(h)
            own = np.arange(key, key + n)
            key += n
            frequent = token < len(keys)
            per_text = lambda x: np.bincount(doc, weights=x, minlength=n)  # noqa: B023, E731
            offsets = np.concatenate(([0], at + 1)).astype("<i4")
            classes = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(cls[token]))])
            none = [pa.nulls(n, t) for t in (pa.int32(), *(pa.binary(),) * 3)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(own), pa.array(np.diff(offsets).astype(np.int64)), pa.array(per_text(frequent).astype(np.int64)), pa.array(per_text(logs[token])), classes, *none], names=names
            )
            rare = np.flatnonzero(~frequent)
            if len(rare):
                dealt = _dealt(h[rare], [h[rare], own[doc[rare]], (rare - offsets[doc[rare]]).astype("<i4")], ["hashes", "docs", "places"], bits)
                none = [pa.nulls(dealt.num_rows, t) for t in (*(pa.int64(),) * 4, pa.float64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, *dealt.columns], names=names)

    return run


def _looked_up(unknown: int, bits: int):
    """Classes and log10(count + 0.5) of a bucket's infrequent words, dealt by document; unknown words have a class of their own."""

    def run(tokens: pa.Table, vocabulary: pa.Table) -> pa.Table:
        names = ["docs", "places", "classes", "logs"]
        if not tokens.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), **{n: pa.array([], pa.binary()) for n in names}})
        at = _finder(_gathered(vocabulary, "hashes", "<u8"))(_gathered(tokens, "hashes", "<u8"))
        counts, classes = np.append(_gathered(vocabulary, "counts", "<i8"), 0), np.append(_gathered(vocabulary, "classes", "u1"), unknown).astype("u1")
        docs = _gathered(tokens, "docs", "<i8")
        columns = [docs, _gathered(tokens, "places", "<i4"), classes[at], np.log10(counts[at] + 0.5)]
        return pa.Table.from_batches([_dealt(mix(docs.view(U64)), columns, names, bits)])

    return run


def _by_document(unknown: int):
    def run(table: pa.Table) -> pa.Table:
        docs, places, classes, logs = (_gathered(table, n, k) for n, k in (("docs", "<i8"), ("places", "<i4"), ("classes", "u1"), ("logs", "<f8")))
        order = np.lexsort((places, docs))
        docs, places, classes, logs = docs[order], places[order], classes[order], logs[order]
        own, first = np.unique(docs, return_index=True)
        edges = np.append(first, len(docs))
        cut = lambda x: [x[a:b].tobytes() for a, b in zip(edges, edges[1:])]
        return pa.table({"doc": own, "rare_places": cut(places), "rare_classes": cut(classes), "rare_log": np.add.reduceat(logs, first), "rare_known": np.add.reduceat((classes != unknown).astype(np.int64), first)})

    return run


def classes_of(df: DataFrame, table, vocabulary: DataFrame, unknown: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_tokens, n_known, logs, classes, rare_places, rare_classes) of texts, and the stashed table behind it.

    ``classes`` has a byte for each token; those of infrequent words, looked up in the vocabulary's
    buckets, are in the last two columns, to be set at their places. No row takes part in another's.
    """
    written = stash(df.mapInArrow(_classed(table, bits), _KINDS), "lm-classed")
    rare = written.where("bucket is not null").select("bucket", "hashes", "docs", "places")
    found = rare.groupBy("bucket").cogroup(vocabulary.groupBy("bucket")).applyInArrow(_looked_up(unknown, bits), "bucket int, docs binary, places binary, classes binary, logs binary")
    found = found.groupBy("bucket").applyInArrow(_by_document(unknown), "doc long, rare_places binary, rare_classes binary, rare_log double, rare_known long")
    rows = written.where("bucket is null")
    zero = F.lit(0)
    return rows.join(found, rows["doc_key"] == found["doc"], "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", zero)).alias("n_known"),
        (F.col("logs") + F.coalesce("rare_log", zero)).alias("logs"),
        "classes",
        "rare_places",
        "rare_classes",
    ), written


def _filled(part: pa.RecordBatch, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class before, class, text) of every token of rows from classes_of."""
    classes = part.column(4).to_pylist()
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, classes), np.int64, len(classes)))))
    token = np.frombuffer(b"".join(classes), "u1").astype(np.int64)
    for start, places, found in zip(offsets, part.column(5).to_pylist(), part.column(6).to_pylist()):
        if places:
            token[start + np.frombuffer(places, "<i4")] = np.frombuffer(found, "u1")
    before, _ = _around(token, offsets[1:] - 1, end)
    return before, token, np.repeat(np.arange(len(classes)), np.diff(offsets))


def _transitions(side: int, end: int):
    def run(batches):
        total = np.zeros(side * side, np.int64)
        for part in chunks(batches, column=4):
            before, token, _ = _filled(part, end)
            total += np.bincount(before * side + token, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    return run


class Model:
    """Class-transition and class-emission logarithms (base 10); the last class is that of unknown words."""

    def __init__(self, joint: np.ndarray, tokens: np.ndarray, types: np.ndarray):
        k = len(joint)
        self.transition = np.log10(joint + 0.5) - np.log10(joint.sum(axis=1, keepdims=True) + 0.5 * k)
        self.transition[-1] = np.log10(joint.sum(axis=0) + 0.5) - np.log10(joint.sum() + 0.5 * k)  # nothing was seen after an unknown word
        self.floor = np.log10(np.maximum(tokens + 0.5 * types, 0.5))  # a class may have no words


def _scores(model: Model, end: int, base_floor: float):
    def run(batches):
        for part in chunks(batches, column=4):
            before, token, doc = _filled(part, end)
            logs, n = part.column(3).to_numpy(), part.column(1).to_numpy()
            own = np.bincount(doc, weights=model.transition[before, token] - model.floor[token], minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(logs - n * base_floor), pa.array(logs + own)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def lm_scores(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every text by a class-based bigram model and by a unigram model, both learnt from ``training``.

    Every training word gets one of CLASSES classes. The CORE most frequent form them, by exchange
    clustering on the counts of all their adjacent pairs. Each other word, however rare, is put into
    the class in which the classes before and after all its occurrences have the most mutual
    information with it (the exchange criterion to first order); those contexts are gathered by word
    in buckets, so their number grows with the input. Transitions are then counted between the
    classes of all training tokens. The probability of a token is that of its class after the class
    before, times that of the word in its class, each with half a count added; words not seen in
    training are one further class, after which classes come with their overall frequencies.

    Tasks hold the counts and classes of about FREQUENT words; those of the others are joined,
    bucket by bucket, so no vocabulary of unbounded size is broadcast.

    Tokens are lower-cased words and one end. Null and empty texts have only the end. Words are
    known by 64-bit hashes. Null and repeated ids are kept, each row scored by itself. Without
    training rows every count is 0. Extra columns are ignored.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    picked = lambda df: df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs, training = picked(docs), picked(training)
    bits = _bits(training)
    counted = training.mapInArrow(_vocabulary(bits), "bucket int, hashes binary, counts binary").groupBy("bucket").applyInArrow(_merged, "bucket int, types long, tokens long, hashes binary, counts binary")
    counted = stash(counted, "lm-counts")
    types, tokens = (x or 0 for x in counted.agg(F.sum("types"), F.sum("tokens")).first())

    core, _ = _top(counted.select("hashes", "counts"), CORE)
    pairs = np.zeros((len(core) + 1) ** 2)
    merged = training.mapInArrow(_pairs(core, bits), "bucket int, cells binary, counts binary").groupBy("bucket").applyInArrow(_pairs_merged, "bucket int, cells binary, counts binary")
    for row in merged.toLocalIterator():  # at most about (CORE + 1)**2 cells
        pairs[np.frombuffer(row.cells, "<i8")] = np.frombuffer(row.counts, "<i8")
    pairs = pairs.reshape(len(core) + 1, -1)
    cls = exchange(pairs, min(CLASSES, max(1, len(core))))
    k = int(cls[-1])  # classes; also the number of the class of unknown words
    member = np.zeros((len(cls), k + 1))
    member[np.arange(len(cls)), cls] = 1

    contexts = training.mapInArrow(_contexts(core, cls, bits), "bucket int, hashes binary, codes binary, counts binary")
    vocabulary = counted.select("bucket", "hashes", "counts").groupBy("bucket").cogroup(contexts.groupBy("bucket"))
    vocabulary = stash(vocabulary.applyInArrow(_assigned(core, cls, information(member.T @ pairs @ member)), "bucket int, hashes binary, counts binary, classes binary"), "lm-vocabulary")
    drop_stash(counted)
    in_class, size = np.zeros(k + 1), np.zeros(k + 1)
    size[k] = 1  # a place for unknown words
    for row in vocabulary.select("counts", "classes").mapInArrow(_totals, "cls int, tokens long, types long").groupBy("cls").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).collect():
        in_class[row.cls], size[row.cls] = row.tokens, row.types

    table = _top(vocabulary, FREQUENT)
    end = int(np.append(table[2], k)[_finder(table[0])(np.array([END]))[0]])
    table = spark.sparkContext.broadcast(table)
    learnt, written = classes_of(training, table, vocabulary, k, bits)
    joint = np.zeros((k + 1) ** 2)
    for row in learnt.mapInArrow(_transitions(k + 1, end), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # (CLASSES + 1)**2 cells
        joint[row.cell] = row.n
    drop_stash(written)
    model = Model(joint.reshape(k + 1, -1), in_class, size)

    scored, _ = classes_of(docs, table, vocabulary, k, bits)
    scored = scored.mapInArrow(_scores(model, end, float(np.log10(tokens + 0.5 * (types + 1)))), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score")


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model learnt from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    return lm_scores(docs, docs.where(~held)).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
