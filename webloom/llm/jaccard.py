"""N-gram Jaccard join by multiple-global-order filtering."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, as_bytes, chunks, drop_stash, give_back, mix, shingles, stash
from .components import components

WIDTH, PERCENT = 5, 75
#: log2 of the counters of the frequency sketch (its size is fixed, so it may be broadcast), and of its slices.
SKETCH_BITS, SLICE_BITS = 22, 16
#: Bits of a token in a list and in a stored set; least log2 of the buckets of lists; bytes of postings that a bucket should hold.
TOKEN_BITS, LEAST_BUCKET_BITS, BUCKET_BYTES = 56, 10, 8 << 20
#: Postings that a task gathers before it hands them on.
FLUSH = 300_000
#: Documents from which a token's list is parted by document, each part with a leader of its own.
LONG_LIST = 1 << 17
#: Comparisons within one list from which it is parted by the tokens of the second order.
HEAVY_LIST = 1 << 26
#: Ids of which a broadcast may hold so many.
FEW = 500_000
#: Bytes of text hashed at a time: a worker takes some fifty times as much while it does.
SLICE_BYTES = 1 << 19
#: Bits of a parity signature (fixed), and comparisons made at a time.
PARITY_BITS, BLOCK = 512, 1 << 18
_ORDERS = (U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25))  # of the second and third order
_TOKEN_SALT, _PART = U64(99), U64(0xD1342543DE82EF95)


def _prefix(n: np.ndarray) -> np.ndarray:
    """Tokens of a set of n of which any set as similar as PERCENT must share one, under whatever order."""
    return n - (PERCENT * n + 99) // 100 + 1


def _most_apart(total: np.ndarray) -> np.ndarray:
    """Tokens that two sets of ``total`` tokens together may hold alone and still reach PERCENT."""
    return total - 2 * -(-PERCENT * total // (100 + PERCENT))


def _node(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprints of the sets that begin at ``first``: what stands for a set, so copies are one node."""
    if not len(first):
        return np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(s))).astype(U64)
    return mix(np.add.reduceat(mix(s), first) ^ mix(size)).view(np.int64)


def _count(batches):
    """Rows of documents (id, row key, set size, node), then this task's slices of the frequency sketch."""
    names = ["doc_id", "key", "n", "node", "slice", "counts"]
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    for part in chunks(batches, SLICE_BYTES, 2):
        doc, s = shingles(Words(as_bytes(part.column(2))), WIDTH)
        np.add.at(counts, (s >> U64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
        n = np.bincount(doc, minlength=part.num_rows)
        node = np.zeros(part.num_rows, np.int64)
        node[n > 0] = _node(s, np.searchsorted(doc, np.flatnonzero(n)))
        none = [pa.nulls(part.num_rows, pa.int32()), pa.nulls(part.num_rows, pa.binary())]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(node), *none], names=names)
    size = 1 << SLICE_BITS
    for k in range(len(counts) // size):
        own = np.minimum(counts[k * size : (k + 1) * size], 65535).astype("<u2")
        if own.any():
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([k], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)])], names=names)


def _levels(table: pa.Table) -> pa.Table:
    """Frequency levels of a slice: 0 up to chance (mean and three deviations), then by the logarithm of the excess."""
    total = sum(np.frombuffer(zlib.decompress(x), "<u2").astype(np.float64) for x in table["counts"].to_pylist())
    mean = np.median(total)
    level = np.minimum(255, 8 * np.log2(np.maximum(1, total - mean - 3 * np.sqrt(mean)))).astype(np.uint8)
    return pa.table({"slice": table["slice"][:1], "levels": pa.array([level.tobytes()])})


def _level_of(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    return level[s >> U64(TOKEN_BITS - SKETCH_BITS)]


def _token(s: np.ndarray) -> np.ndarray:
    return mix(s ^ _TOKEN_SALT) >> U64(64 - TOKEN_BITS)


def _short(s: np.ndarray, drop: int = 64 - TOKEN_BITS) -> bytes:
    """The upper TOKEN_BITS of shingles, or tokens as they are, in as many bytes."""
    return np.ascontiguousarray((s >> U64(drop)).astype("<u8")[:, None].view(np.uint8)[:, : TOKEN_BITS // 8]).tobytes()


def _packed(bucket: np.ndarray, token: np.ndarray, doc: np.ndarray, common: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    bucket, token, doc, common = bucket[order], token[order], doc[order], common[order]
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    tokens = [_short(token[a:b], 0) for a, b in zip(edges, edges[1:])]
    docs = [doc[a:b].astype("<i8").tobytes() for a, b in zip(edges, edges[1:])]
    shares = [common[a:b].tobytes() for a, b in zip(edges, edges[1:])]
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]].astype(np.int32)), pa.array(tokens), pa.array(docs), pa.array(shares)], names=["bucket", "tokens", "docs", "common"])


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, TOKEN_BITS // 8)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : TOKEN_BITS // 8] = raw
    return out.view("<u8").ravel()


def _parts(level: np.ndarray, node: np.ndarray, long_list: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of its token's list in which a document stands, and whether there are others: as many as the token's frequency asks for."""
    parts = np.maximum(1, np.ceil(np.exp2(level / 8) / long_list)).astype(U64)
    return mix(node.view(U64)) % parts, parts > 1


def _postings(levels, bits: int, long_list: int):
    def run(batches):
        level = np.frombuffer(levels.value, np.uint8)
        seen: set[int] = set()  # sets of this task
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            token, part, doc, common = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            place = mix(token + part * _PART) >> U64(64 - bits)
            return _packed(place.astype(np.int64), token, doc, common)

        for part in chunks(batches, SLICE_BYTES, 0):
            doc, s = shingles(Words(as_bytes(part.column(0))), WIDTH)
            if not len(s):
                continue
            n = np.bincount(doc, minlength=part.num_rows)
            some = np.flatnonzero(n)
            first = np.searchsorted(doc, some)
            node = np.zeros(part.num_rows, np.int64)
            node[some] = _node(s, first)
            fresh = np.zeros(part.num_rows, bool)
            for i, mark in zip(some.tolist(), node[some].tolist(), strict=True):
                if mark not in seen:
                    seen.add(mark)
                    fresh[i] = True
            s = s >> U64(64 - TOKEN_BITS)
            own = _level_of(s, level)
            order = np.lexsort((mix(s), own, doc))
            doc, s, own = doc[order], s[order], own[order]
            nth = np.arange(len(doc)) - np.repeat(first, n[some])
            pick = (nth < _prefix(n)[doc]) & fresh[doc]
            # share of a prefix that is frequent, in 127ths: high for a text whose copies were changed, low for those with many changes
            often = np.bincount(doc[pick], weights=own[pick] > 0, minlength=part.num_rows)
            common = (127 * often / np.maximum(1, _prefix(n))).astype(np.uint8)
            ids = node[doc[pick]]
            place, parted = _parts(own[pick].astype(float), ids, long_list)
            held.append((_token(s[pick]), place, ids, common[doc[pick]] << 1 | parted))
            if sum(len(x[0]) for x in held) >= FLUSH:
                yield flush()
        if held:
            yield flush()
        give_back()

    return run


def _lists(table: pa.Table) -> pa.Table:
    """Nodes that share a prefix token (and a part of its list): (token, doc, lead), lead being that with the most frequent prefix, then the least.

    A node alone in its list is left out, but not one alone in a part of a list, as it meets the other parts' nodes later.
    """
    token = np.concatenate([_unpack(x) for x in table["tokens"].to_pylist()])
    doc = np.concatenate([np.frombuffer(x, "<i8") for x in table["docs"].to_pylist()])
    common = np.frombuffer(b"".join(table["common"].to_pylist()), np.uint8)
    order = np.lexsort((doc, 127 - (common >> 1), token))
    token, doc, parted = token[order], doc[order], (common[order] & 1).astype(bool)
    new = np.concatenate(([True], (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])))
    token, doc, parted = token[new], doc[new], parted[new]
    start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    size = np.diff(np.append(start, len(token)))
    lead = np.repeat(doc[start], size)
    many = np.repeat(size > 1, size) | parted
    return pa.table({"token": token[many].view(np.int64), "doc": doc[many], "lead": lead[many]})


def _bits(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word and the bit of a parity signature on which each token falls."""
    place = mix(s ^ U64(7))
    return (place >> U64(6) & U64(PARITY_BITS // 64 - 1)).astype(np.int64), U64(1) << (place & U64(63))


def suffix_parity(s: np.ndarray, upto: int) -> np.ndarray:
    """Row i: on which bits an odd number of the tokens from place i on falls, for the first ``upto`` places of an ordered set."""
    word, bit = _bits(s)
    width = PARITY_BITS // 64
    each = np.zeros((upto + 1, width), U64)
    each[np.arange(1, upto), word[: upto - 1]] = bit[: upto - 1]
    for w in range(width):
        own = bit[word == w]
        each[0, w] = np.bitwise_xor.reduce(own) if len(own) else 0
    return np.bitwise_xor.accumulate(each[:upto], axis=0)


def _heads(s: np.ndarray) -> list[np.ndarray]:
    """Under each further order, the tokens of the prefix."""
    p = int(_prefix(np.int64(len(s))))
    out = []
    for salt in _ORDERS:
        rank = mix(s ^ salt)
        out.append(np.partition(rank, p - 1)[:p])
    return out


def _sketch(head: np.ndarray) -> int:
    """64 bits on which a prefix's tokens fall: prefixes that share a token share a bit."""
    return int(np.bitwise_or.reduce(U64(1) << (head & U64(63))).view(np.int64))


def _sets(batches):
    """(doc, n, tokens): one row a node with its distinct shingles, sorted."""
    seen: set[int] = set()
    for part in chunks(batches, SLICE_BYTES, 0):
        doc, s = shingles(Words(as_bytes(part.column(0))), WIDTH)
        bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
        some = np.flatnonzero(np.diff(bounds))
        node = _node(s, bounds[some])
        fresh = [k for k, mark in enumerate(node.tolist()) if mark not in seen and not seen.add(mark)]
        tokens = [_short(s[bounds[some[k]] : bounds[some[k] + 1]]) for k in fresh]
        yield pa.RecordBatch.from_arrays([pa.array(node[fresh]), pa.array(np.diff(bounds)[some][fresh]), pa.array(tokens, pa.binary())], names=["doc", "n", "tokens"])


_SIGNED = "key long, doc long, label long, n long, place int, second long, third long, parity binary"


def _signed(levels):
    """Postings of a node's lists that hold several components: its place in each, sketches of its prefixes under the
    further orders, and the parity of what follows the place. A heavy list is dealt by the second order's prefix."""

    def run(batches):
        level = np.frombuffer(levels.value, np.uint8)
        names = [x.split()[0] for x in _SIGNED.split(", ")]
        for batch in batches:
            for doc, label, data, wanted, heavy in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                s = _unpack(data)
                s = s[np.lexsort((mix(s), _level_of(s, level)))]
                p = int(_prefix(np.int64(len(s))))
                token, place = np.unique(_token(s[:p]), return_index=True)  # the first place of equal tokens
                wanted = np.array(wanted, np.int64).view(U64)
                at = np.searchsorted(token, wanted)
                at = np.minimum(at, len(token) - 1)
                pick = token[at] == wanted
                heavy, place, key = np.array(heavy, bool)[pick], place[at[pick]], wanted[pick]
                parity = suffix_parity(s, p)
                heads = _heads(s)
                second, third = map(_sketch, heads)
                if heavy.any():
                    deal = [np.flatnonzero(~heavy), np.repeat(np.flatnonzero(heavy), p)]
                    finer = mix(key[deal[1]] ^ mix(np.tile(heads[0], int(heavy.sum()))))
                    key, place = np.concatenate((key[deal[0]], finer)), place[np.concatenate(deal)]
                k = len(key)
                for a in range(0, k, 4096):
                    rows = slice(a, min(k, a + 4096))
                    m = rows.stop - a
                    columns = [pa.array(key[rows].view(np.int64)), pa.array(np.full(m, doc)), pa.array(np.full(m, label)), pa.array(np.full(m, len(s))), pa.array(place[rows].astype(np.int32)), pa.array(np.full(m, second)), pa.array(np.full(m, third))]
                    blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PARITY_BITS // 8), m, [None, pa.py_buffer(np.ascontiguousarray(parity[place[rows]]).tobytes())])
                    yield pa.RecordBatch.from_arrays([*columns, blob.cast(pa.binary())], names=names)
        give_back()

    return run


def _apart(key: np.ndarray, label: np.ndarray, n: np.ndarray, place: np.ndarray, heads: np.ndarray, parity: np.ndarray):
    """Places (i, j) of pairs of one list and of different labels that pass all filters; rows are sorted by (key, n).

    The most frequent label of a list is compared with the others only, so a list that is all but one
    component takes time in proportion to its rows. Of a pair that reaches PERCENT, the first token
    that both have under the first order lies in both prefixes. There, all tokens before it are of
    one set alone, and those after it differ on as many tokens as their parities differ on bits, or
    more; both together must not pass what PERCENT allows. Under each further order the prefixes
    share a token, so their sketches share a bit.
    """
    nth = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
    order = np.lexsort((label, nth))
    edge = np.flatnonzero(np.concatenate(([True], (nth[order][1:] != nth[order][:-1]) | (label[order][1:] != label[order][:-1]))))
    times = np.diff(np.append(edge, len(key)))
    of = nth[order][edge]
    most = np.zeros(int(nth[-1]) + 1 if len(nth) else 0, np.int64)
    best = np.lexsort((times, of))  # the last of a list is its most frequent label
    most[of[best]] = label[order][edge][best]
    other = label != most[nth]
    step = int(n.max(initial=0)) * 2 + 2
    line = nth * step + n
    rows = np.flatnonzero(other)
    low = np.searchsorted(line, nth[rows] * step + -(-PERCENT * n[rows] // 100), side="left")
    high = np.searchsorted(line, nth[rows] * step + np.minimum(n[rows] * 100 // PERCENT, step - 1), side="right")
    width = high - low
    upto = np.concatenate(([0], np.cumsum(width)))
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + BLOCK, side="right")) - 1)
        for a in range(int(upto[at]), int(upto[to]), 4 * BLOCK):  # one row alone may have many partners
            b = min(int(upto[to]), a + 4 * BLOCK)
            pair = np.arange(a, b)
            row = np.searchsorted(upto, pair, side="right") - 1
            i, j = rows[row], low[row] + pair - upto[row]
            pick = (label[i] != label[j]) & (~other[j] | (i < j))
            for head in heads:
                pick &= (head[i] & head[j]) != 0
            i, j = i[pick], j[pick]
            left = _most_apart(n[i] + n[j]) - place[i] - place[j]
            i, j, left = i[left >= 0], j[left >= 0], left[left >= 0]
            for word in parity.T:
                left = left - np.bitwise_count(word[i] ^ word[j])
                i, j, left = i[left >= 0], j[left >= 0], left[left >= 0]
            yield i, j
        at = to


def _cross(table: pa.Table) -> pa.Table:
    """Distinct pairs of nodes of one list and of different components that pass the filters of all orders."""
    key, doc, label, n, place, second, third = (table[c].to_numpy() for c in ("key", "doc", "label", "n", "place", "second", "third"))
    parity = np.frombuffer(b"".join(table["parity"].to_pylist()), "<u8").reshape(-1, PARITY_BITS // 64)
    order = np.lexsort((n, key))
    key, doc, label, n, place, second, third, parity = (x[order] for x in (key, doc, label, n, place.astype(np.int64), second, third, parity))
    found, held = np.zeros((0, 2), np.int64), []
    for i, j in _apart(key, label, n, place, np.stack((second, third)), parity):
        if len(i):
            held.append(np.stack((np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])), axis=1))
        if sum(map(len, held)) > 4 * BLOCK:
            found, held = np.unique(np.concatenate((found, *held)), axis=0), []
    if held:
        found = np.unique(np.concatenate((found, *held)), axis=0)
    if table.nbytes > 8 << 20:
        give_back()
    return pa.table({"a": np.ascontiguousarray(found[:, 0]), "b": np.ascontiguousarray(found[:, 1])})


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach PERCENT: sizes, then prefixes under the further orders, then the sets."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < PERCENT * large:
        return False
    for one, two in zip(_heads(a), _heads(b), strict=True):
        if not len(np.intersect1d(one, two, assume_unique=True)):
            return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _verify(batches):
    for batch in batches:
        a, b = batch.column(0), batch.column(1)
        ok = [linked(_unpack(x.as_py()), _unpack(y.as_py())) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), b.filter(pa.array(ok))], names=["a", "b"])
    give_back()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_list: int = LONG_LIST, heavy_list: int = HEAVY_LIST) -> DataFrame:
    """Components of documents linked by Jaccard similarity of PERCENT or more of their WIDTH-word shingles.

    1. One pass gives set sizes and fingerprints, and a sketch of shingle frequencies over all rows,
       of fixed size. Documents with equal sets are one node from there on.
    2. Under the first order, rare tokens before common ones, linked sets share a token of their
       prefixes. Lists of nodes by prefix token are formed in buckets, whose number follows the
       input; a list longer than ``long_list`` is dealt over several.
    3. Every node is compared with the list leader with whom it shares the most tokens; a leader
       is the node with the largest share of frequent tokens in its prefix. So a group of n near
       copies takes about n comparisons, not n squared, to become few components.
    4. Lists whose nodes are then of one component need nothing more. In the others, pairs of
       different components must pass the filters of all three orders at once (see _apart()), which
       travel with the postings: a row is made only of a pair that passes. A list with over
       ``heavy_list`` comparisons is dealt once more, by the prefix tokens of the second order, so
       only nodes that share one under both orders meet.
    5. Pairs that are left are verified by exact counts. No list, pair or partner is capped.

    Words are lower-cased in A-Z. Null and empty texts have no shingles and are components of
    their own. Rows with equal ids are judged each by its own text. A row with a null id takes part,
    but names a component only where no row of it has an id (component_id is null there). Sets are
    known by 64-bit fingerprints, shingles in them by 56 bits. An empty table gives an empty result; other columns are ignored.

    Returns doc_id, n_shingles, component_id, row_key (a hash of id and text) and first_key, the
    row_key of the component's row with the smallest id.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    seen = stash(docs.mapInArrow(_count, "doc_id long, key long, n long, node long, slice int, counts binary"), "jaccard-seen")
    sizes = seen.where("slice is null").select("doc_id", "key", "n", "node")
    slices = seen.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(_levels, "slice int, levels binary")
    # 2**SKETCH_BITS bytes, whatever the input
    level = np.zeros(1 << SKETCH_BITS, np.uint8)
    for row in slices.toLocalIterator():
        level[row.slice << SLICE_BITS : (row.slice + 1) << SLICE_BITS] = np.frombuffer(row.levels, np.uint8)
    levels = spark.sparkContext.broadcast(level.tobytes())
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bits = max(LEAST_BUCKET_BITS, int(np.ceil(np.log2(max(1, total * 4 / BUCKET_BYTES)))))
    postings = docs.select("text").mapInArrow(_postings(levels, bits, long_list), "bucket int, tokens binary, docs binary, common binary")
    lists = stash(postings.groupBy("bucket").applyInArrow(_lists, "token long, doc long, lead long"), "jaccard-lists")

    involved = lists.select("doc").distinct()
    # one row stands for each node
    rows = sizes.where("n > 0").groupBy("node").agg(F.min("key").alias("row")).join(involved, F.col("node") == F.col("doc"), "left_semi").select("row")
    sets = stash(docs.join(rows.hint("shuffle_hash"), docs["key"] == rows["row"], "left_semi").select("text").mapInArrow(_sets, "doc long, n long, tokens binary"), "jaccard-sets")

    def verified(pairs: DataFrame, what: str) -> DataFrame:
        used = sets
        ends = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct()
        if ends.limit(FEW + 1).count() <= FEW:  # the size is checked: sets that no pair needs aren't shuffled
            used = sets.join(F.broadcast(ends), "doc", "left_semi")
        one = pairs.join(used.select(F.col("doc").alias("a"), F.col("tokens").alias("ta")), "a")
        two = one.join(used.select(F.col("doc").alias("b"), F.col("tokens").alias("tb")), "b")
        return stash(two.select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long"), what)

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and shared prefix tokens let them reach PERCENT."""
        rest = lambda n: F.floor((PERCENT * F.col(n) + 99) / 100) - 1  # noqa: E731  tokens after the prefix
        sized = pairs.join(sets.select(F.col("doc").alias("a"), F.col("n").alias("na")), "a").join(sets.select(F.col("doc").alias("b"), F.col("n").alias("nb")), "b")
        overlap = F.ceil(PERCENT * (F.col("na") + F.col("nb")) / (100 + PERCENT))
        return sized.where((100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")) & (F.col("shared") + F.greatest(rest("na"), rest("nb")) >= overlap)).select("a", "b")

    # here shared counts only lists of this lead: a pair left out is met again among those of different components
    tries = lists.where("doc != lead").groupBy("doc", "lead").agg(F.count(F.lit(1)).alias("shared"))
    tries = tries.groupBy(F.col("doc").alias("b")).agg(F.max_by(F.struct("lead", "shared"), F.struct("shared", -F.col("lead"))).alias("best")).select("b", F.col("best.lead").alias("a"), F.col("best.shared").alias("shared"))
    tries = possible(tries).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if 2 ** (int(level.max()) / 8) > long_list:  # leaders of the parts of one list try the least of them
        first = lists.groupBy("token").agg(F.min("lead").alias("a"), F.max("lead").alias("last")).where("a != last").select("token", "a")
        tries = tries.union(lists.select("token", F.col("lead").alias("b")).join(first, "token").where("a != b").select("a", "b")).distinct()
    tries = stash(tries, "jaccard-tries")
    links = verified(tries, "jaccard-links")
    labels = components(links)
    labelled = lists.select("token", "doc").join(labels, F.col("doc") == labels["id"], "left").select("token", "doc", F.coalesce("component", "doc").alias("label"))
    labelled = stash(labelled, "jaccard-labelled")
    drop_stash(lists)
    counts = labelled.groupBy("token", "label").agg(F.count(F.lit(1)).alias("own")).groupBy("token").agg(F.sum("own").alias("all"), F.max("own").alias("most"))
    mixed = counts.where("all > most").select("token", ((F.col("all") - F.col("most")) * F.col("all") > heavy_list).alias("heavy"))
    # a node's lists are bounded by its own prefix
    wanted = stash(labelled.join(mixed, "token").groupBy("doc", "label").agg(F.collect_list(F.struct("token", "heavy")).alias("x")), "jaccard-wanted")
    drop_stash(labelled)
    signed = wanted.join(sets, "doc").select("doc", "label", "tokens", "x.token", "x.heavy")
    signed = signed.mapInArrow(_signed(levels), _SIGNED).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(1 << bits)))
    pairs = signed.groupBy("bucket").applyInArrow(_cross, "a long, b long").distinct()
    pairs = stash(pairs.join(tries, ["a", "b"], "left_anti"), "jaccard-pairs")
    drop_stash(wanted, tries)
    links = stash(links.union(verified(pairs, "jaccard-more")), "jaccard-links")
    drop_stash(sets, pairs)

    labels = components(links)
    nodes = sizes.where("n > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key")).alias("first"))
    nodes = stash(nodes.join(labels, nodes["node"] == labels["id"], "left").select("node", F.coalesce("component", "node").alias("component"), "first"), "jaccard-nodes")
    named = nodes.join(nodes.groupBy(F.col("component").alias("of")).agg(F.min("first").alias("least")), F.col("component") == F.col("of")).select(F.col("node").alias("at"), F.col("least.doc_id").alias("component_id"), F.col("least.key").alias("first_key"))
    full = sizes.where("n > 0").join(named, sizes["node"] == named["at"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("key").alias("row_key"), "first_key")
    return full.union(sizes.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("key").alias("row_key"), F.col("key").alias("first_key")))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
