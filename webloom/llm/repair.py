"""Conversation structure repair: cost layers of bitsets of grammar states, traced back to the least audit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Rows of a conversation in one table of layers, and tables that are worked on together.
SEGMENT, TOGETHER = 64, 1000
#: Prices of edits, and what stands for a blank.
INSERT, REROLE, DELETE, CUT = 3, 3, 4, 3
BLANKS = " \t\n\x0b\x0c\r"

# Grammar (s?(ua)+)?: states 0 start, 1 after the system row, 2 after a user row, 3 after an assistant row; 0 and 3 accept.
_AFTER = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
_NEXT = (2, 2, 3, 2)  # the state after a user or assistant row, whichever the grammar wants
_ROLE = {2: "user", 3: "assistant"}
_CODE = {"s": 0, "u": 1, "a": 2}
#: Cost of what is inserted at the end, by state, and its audit.
_ACCEPT, _TAIL = np.array([0, 2 * INSERT, INSERT, 0]), ("", "II", "I", "")
_FAR = 1 << 40


def _layers(code: np.ndarray, drop: np.ndarray, last: list[np.ndarray], one: int, until) -> np.ndarray:
    """Layer c at place i: the states from which rows i.. can be brought to their end at cost c or less, as bits.

    ``code`` and ``drop`` (role and price of deletion) have a column a segment, their rows at the bottom;
    ``last[c]`` is layer c at the end (the last one holds for all further layers). ``one`` is 1 for sets of four states,
    0x1111 for four such sets side by side. ``until`` tells from the newest layer whether it was the last.
    """
    n, m = code.shape
    at_s, at_u, at_a, cheap = (code == 0), (code == 1), (code == 2), drop < DELETE
    kind = np.uint16
    nothing = np.zeros((n + 1, m), kind)
    layers: list[np.ndarray] = []
    before = lambda c: layers[c] if c >= 0 else nothing

    def either(x):
        """States from which a user or assistant row leads into x."""
        return ((x >> 2) & one) * kind(0b1011) | ((x >> 3) & one) << 2

    one = kind(one)
    while True:
        c = len(layers)
        layer = np.empty((n + 1, m), kind)
        layer[n] = last[min(c, len(last) - 1)]
        less, far, dear = before(c - 1), before(c - REROLE), before(c - DELETE)
        fixed = less[:n] | either(far[1:]) | either(far[:n]) | np.where(cheap, less[1:], dear[1:])
        for i in range(n - 1, -1, -1):
            x = layer[i + 1]
            kept = np.where(at_u[i], ((x >> 2) & one) * kind(0b1011), np.where(at_a[i], ((x >> 3) & one) << 2, np.where(at_s[i], (x >> 1) & one, 0)))
            layer[i] = fixed[i] | kept
        layers.append(layer)
        if until(layer):
            return np.stack(layers)


def _batches(segments: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Segments of like lengths together: their places, matrices of codes and prices, and the row at which each begins."""
    order = sorted(range(len(segments)), key=lambda k: len(segments[k][0]))
    at = 0
    while at < len(order):
        most = max(1, 1 << (len(segments[order[at]][0]) - 1).bit_length()) if len(segments[order[at]][0]) else 0
        take = [k for k in order[at : at + TOGETHER] if len(segments[k][0]) <= most]
        n = len(segments[take[-1]][0])
        code, drop = np.full((n, len(take)), 3, np.int8), np.full((n, len(take)), DELETE, np.int8)
        for column, k in enumerate(take):
            own = segments[k]
            if len(own[0]):
                code[n - len(own[0]) :, column], drop[n - len(own[0]) :, column] = own
        yield take, code, drop, np.array([n - len(segments[k][0]) for k in take])
        at += len(take)


def _matrices(segments: list) -> list[np.ndarray]:
    """Least cost from each state before a segment to each state after it."""
    out: list = [None] * len(segments)
    for take, code, drop, begin in _batches(segments):
        most = int(drop.sum(axis=0, dtype=np.int64).max(initial=0)) + 2 * INSERT
        same = np.full(len(take), sum(1 << (4 * t + t) for t in range(4)), np.uint16)
        count = [0]

        def until(layer):
            count[0] += 1
            return count[0] > most

        layers = _layers(code, drop, [same], 0x1111, until)
        columns = np.arange(len(take))
        start = layers[:, begin, columns]
        for column, k in enumerate(take):
            bits = (start[:, column][:, None] >> np.arange(16)) & 1
            least = np.where(bits.any(axis=0), bits.argmax(axis=0), _FAR)
            out[k] = least.reshape(4, 4).T  # from, to
    return out


def _times(a: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Least sums: of a matrix and costs (or another matrix)."""
    return np.minimum(_FAR, (a[:, :, None] + f.reshape(4, -1)[None]).min(axis=1)).reshape(f.shape)


class _Run:
    """Rows of one conversation that stand together in a partition."""

    def __init__(self):
        self.rows: list[tuple] = []  # role, text, n, fresh, cut
        self.items: list[tuple] = []  # fresh rows: role, text, code, price of deletion, forced deletions before it
        self.base = self.illegal = self.forced = 0
        self.head: str | None = None
        self.tail = ""

    def add(self, role, text, n, fresh, cut, keep=False):
        if keep:
            self.rows.append((role, text, n, fresh, cut))
        initial = role[:1]
        if self.head is None:
            self.head = initial
        else:
            self.illegal += self.tail + initial not in ("su", "ua", "au")
        self.tail = initial
        self.illegal += n - 1  # equal neighbours
        if fresh:
            self.items.append((role, text, _CODE.get(initial, 3), DELETE - CUT if cut else DELETE, self.forced))
            self.forced, self.base = 0, self.base + CUT * cut
        self.forced += n - fresh
        self.base += DELETE * (n - fresh)

    def segments(self) -> list[tuple[np.ndarray, np.ndarray]]:
        cut = [self.items[k : k + SEGMENT] for k in range(0, len(self.items), SEGMENT)] or [[]]
        return [(np.array([x[2] for x in part], np.int8), np.array([x[3] for x in part], np.int8)) for part in cut]

    def matrix(self) -> np.ndarray:
        whole = None
        for m in reversed(_matrices(self.segments())):
            whole = m if whole is None else _times(m, whole)
        return whole


def _solved(runs: list[_Run], ends: list[np.ndarray]) -> list[list[tuple]]:
    """For each run, whose costs beyond its end are known, the tables to trace it: one (layers, place of its first row) a segment."""
    parts = [run.segments() for run in runs]
    long = [(r, k) for r, own in enumerate(parts) if len(own) > 1 for k in range(len(own))]
    matrix = dict(zip(long, _matrices([parts[r][k] for r, k in long]), strict=True))
    flat, costs, all_states = [], [], []
    for r, own in enumerate(parts):
        f = ends[r]
        after = []
        for k in range(len(own) - 1, -1, -1):
            after.append(f)
            f = _times(matrix[r, k], f) if len(own) > 1 else f
        flat += own
        costs += reversed(after)
        all_states += [len(own) > 1 or ends[r] is not _ACCEPT] * len(own)
    tables: list = [None] * len(flat)
    for take, code, drop, begin in _batches(flat):
        f = np.stack([costs[k] - costs[k].min() for k in take])
        f = np.minimum(f, 4 * DELETE * SEGMENT)
        last = [((f <= c) * (1 << np.arange(4))).sum(axis=1).astype(np.uint16) for c in range(int(f.max()) + 1)]
        wanted = np.array([15 if all_states[k] else 1 for k in take], np.uint16)
        columns = np.arange(len(take))
        layers = _layers(code, drop, last, 1, lambda layer, wanted=wanted, begin=begin, columns=columns: ((layer[begin, columns] & wanted) == wanted).all())
        by_segment = np.ascontiguousarray(layers.transpose(2, 0, 1)).astype(np.uint8)
        for column, k in enumerate(take):
            first = by_segment[column, :, begin[column]]
            enough = int(np.argmax((first & wanted[column]) == wanted[column]))
            tables[k] = (by_segment[column, : enough + 1, begin[column] :].tolist(), len(flat[k][0]))
    out, at = [], 0
    for own in parts:
        out.append(tables[at : at + len(own)])
        at += len(own)
    return out


def _trace(run: _Run, tables: list[tuple], state: int) -> tuple[int, int, str, list[str]]:
    """State after the run, cost beyond the base, audit and repaired lines: of the cheapest edits those with the least letters (D, I, K, R in this order)."""
    audit, lines, at, paid = [], [], 0, 0
    for layers, n in tables:
        cost = next(c for c, layer in enumerate(layers) if layer[0] >> state & 1)
        i, arrived = 0, -1
        while i < n:
            role, text, _, price, forced = run.items[at + i]
            if arrived < i:
                audit.append("D" * forced)
                arrived = i
            wanted, before = _NEXT[state], cost
            if cost >= price and layers[cost - price][i + 1] >> state & 1:
                letter, cost, i = "D", cost - price, i + 1
            elif cost >= INSERT and layers[cost - INSERT][i] >> wanted & 1:
                letter, cost, state = "I", cost - INSERT, wanted
                lines.append(f"{_ROLE[state]}:")
            elif (to := _AFTER.get((role[:1], state))) is not None and layers[cost][i + 1] >> to & 1:
                letter, state, i = "K", to, i + 1
                lines.append(f"{role}:{text}")
            else:
                letter, cost, state, i = "R", cost - REROLE, wanted, i + 1
                lines.append(f"{_ROLE[state]}:{text}")
            audit.append(letter)
            paid += before - cost
        at += n
    audit.append("D" * run.forced)
    return state, paid, "".join(audit), lines


def _end(state: int) -> tuple[str, list[str]]:
    """Audit and lines of what the end of a conversation needs."""
    return _TAIL[state], [f"{_ROLE[s]}:" for s in ((2, 3) if state == 1 else (3,) if state == 2 else ())]


_KINDS = """kind int, conv string, part int, side int, pos long, role string, text string, n long, fresh boolean, cut boolean,
matrix array<long>, base long, illegal long, head string, tail string, cost long, audit string, sha string"""
_NAMES = [x.split()[0] for x in _KINDS.split(",")]


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([[row.get(name) for name in _NAMES] for row in rows], columns=_NAMES, dtype=object)


def _sha(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode("utf-8", "replace")).hexdigest()


def _first_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows of a partition: kind 0, finished conversations; of the first and the last, which may go on elsewhere, kind 1, sums, and kind 2, rows."""
    part, waiting, out = TaskContext.get().partitionId(), [], []

    def finish():
        for (conv, run), tables in zip(waiting, _solved([r for _, r in waiting], [_ACCEPT] * len(waiting)), strict=True):
            state, paid, audit, lines = _trace(run, tables, 0)
            more, inserted = _end(state)
            out.append({"kind": 0, "conv": conv, "illegal": run.illegal, "audit": audit + more, "cost": run.base + paid + INSERT * len(more), "sha": _sha(lines + inserted)})
        waiting.clear()

    def opened(conv, run, side):
        out.append({"kind": 1, "conv": conv, "part": part, "side": side, "matrix": [int(x) for x in run.matrix().ravel()], "base": run.base, "illegal": run.illegal, "head": run.head, "tail": run.tail})
        out.extend({"kind": 2, "conv": conv, "part": part, "side": side, "pos": k, **dict(zip(("role", "text", "n", "fresh", "cut"), row, strict=True))} for k, row in enumerate(run.rows))

    now, run, nth = None, None, 0
    for batch in batches:
        for conv, *row in zip(*(batch[c].tolist() for c in ("conv", "role", "text", "n", "fresh", "cut")), strict=True):
            if run is None or conv != now:
                if run is not None:
                    if nth == 0:
                        opened(now, run, 0)
                    else:
                        run.rows = []
                        waiting.append((now, run))
                    nth += 1
                now, run = conv, _Run()
            run.add(*row, keep=True)
        if len(waiting) >= TOGETHER:
            finish()
        if out:
            yield _frame(out)
            out.clear()
    finish()
    if run is not None:
        opened(now, run, 0 if nth == 0 else 1)
    if out:
        yield _frame(out)


def _again(rows: pd.DataFrame) -> _Run:
    """The run of an open conversation from its rows."""
    run = _Run()
    for row in rows.sort_values("pos")[["role", "text", "n", "fresh", "cut"]].itertuples(index=False):
        run.add(*row)
    return run


def _chain(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a conversation's runs, one or two a partition, the least costs from each state after a run to the end."""
    rows, f, out = rows.sort_values(["part", "side"]), _ACCEPT, []
    for r in reversed(list(rows.itertuples(index=False))):
        out.append((r.conv, r.part, r.side, [int(x) for x in f]))
        f = _times(np.array(r.matrix).reshape(4, 4), f)
    return pd.DataFrame(out, columns=["conv", "part", "side", "beyond"])


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """The state after a run for each state before it."""
    run, f = _again(rows), np.array(rows["beyond"].iloc[0])
    tables = _solved([run], [f])[0]
    return pd.DataFrame([(rows["conv"].iloc[0], rows["part"].iloc[0], rows["side"].iloc[0], [_trace(run, tables, s)[0] for s in range(4)])], columns=["conv", "part", "side", "exits"])


def _entries(rows: pd.DataFrame) -> pd.DataFrame:
    """The state before each run of a conversation, and whether it is the last."""
    state, out, n = 0, [], len(rows)
    for k, r in enumerate(rows.sort_values(["part", "side"]).itertuples(index=False)):
        out.append((r.conv, r.part, r.side, state, k == n - 1))
        state = int(r.exits[state])
    return pd.DataFrame(out, columns=["conv", "part", "side", "entry", "last"])


def _pieces(rows: pd.DataFrame) -> pd.DataFrame:
    """Audit and repaired lines of a run whose first state and costs beyond it are known."""
    run, r = _again(rows), rows.iloc[0]
    state, paid, audit, lines = _trace(run, _solved([run], [np.array(r["beyond"])])[0], int(r["entry"]))
    if r["last"]:
        more, inserted = _end(state)
        audit, lines, paid = audit + more, lines + inserted, paid + INSERT * len(more)
    return pd.DataFrame([(r["conv"], r["part"], r["side"], run.base + paid, run.illegal, run.head, run.tail, audit, "\n".join(lines), len(lines))], columns=["conv", "part", "side", "cost", "illegal", "head", "tail", "audit", "text", "n_lines"])


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces sorted by conversation and place to one row a conversation; of the text only the hash is kept."""
    names = ["conv", "illegal", "cost", "audit", "sha"]
    now = None

    def row():
        return now[0], now[1], now[2], "".join(now[3]), now[5].hexdigest()

    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if now is None or r.conv != now[0]:
                if now is not None:
                    out.append(row())
                now = [r.conv, 0, 0, [], None, hashlib.sha256(), 0]
            now[1] += r.illegal + (now[4] is not None and now[4] + r.head not in ("su", "ua", "au"))
            now[2] += r.cost
            now[3].append(r.audit)
            now[4] = r.tail
            if r.n_lines:
                now[5].update((("\n" if now[6] else "") + r.text).encode("utf-8", "replace"))
                now[6] += r.n_lines
        if out:
            yield pd.DataFrame(out, columns=names)
    if now is not None:
        yield pd.DataFrame([row()], columns=names)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Faults of each conversation and the cheapest edits that make it ``s?`` and then pairs of a user and an assistant row.

    Rows are those of ``rows`` (conv_id, turn, role, text) by turn, null turns first; those of one turn by role, the first
    200 characters of the text, and a hash of it. A null role or text counts as one space. A row's first fault counts:
    blank, a duplicate of an earlier row, truncated (it doesn't end in ``.!?``). Edits: Keep; Rerole to what the grammar
    wants, at 3; Delete at 4, which blanks and duplicates must be; Insert an empty user or assistant row at 3. A truncated
    row that stays costs 3 more. Of the cheapest edits the audit has the least letters.

    For every cost from 0 on there is a layer: a bitset, for each place, of the states of the grammar from which the rest
    can be repaired at that cost. The first layer with the start state gives the cost, and the layers are traced
    from there. Rows are sorted over all partitions, so one conversation may span many: each partition
    then gives the costs of its part from state to state, which are put together, one or two rows a partition,
    and only then are the parts traced. Equal rows are counted before they are moved. Only the audit and the
    repaired text's hash, which are one value a conversation, pass through one task, part by part.

    A role that is empty or begins with another letter than s, u or a can't stay as it is. Null conv_ids are one
    conversation. An empty table gives an empty result; other columns are ignored.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    kind = rows.schema["conv_id"].dataType
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    base = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text")).withColumn("digest", F.sha2("text", 256))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = base.groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("at"))
    both = base.select("conv_id", "turn", "role", "digest", "text", F.lit(1).cast("long").alias("n"), F.lit(False).alias("first"))
    both = both.unionByName(firsts.select("conv_id", F.col("at.turn").alias("turn"), "role", "digest", F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("first")))
    runs = both.groupBy("conv_id", "turn", "role", "digest").agg(F.max("text").alias("text"), F.sum("n").alias("n"), F.max("first").alias("first"))
    bare = F.btrim("text", F.lit(BLANKS))
    blank = bare == ""
    runs = runs.withColumns({"blank": blank, "fresh": ~blank & F.col("first"), "cut": ~blank & ~F.right(bare, F.lit(1)).isin(".", "!", "?")})
    runs = stash(runs, "repair-runs")
    key = ["conv_id", "turn", "role", F.substring("text", 1, 200), "digest"]
    sort = runs.repartitionByRange(*key).sortWithinPartitions(*key)
    sort = sort.select(F.col("conv_id").cast("string").alias("conv"), "role", F.when(F.col("fresh"), F.col("text")).alias("text"), "n", "fresh", "cut")
    done = stash(sort.mapInPandas(_first_pass, _KINDS), "repair-parts")

    # what follows has two conversations a partition, a hot one as many rows as there are partitions
    place = "conv string, part int, side int"
    chained = done.where("kind = 1").select("conv", "part", "side", "matrix").groupBy("conv").applyInPandas(_chain, f"{place}, beyond array<long>")
    opened = stash(done.where("kind = 2").select("conv", "part", "side", "pos", "role", "text", "n", "fresh", "cut").join(chained.drop("conv"), ["part", "side"]), "repair-open")
    entered = opened.groupBy("part", "side").applyInPandas(_exits, f"{place}, exits array<int>").groupBy("conv").applyInPandas(_entries, f"{place}, entry int, last boolean")
    pieces = opened.join(entered.drop("conv"), ["part", "side"]).groupBy("part", "side").applyInPandas(_pieces, f"{place}, cost long, illegal long, head string, tail string, audit string, text string, n_lines long")
    whole = pieces.repartition("conv").sortWithinPartitions("conv", "part", "side").mapInPandas(_joined, "conv string, illegal long, cost long, audit string, sha string")
    found = done.where("kind = 0").select("conv", "illegal", "cost", "audit", "sha").unionByName(whole).select(F.col("conv").cast(kind).alias("_conv"), "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))

    each = runs.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("n") - F.col("first").cast("long")).otherwise(0)).alias("duplicate"),
        F.sum((F.col("fresh") & F.col("cut")).cast("long")).alias("truncated"),
    )
    counts = each.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    out = counts.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(rows: DataFrame) -> DataFrame:
    """Rows as the check damages them, by crc32 of ``conv_id:turn`` modulo 20: 0 drops, 1 empties, 2 takes the ``.!?``, 3 repeats, 4 makes the role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("_code")).where("_code != 0")
    code = F.col("_code")
    text = F.when(code == 1, F.lit("")).when(code == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(code == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired; those that lose all rows have nothing to repair."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    every = rows.select(F.col("conv_id").alias("_id")).distinct()
    out = every.join(repair_conversations(damage(rows)), F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


OP12_SQL = r"""
WITH RECURSIVE crc AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_concat([4294967295], [ascii(x)::BIGINT for x in string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')]),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS code FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN code = 3 THEN [1, 2] ELSE [1] END) AS copy FROM crc WHERE code <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM d),
f AS (SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen,
    NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut, role[1] AS c, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM o),
s AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND seen) AS duplicate,
    count(*) FILTER (NOT blank AND NOT seen AND cut) AS truncated, count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
g AS (SELECT conv_id, pos, role, text, c, blank OR seen AS must, CASE WHEN cut THEN 3 ELSE 0 END AS fee FROM f),
-- p0..p3: least (cost, audit, text) in each state; before each row and at the end up to two rows may be inserted
p AS (SELECT conv_id, 0::BIGINT AS pos, [{'k': 0::BIGINT, 'a': '', 't': ''}, {'k': 1000000, 'a': '', 't': ''}, {'k': 1000000, 'a': '', 't': ''}, {'k': 1000000, 'a': '', 't': ''}] AS x FROM s
  UNION ALL
  SELECT q.conv_id, q.pos, CASE WHEN must THEN [{'k': y.k + 4, 'a': y.a || 'D', 't': y.t} for y in x] ELSE [
      {'k': i[1].k + 4, 'a': i[1].a || 'D', 't': i[1].t},
      list_min([{'k': i[2].k + 4, 'a': i[2].a || 'D', 't': i[2].t}, {'k': i[1].k + fee + (c <> 's')::INT * 1000000, 'a': i[1].a || 'K', 't': i[1].t || chr(10) || role || ':' || text}]),
      list_min(list_concat([{'k': i[3].k + 4, 'a': i[3].a || 'D', 't': i[3].t}], [{'k': y.k + fee + 3, 'a': y.a || 'R', 't': y.t || chr(10) || 'user:' || text} for y in [i[1], i[2], i[4]]],
        [{'k': y.k + fee + (c <> 'u')::INT * 1000000, 'a': y.a || 'K', 't': y.t || chr(10) || role || ':' || text} for y in [i[1], i[2], i[4]]])),
      list_min([{'k': i[4].k + 4, 'a': i[4].a || 'D', 't': i[4].t}, {'k': i[3].k + fee + 3, 'a': i[3].a || 'R', 't': i[3].t || chr(10) || 'assistant:' || text},
        {'k': i[3].k + fee + (c <> 'a')::INT * 1000000, 'a': i[3].a || 'K', 't': i[3].t || chr(10) || role || ':' || text}])] END
  FROM (SELECT g.*, x, [x[1], x[2], u, list_min([x[4], {'k': u.k + 3, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'}])] AS i
    FROM (SELECT p.conv_id AS pc, p.pos AS pp, x, list_min(list_concat([x[3]], [{'k': y.k + 3, 'a': y.a || 'I', 't': y.t || chr(10) || 'user:'} for y in [x[1], x[2], x[4]]])) AS u FROM p) JOIN g ON g.conv_id IS NOT DISTINCT FROM pc AND g.pos = pp + 1) AS q),
e AS (SELECT s.*, list_min(list_concat([x[1], x[4], {'k': x[3].k + 3, 'a': x[3].a || 'I', 't': x[3].t || chr(10) || 'assistant:'}],
    [{'k': y.k + 6, 'a': y.a || 'II', 't': y.t || chr(10) || 'user:' || chr(10) || 'assistant:'} for y in [x[1], x[2]]])) AS z FROM s JOIN p ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND p.pos = s.n)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(z.k, 0)::BIGINT AS cost,
  coalesce(z.a, '') AS audit, sha256(coalesce(z.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
"""
