"""Secret scans: fixed patterns, and character Markov models of random and ordinary strings (DataFrame operations only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash

# The patterns of the base kinds and their least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "markov")

#: Characters of the models; any other is the one after the last.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1
#: Strings that the models judge.
CANDIDATE = "[A-Za-z0-9+/_=-]{16,}"
ORDINARY = "[A-Za-z0-9+/_=-]{8,}"
#: Defaults of the bounds of the labelled samples: random strings (values of base spans), and documents whose other strings are ordinary.
RANDOM_SAMPLE, ORDINARY_DOCS = 20_000, 2_000
#: Log-likelihood ratio (nats) from which a string is random: in all, and for each transition.
LEAST_RATIO, LEAST_MEAN = 20.0, 0.7
#: A stretch ends where the ratio has fallen so far below its peak.
DROP = 10.0
#: What separates the parts of a string, and a part.
SEPARATOR, PART = "[/_=+-]", "[^/_=+-]*"
#: Weight of the plain frequency of a character in its frequency after another.
BACKOFF = 8.0
MASK = "[SECRET]"


def _let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _slices(rows: Column) -> tuple[Column, Column]:
    """Numbers of the slices that a walk over ``rows`` takes, and their size, both about the root of the number of rows."""
    size = F.ceil(F.sqrt(F.size(rows))).cast("int")
    return F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.ceil(F.size(rows) / size).cast("int") - 1)).otherwise(F.array().cast("array<int>")), size


def _before(rows: Column, value, combine) -> Column:
    """For each row, combine() of 0 and the whole numbers value() of all earlier rows.

    An array grows by copying, so one grows over a slice only, then over the slices: n rows cost
    n ** 1.5 and not n ** 2.
    """
    slices, size = _slices(rows)
    part = lambda k: F.slice(rows, k * size + 1, size)
    add = lambda acc, n: F.concat(acc, F.array(combine(F.element_at(acc, -1), n)))
    of_slices = F.transform(slices, lambda k: F.aggregate(part(k), F.lit(0), lambda acc, x: combine(acc, value(x))))

    def within(first):
        run = lambda k: F.aggregate(part(k), F.array(F.get(first, k)), lambda acc, x: add(acc, value(x)), lambda acc: F.slice(acc, F.lit(1), F.size(acc) - 1))
        return F.flatten(F.transform(slices, run))

    return _let(F.aggregate(of_slices, F.array(F.lit(0)), add), within)


def _found(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start, end, kind, value>> of the pattern's leftmost non-overlapping matches, in code points."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else match
    pairs = F.arrays_zip(match.alias("m"), F.split(text, pattern, -1).alias("gap"), value.alias("v"))
    zipped = F.filter(pairs, lambda x: x["m"].isNotNull())  # split leaves one part more, the rest of the text
    length = lambda x: F.length(x["gap"]) + F.length(x["m"])

    def placed(rows):
        spans = lambda x, at: _let(at + F.length(x["gap"]), lambda start: F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value")))
        return F.zip_with(rows, _before(rows, length, lambda x, y: x + y), spans)

    return _let(zipped, placed)


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")


def _spans(text: Column, pattern: str, kind: str) -> Column:
    return F.when(text.rlike(pattern), _found(text, pattern, kind)).otherwise(_none())


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns. Runs under the least length can't start another match inside, so it stands in the pattern; not so for assign."""
    assigned = F.filter(_spans(text, ASSIGN, "assign"), lambda s: F.length(s["value"]) >= ASSIGN_LEAST)
    access = _spans(text, f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}", "access")
    return F.concat(assigned, access, _spans(text, f"[0-9a-f]{{{HEX_LEAST},}}", "hex"))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, then end; comma-joined."""
    order = F.when(spans["kind"] == KINDS[0], 0).when(spans["kind"] == KINDS[1], 1).when(spans["kind"] == KINDS[2], 2).otherwise(3)
    return F.struct(spans["start"].alias("start"), order.alias("nth"), spans["end"].alias("end"), spans["kind"].alias("kind"))


def _written(spans: Column) -> Column:
    sorted_ = F.array_sort(F.transform(spans, _joined))
    return F.array_join(F.transform(sorted_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _codes(token: Column) -> Column:
    """Positions of a string's characters in ALPHABET, the strange ones after the last."""
    return F.transform(F.split(token, ""), lambda c: F.when(F.instr(F.lit(ALPHABET), c) > 0, F.instr(F.lit(ALPHABET), c) - 1).otherwise(SIZE - 1))


def _transitions(tokens: DataFrame) -> DataFrame:
    """(label, pair, n): counts of character transitions over the labelled strings; at most 2 * SIZE**2 rows."""
    codes = tokens.select("label", _codes(F.col("token")).alias("c")).where(F.size("c") > 1)
    pairs = F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.get("c", i) * SIZE + F.get("c", i + 1))
    return codes.select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n"))


def log_ratios(tokens: DataFrame) -> list[float]:
    """log P(next | this) of random strings less that of ordinary ones, for each pair of characters.

    Both models lean on how often the next character comes at all, with weight BACKOFF, and that on
    half a count for each character; so a character that ordinary strings lack counts against them
    after any other. What comes to the driver has at most 2 * SIZE**2 rows, whatever the input.
    """
    counts = {label: [[0.0] * SIZE for _ in range(SIZE)] for label in (0, 1)}
    for label, pair, n in _transitions(tokens).collect():
        counts[label][pair // SIZE][pair % SIZE] += n

    def logs(rows):
        plain = [sum(r[b] for r in rows) + 0.5 for b in range(SIZE)]
        total = sum(plain)
        return [math.log((x + BACKOFF * plain[b] / total) / (sum(r) + BACKOFF)) for r in rows for b, x in enumerate(r)]

    return [x - y for x, y in zip(logs(counts[1]), logs(counts[0]), strict=True)]


def _sampled(rows: DataFrame, h: str, most: int) -> DataFrame:
    """About ``most`` rows (all, if fewer), those whose hash is under a threshold; no task gathers or sorts them."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.col(h), F.lit(1 << 32)) < F.lit(int(most / n * (1 << 32))))


def labelled_strings(docs: DataFrame, found: DataFrame, random_sample: int = RANDOM_SAMPLE, ordinary_docs: int = ORDINARY_DOCS) -> DataFrame:
    """Labelled samples: values of base spans are random (1), other long strings that recur in sampled documents ordinary (0).

    About ``random_sample`` strings and ``ordinary_docs`` documents are taken, by their hashes (all,
    if there are fewer). An empty table samples nothing.
    """
    values = found.select(F.explode("base").alias("s"), "doc_id").select(F.col("s.value").alias("token"), F.xxhash64("s.value", "doc_id", "s.start").alias("h"))
    random = _sampled(values, "h", random_sample).select(F.lit(1).alias("label"), "token")
    sample = _sampled(docs.select("text", F.xxhash64("doc_id").alias("h")), "h", ordinary_docs)
    # a string that two documents hold is an identifier or a word; a secret stands in one
    for pattern in (ASSIGN, f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}", f"[0-9a-f]{{{HEX_LEAST},}}"):
        sample = sample.withColumn("text", F.regexp_replace("text", pattern, " "))
    ordinary = sample.select("h", F.explode(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0))).alias("token"))
    ordinary = ordinary.groupBy("token").agg(F.countDistinct("h").alias("n")).where("n > 1").select(F.lit(0).alias("label"), "token")
    return random.unionByName(ordinary)


def _stretches(ratios: Column, drift: float) -> Column:
    """array<struct<start, end>> of disjoint stretches of characters that reach both limits.

    One scan for maximum sums of the ratios less ``drift``: a stretch starts anew where its sum is
    used up or has fallen by DROP, and ends at its peak. ``ratios`` has one element a character, that
    of the transition to it.
    """

    def ended(acc):
        n = acc["end"] - acc["start"]
        total = acc["best"] + drift * n
        one = F.array(F.struct(acc["start"].alias("start"), (acc["end"] + 1).alias("end")))
        return F.when((n > 0) & (total >= LEAST_RATIO) & (total >= LEAST_MEAN * n), F.concat(acc["out"], one)).otherwise(acc["out"])

    def step(acc, r):
        def moved(now):
            cut, at = (now <= 0) | (now < acc["best"] - DROP), acc["at"] + 1
            return F.struct(
                at.alias("at"),
                F.when(cut, 0.0).otherwise(now).alias("sum"),
                F.when(cut, at).otherwise(acc["start"]).alias("start"),
                F.when(cut | (now > acc["best"]), at).otherwise(acc["end"]).alias("end"),
                F.when(cut, 0.0).otherwise(F.greatest(acc["best"], now)).alias("best"),
                F.when(cut, ended(acc)).otherwise(acc["out"]).alias("out"),
            )

        return _let(acc["sum"] + r - drift, moved)

    zero, none = F.lit(0), F.array().cast("array<struct<start:int,end:int>>")
    first = F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("sum"), zero.alias("start"), zero.alias("end"), F.lit(0.0).alias("best"), none.alias("out"))
    return F.aggregate(ratios, first, step, ended)


def _whole_parts(value: Column, s: Column) -> Column:
    """The stretch with its ends moved to separators: a part it covers half of is taken whole, of which it covers less is left, unless little remains."""
    held = F.substring(value, s["start"] + 1, s["end"] - s["start"])
    n = lambda text, pattern: F.length(F.regexp_extract(text, pattern, 0))
    before, own_first = n(F.substring(value, F.lit(1), s["start"]), PART + "$"), n(held, "^" + PART)
    after, own_last = n(F.substring(value, s["end"] + 1, F.length(value)), "^" + PART), n(held, PART + "$")
    several = own_first < F.length(held)
    start = F.when(own_first >= before, s["start"] - before).when(several, s["start"] + own_first + 1).otherwise(s["start"])
    end = F.when(own_last >= after, s["end"] + after).when(several, s["end"] - own_last - 1).otherwise(s["end"])
    moved = F.struct(start.alias("start"), end.alias("end"))
    return _let(moved, lambda m: F.when(2 * (m["end"] - m["start"]) >= s["end"] - s["start"], m).otherwise(s))


def _joined_up(spans: Column) -> Column:
    """Overlapping spans made one."""

    def joined(rows):
        reached = _before(rows, lambda s: s["end"], F.greatest)
        firsts = F.filter(F.zip_with(rows, reached, lambda s, at: F.struct(s["start"].alias("start"), at.alias("at"))), lambda s: s["start"] >= s["at"])
        last = F.array_max(F.transform(rows, lambda s: s["end"]))
        # what was reached before the next first span is where this one's chain ends
        return _let(firsts, lambda fs: F.transform(fs, lambda s, i: F.struct(s["start"].alias("start"), F.coalesce(F.get(fs, i + 1)["at"], last).alias("end"))))

    return _let(F.array_sort(spans), joined)


def _parts(value: Column) -> Column:
    """array<struct<start, end, value>>: the string, then what its separators part it into."""

    def parted(parts):
        starts = _before(parts, lambda p: F.length(p) + 1, lambda x, y: x + y)
        spans = F.zip_with(parts, starts, lambda p, at: F.struct(at.alias("start"), (at + F.length(p)).alias("end"), p.alias("value")))
        return F.filter(spans, lambda s: (s["end"] - s["start"] > 1) & (s["end"] - s["start"] < F.length(value)))

    whole = F.struct(F.lit(0).alias("start"), F.length(value).alias("end"), value.alias("value"))
    return F.concat(F.array(whole), _let(F.split(value, SEPARATOR), parted))


def _judged(ratios: list[float]):
    table = F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in ratios) + "]"), "array<double>")

    def random(value):
        """The random stretches of a string; the whole string if it is random on the whole."""

        def judged(rs):
            total = F.aggregate(rs, F.lit(0.0), lambda acc, r: acc + r)
            whole = F.array(F.struct(F.lit(0).alias("start"), F.length(value).alias("end")))
            found = F.transform(F.concat(_stretches(rs, 0.0), _stretches(rs, LEAST_MEAN)), lambda s: _whole_parts(value, s))
            return F.when((total >= LEAST_RATIO) & (total >= LEAST_MEAN * (F.length(value) - 1)), whole).otherwise(found)

        rates = lambda cs: F.transform(cs, lambda c, i: F.when(i == 0, 0.0).otherwise(F.get(table, F.get(cs, i - 1) * SIZE + c)))
        return _let(_let(_codes(value), rates), judged)

    def judge(span):
        """Spans of the random stretches of a string and of each of its parts: a part counts as it does alone."""
        value = span["value"]
        text = lambda s: F.substring(value, s["start"] + 1, s["end"] - s["start"])
        within = lambda part: F.transform(random(part["value"]), lambda s: F.struct((part["start"] + s["start"]).alias("start"), (part["start"] + s["end"]).alias("end")))
        found = _joined_up(F.flatten(F.transform(_parts(value), within)))
        spans = F.transform(found, lambda s: F.struct((span["start"] + s["start"]).alias("start"), (span["start"] + s["end"]).alias("end"), F.lit(KINDS[3]).alias("kind"), text(s).alias("value")))
        # digits alone are numbers, however random
        return F.filter(spans, lambda s: s["value"].rlike("[A-Za-z]"))

    return judge


def _outside(seen: Column, spans: Column) -> Column:
    """What is left of disjoint runs, in order, outside the given spans: one walk over the starts of both.

    From one start to the next, spans cover what is before the furthest end so far, and only the
    last run can go on.
    """
    start = lambda s, is_run: F.struct(s["start"].alias("start"), F.lit(is_run).alias("run"), s["end"].alias("end"))
    starts = F.array_sort(F.concat(F.transform(spans, lambda s: start(s, 1)), F.transform(seen, lambda s: start(s, 2))))

    def left(rows):
        covered = _before(rows, lambda s: F.when(s["run"] == 1, s["end"]).otherwise(0), F.greatest)
        runs = _before(rows, lambda s: (s["run"] == 2).cast("int"), lambda x, y: x + y)

        def piece(row, i):
            run = F.get(seen, row["runs"] + (row["s"]["run"] == 2).cast("int") - 1)
            begin = F.greatest(row["s"]["start"], row["covered"], F.when(row["s"]["run"] == 1, row["s"]["end"]))
            end = F.least(run["end"], F.get(rows, i + 1)["start"])
            return F.struct(begin.alias("start"), end.alias("end"), run.alias("run"))

        walked = F.transform(F.arrays_zip(rows.alias("s"), covered.alias("covered"), runs.alias("runs")), piece)
        pieces = F.filter(walked, lambda p: p["run"].isNotNull() & (p["start"] < p["end"]))
        value = lambda p: F.substring(p["run"]["value"], p["start"] - p["run"]["start"] + 1, p["end"] - p["start"])
        return F.transform(pieces, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["run"]["kind"].alias("kind"), value(p).alias("value")))

    return _let(starts, left)


def _all_spans(ratios: list[float], base: Column, seen: Column) -> Column:
    return F.concat(base, F.flatten(F.transform(_outside(seen, base), _judged(ratios))))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", random_sample: int = RANDOM_SAMPLE, ordinary_docs: int = ORDINARY_DOCS) -> DataFrame:
    """Spans of secrets in each text.

    Base spans come from the fixed patterns. What lies outside them in the strings of CANDIDATE is
    scored by two first-order character Markov models, of random strings and of ordinary
    identifiers, trained from labelled_strings(); a string whose log-likelihood ratio reaches
    LEAST_RATIO in all and LEAST_MEAN for each transition is added as kind ``markov``. Of other
    strings, every stretch that reaches both is added, with its ends moved to separators where it
    covers half of what they bound; parts between separators are also judged alone, so a key is
    found after a path or prefix as often as by itself.

    The models are fitted on about ``random_sample`` labelled strings and ``ordinary_docs``
    documents; every text is judged. A null text counts as empty and has no spans; an empty table
    gives an empty result; rows with equal ids are judged each by its own text; columns other than
    id and text are ignored.

    Returns doc_id and spans, array<struct<start, end, kind, value>> in code points.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = stash(docs.select("doc_id", base_spans(F.col("text")).alias("base"), _spans(F.col("text"), CANDIDATE, "markov").alias("seen")), "secrets-found")
    ratios = log_ratios(labelled_strings(docs, found, random_sample, ordinary_docs))
    return found.select("doc_id", _all_spans(ratios, F.col("base"), F.col("seen")).alias("spans"))


def mask_secrets(docs: DataFrame, random_sample: int = RANDOM_SAMPLE, ordinary_docs: int = ORDINARY_DOCS) -> DataFrame:
    """The same rows and columns, every secret in ``text`` replaced by MASK (null stays null); docs has doc_id and text.

    The models are trained first; the rows then need one more pass and no join. Columns of any
    other name pass through as they are. Rows with equal or null ids are masked each by its own
    text; an empty table gives an empty result.
    """
    columns = docs.columns
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = stash(texts.select("doc_id", base_spans(F.col("text")).alias("base")).where("size(base) > 0"), "secrets-found")
    ratios = log_ratios(labelled_strings(texts, found, random_sample, ordinary_docs))
    drop_stash(found)
    fresh = lambda name: name if name not in columns else fresh(name + "_")
    base, seen, spans = fresh("base"), fresh("seen"), fresh("spans")
    text = F.col("text")
    rows = docs.withColumns({base: base_spans(text), seen: _spans(text, CANDIDATE, "markov")})
    rows = rows.withColumn(spans, _all_spans(ratios, F.col(f"`{base}`"), F.col(f"`{seen}`")))
    return rows.withColumn("text", F.when(text.isNotNull(), masked(text, F.col(f"`{spans}`")))).select(*[F.col(f"`{c}`") for c in columns])


def digest(spans: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, the written spans, and n_markov."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return spans.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), count(KINDS[3]))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span, or chain of overlapping spans, replaced by MASK.

    The text between spans is cut from what lies around a slice of them, as a cut counts characters
    from the beginning of what it is made in.
    """

    def done(rows):
        slices, size = _slices(rows)
        last = F.array_max(F.transform(rows, lambda s: s["end"]))

        def joined(reached):
            def of_slice(k):
                begin = F.get(reached, k * size)
                nearby = F.substring(text, begin + 1, F.coalesce(F.get(reached, (k + 1) * size), last) - begin)
                piece = lambda near: lambda s, at: F.when(s["start"] >= at, F.concat(F.substring(near, at - begin + 1, s["start"] - at), F.lit(MASK))).otherwise("")
                return _let(nearby, lambda near: F.array_join(F.zip_with(F.slice(rows, k * size + 1, size), F.slice(reached, k * size + 1, size), piece(near)), ""))

            return F.array_join(F.transform(slices, of_slice), "")

        return F.concat(_let(_before(rows, lambda s: s["end"], F.greatest), joined), F.substring(text, last + 1, F.length(text)))

    return F.when(F.size(spans) > 0, _let(F.array_sort(spans), done)).otherwise(text)


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return digest(scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")))
