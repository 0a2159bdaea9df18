"""Secret spans: three fixed patterns, and tokens that a battery of randomness tests sets apart from identifiers.

Built-in functions alone. Spans are in code points, the end exclusive. Every long token is assigned the narrowest
encoding (hex, base32, base64) that holds it. Three statistics are taken by encoding: chi-squared distance from uniform use of its
alphabet, runs of one character class, and the size of the lag-one serial correlation of the character codes. The
hypothesis that a discovery rejects is that of an ordinary token: an identifier joined from words, whose letters are far
from uniform, whose class changes where a word begins, and whose correlation is that of words. What mixed-case
identifiers are like is taken from all such tokens of the table together with a fixed stock of them, so small tables
go by the stock and large ones by their own; hex and base32 go by words of those letters. Each statistic is a standard score against that, with the spread
between identifiers beside that within one. The three are joined by Stouffer's rule with weights, and the false-discovery rate is held
by Benjamini and Hochberg's step-up rule within each alphabet and band of lengths, over counts of all tokens of the table by p-value.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.scratch import saved

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Kinds in the order in which spans that start together are listed.
KINDS = ["assign", "access", "hex", "random"]
#: Words, capital or not, acronyms, short numbers and marks: a token that is made of these alone is an identifier. Random text of 20 characters is hardly ever one.
PIECE = r"[A-Z]?[a-z]{2,}|[A-Z]{2,}(?![a-z])|[A-Z](?=[A-Z][a-z])|[0-9]{1,4}(?![0-9])|[_/=+-]"
#: Weights of the chi-squared, runs and serial scores: the last one tells sequences apart, but hardly words.
WEIGHTS = (2.0, 2.0, 1.0)
#: Matches that are placed at once.
BLOCK = 256
#: p-values are counted in steps of this factor.
STEPS_PER_E = 8
MOST_STEPS = 50 * STEPS_PER_E


def matches(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Array of (begin, kind, end, value) of the leftmost non-overlapping matches whose `group` has `least` characters.

    The parts between matches, as split() gives them, and the matches themselves tell where each match begins.
    """
    parts = F.transform(F.split(text, pattern, -1), F.length)
    found, inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.transform(F.arrays_zip(F.slice(parts, 1, F.size(found)).alias("gap"), found.alias("all"), inner.alias("value")), lambda x: F.struct(x["gap"].alias("gap"), F.length(x["all"]).alias("long"), x["value"].alias("value")))
    kind_no = F.lit(kind)

    def add(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + x["long"]
        span = F.array(F.struct(begin.alias("begin"), kind_no.alias("kind"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    def block(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), none_found().alias("spans")), add)

    # matches are placed in blocks first, so that appending spans costs little in a text of very many
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(rows) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: block(F.slice(rows, i + 1, F.lit(BLOCK))))

    def shifted(state: Column, part: Column) -> Column:
        moved = F.transform(part["spans"], lambda t: F.struct((t["begin"] + state["at"]).alias("begin"), t["kind"].alias("kind"), (t["end"] + state["at"]).alias("end"), t["value"].alias("value")))
        return F.struct((state["at"] + part["at"]).alias("at"), F.concat(state["spans"], moved).alias("spans"))

    return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none_found().alias("spans")), shifted)["spans"]


def none_found() -> Column:
    return F.array().cast("array<struct<begin:int,kind:int,end:int,value:string>>")


def base_spans(text: Column) -> Column:
    """All spans of the three patterns, by begin, then kind."""

    def of(quick: Column, *how) -> Column:
        return F.when(quick, matches(text, *how)).otherwise(none_found())

    # Runs of [0-9a-f]+ and AKIA[A-Z0-9]+ are as long as they can be, so the length may be part of the pattern.
    return F.array_sort(
        F.concat(
            of(text.rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"), ASSIGN, 0, 2, 8),
            of(F.contains(text, F.lit("AKIA")), ACCESS, 1, 0, 16),
            of(text.rlike(HEX), HEX, 2, 0, 32),
        )
    )


def normal_below(z: Column) -> Column:
    """The standard normal distribution function, by the logistic form with a cubic term (within 0.0002)."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(z * 1.5976 + z * z * z * 0.070566)))


def alphabet(token: Column) -> Column:
    """Size of the narrowest alphabet that holds the token."""
    return F.when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 16).when(token.rlike("^[A-Z2-7]+=*$"), 32).otherwise(64)


def statistics(token: Column) -> Column:
    """(size of the alphabet, length, squares: sum of squared character counts, inner: letters and digits, runs: of one class among those, serial: correlation of codes times the root of the length, 0 where all are the same, wordy)."""
    chars = F.split(token, "")
    length = F.length(token).cast("double")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + F.pow(F.length(token) - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
    inner = F.regexp_replace(token, "[^A-Za-z0-9]", "")
    classes = F.translate(inner, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "0" * 10)
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1")).cast("double")
    codes = F.transform(chars, lambda c: F.ascii(c).cast("double"))
    sums = F.aggregate(codes, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("xy"), F.lit(None).cast("double").alias("last")), lambda s, c: F.struct((s["x"] + c).alias("x"), (s["xx"] + c * c).alias("xx"), (s["xy"] + F.coalesce(s["last"] * c, F.lit(0.0))).alias("xy"), c.alias("last")))
    first, last = F.ascii(F.substring(token, 1, 1)), F.ascii(F.substring(token, -1, 1))
    m = sums["x"] / length
    joint = sums["xy"] - m * (2 * sums["x"] - first - last) + (length - 1) * m * m
    serial = F.coalesce(F.try_divide(joint, sums["xx"] - length * m * m), F.lit(0.0)) * F.sqrt(length)
    return F.struct(
        alphabet(token).alias("size"), length.alias("length"), squares.alias("squares"), F.length(inner).cast("double").alias("inner"), runs.alias("runs"), serial.alias("serial"), ((F.regexp_replace(token, PIECE, "") == "") & token.rlike("[a-z][A-Z]")).alias("wordy")
    )


@dataclass(frozen=True)
class Ordinary:
    """What ordinary tokens of an encoding are like: the chance that two characters are the same, and that one is of another class than the one before, and how far both differ between tokens; mean and spread of the size of serial correlations."""

    same: float
    same_spread: float
    change: float
    change_spread: float
    serial_mean: float = 0.8
    serial_spread: float = 0.6


#: By size of the alphabet: words of hex letters and numbers, words of capitals, identifiers of mixed case; and how many tokens of the table weigh as much as the last.
STOCK = {16: Ordinary(0.14, 0.01, 0.1, 0.05), 32: Ordinary(0.068, 0.008, 0.06, 0.04), 64: Ordinary(0.056, 0.008, 0.27, 0.05)}
STOCK_TOKENS = 200


def ordinary(tests: DataFrame) -> dict[int, Ordinary]:
    """STOCK with the identifiers among `tests` (test) added to those of mixed case, by numbers of tokens; one row reaches the driver."""
    length, test = F.col("test.length"), F.col("test")
    same = (test["squares"] - length) / (length * (length - 1))
    pairs = F.greatest(test["inner"] - 1, F.lit(1.0))
    change, size = (test["runs"] - 1) / pairs, F.abs(test["serial"])
    within = change * (1 - change) / pairs
    row = tests.where("test.wordy AND test.size = 64").agg(
        F.count("*").alias("n"), *(F.avg(x).alias(name) for name, x in (("same", same), ("change", change), ("serial", size), ("within", within))),
        *(F.var_pop(x).alias(f"{name}_var") for name, x in (("same", same), ("change", change), ("serial", size))),
    ).first()
    stock, n = STOCK[64], row["n"]
    if not n:
        return STOCK
    mix = lambda own, fixed: (n * own + STOCK_TOKENS * fixed) / (n + STOCK_TOKENS)
    apart = lambda var, inside, fixed: math.sqrt(mix(max(var - inside, 0.0), fixed**2))
    # chance and spread within a token are part of its score already
    shape = Ordinary(
        mix(row["same"], stock.same), max(apart(row["same_var"], 2 * row["same"] / 600, stock.same_spread), stock.same_spread / 2),
        mix(row["change"], stock.change), max(apart(row["change_var"], row["within"], stock.change_spread), stock.change_spread / 2),
        mix(row["serial"], stock.serial_mean), max(math.sqrt(mix(row["serial_var"], stock.serial_spread**2)), stock.serial_spread / 2),
    )
    return STOCK | {64: shape}


def joined_steps(test: Column, words: dict[int, Ordinary]) -> Column:
    """The joined p-value of a token's statistics, as -log(p) in steps; many steps mean little like an ordinary token."""
    of = lambda name: F.coalesce(*(F.when(test["size"] == size, getattr(w, name)) for size, w in words.items()))
    size, length = test["size"], test["length"]
    excess = size * of("same") - 1
    chi = size * test["squares"] / length - length
    z_chi = ((size - 1 + length * excess) - chi) / F.sqrt(2 * (size - 1) + 4 * length * F.greatest(excess, F.lit(0.1)) + F.pow(size * length * of("same_spread"), F.lit(2.0)))
    pairs = F.greatest(test["inner"] - 1, F.lit(1.0))
    z_runs = ((test["runs"] - 1) / pairs - of("change")) / F.sqrt(of("change") * (1 - of("change")) / pairs + F.pow(of("change_spread"), F.lit(2.0)))
    z_serial = (of("serial_mean") - F.abs(test["serial"])) / of("serial_spread")
    bound = lambda z: F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    z = sum(w * bound(z) for w, z in zip(WEIGHTS, (z_chi, z_runs, z_serial), strict=True)) / math.sqrt(sum(w * w for w in WEIGHTS))
    return F.least(F.floor(-F.log(normal_below(-z)) * STEPS_PER_E), F.lit(MOST_STEPS)).cast("int")


def band(length: Column) -> Column:
    """Lengths that are judged together: from 20, 28, 40, 64 and 128."""
    return F.when(length < 28, 20).when(length < 40, 28).when(length < 64, 40).when(length < 128, 64).otherwise(128)


def thresholds(tokens: DataFrame, rate: float) -> dict[tuple[int, int], int]:
    """By alphabet and band, the least steps of a discovery: Benjamini and Hochberg's rule on counts by step.

    At most 15 groups of 401 counts reach the driver, whatever the table.
    """
    counts: dict[tuple[int, int], dict[int, int]] = {}
    for row in tokens.groupBy("size", "band", "steps").count().collect():
        counts.setdefault((row["size"], row["band"]), {})[row["steps"]] = row["count"]
    out = {}
    for group, by in counts.items():
        total, above = sum(by.values()), 0
        for step in sorted(by, reverse=True):
            above += by[step]
            if math.exp(-step / STEPS_PER_E) <= rate * above / total:
                out[group] = step
    return out


def find_secrets(docs: DataFrame, rate: float = 0.001) -> DataFrame:
    """doc_id, base, spans: one row per document, spans as arrays of (begin, kind, end), sorted.

    base has the patterns' spans; spans has those and the tokens that pass the tests at false-discovery rate `rate`
    and touch no base span. A null text is empty and has none; a text of any length is searched whole. Other columns are
    ignored, whatever their names; repeated rows stay, and each counts. An empty table gives an empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["begin"].alias("begin"), s["kind"].alias("kind"), s["end"].alias("end")))
    tokens = F.when(text.rlike(TOKEN), matches(text, TOKEN, 3, 0, 20)).otherwise(none_found())
    scanned = docs.select("doc_id", bare(base_spans(text)).alias("base"), tokens.alias("tokens"))
    free = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["begin"] < t["end"]) & (t["begin"] < b["end"])))
    judged = F.transform(free, lambda t: F.struct(t["begin"].alias("begin"), t["kind"].alias("kind"), t["end"].alias("end"), band(t["end"] - t["begin"]).alias("band"), statistics(t["value"]).alias("test")))
    found = saved(scanned.select("doc_id", "base", judged.alias("tokens")))
    each = found.select(F.explode("tokens").alias("t")).select("t.band", "t.test")
    words = ordinary(each)
    least = thresholds(each.select("test.size", "band", joined_steps(F.col("test"), words).alias("steps")), rate)
    passes = lambda t: F.coalesce(*(F.when((t["test"]["size"] == s) & (t["band"] == b), joined_steps(t["test"], words) >= n) for (s, b), n in sorted(least.items())), F.lit(False))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", bare(F.filter("tokens", passes)))).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:begin:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["begin"].cast("string"), s["end"].cast("string"))), ",")
