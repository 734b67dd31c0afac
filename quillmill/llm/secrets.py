"""Secret scan with DataFrame functions only: known forms, then a battery of randomness tests.

Known forms (kinds assign, access, hex) are found by pattern; places are code
points, ends exclusive, matches of a kind never overlap. On top of them, tokens of
20 or more characters of common encodings are tested for randomness:

- the encoding is inferred from the token's characters, the smallest alphabet that holds them;
- chi-squared test of uniform use of that alphabet,
- runs test on the upper and lower half of the alphabet,
- lag-1 serial correlation of the alphabet's indices,
- the three are summed to one statistic with a p-value for "this is random".

A token counts as a secret (kind random) when natural tokens hardly ever look as
random as it does. How natural tokens look is fixed, not taken from the table: their
letters repeat at the rate `REPEATS` of written European languages, which moves the
uniformity statistic by an amount that grows with length and alphabet, and the
statistic's root falls as far below that as it does with a normal p-value (spread
`SPREAD`). So one key in a small table is found as well as one in a large one; a long
token in one case is tested as any other. Within each length class the
Benjamini-Hochberg rule keeps the expected share of false finds under `rate`. What
the rule needs is a histogram of fixed size.

Cases: a null text counts as empty and has no spans; places never split a
character; repeated rows are scanned each; an empty table gives an empty result;
clashing input columns are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import text_of, without

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so that a least length in the pattern drops what a later filter would drop.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9+/_-]{20,}"
KINDS = ["assign", "access", "hex", "random"]
LEAST = 20

UPPER, LOWERC, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings from small to large alphabets; the first that holds a token is its encoding.
ENCODINGS = [
    ("digits", "^[0-9]+$", DIGITS),
    ("hex_lower", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("hex_upper", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("lower", "^[a-z]+$", LOWERC),
    ("upper", "^[A-Z]+$", UPPER),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("lower_digits", "^[a-z0-9]+$", LOWERC + DIGITS),
    ("upper_digits", "^[A-Z0-9]+$", UPPER + DIGITS),
    ("letters", "^[A-Za-z]+$", UPPER + LOWERC),
    ("alnum", "^[A-Za-z0-9]+$", UPPER + LOWERC + DIGITS),
    ("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWERC + DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", UPPER + LOWERC + DIGITS + "_-"),
    ("mixed", ".", UPPER + LOWERC + DIGITS + "+/_-"),
]
#: The chance that two letters of a natural token are equal, and how the statistic's root scatters.
REPEATS, SPREAD = 0.06, 1.5
#: Least length of each length class.
CLASSES = [20, 24, 32, 40, 64, 128]
#: Bins of evidence against a natural token, tenths of a standard deviation.
BINS = 120
CHUNK = 256


def _spans(text: Column, pattern: str, kind: int, keep=None, group: int = 0) -> Column:
    """Spans (start, kind, end, value) of the non-overlapping matches, places from the lengths of what lies between them."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    both = F.arrays_zip(found.alias("m"), value.alias("v"), F.slice(between, 1, F.size(found)).alias("b"))
    span = "struct<start: int, kind: int, end: int, value: string>"

    def step(acc: Column, x: Column) -> Column:
        low = acc["at"] + F.length(x["b"])
        high = low + F.length(x["m"])
        one = F.array(F.struct(low.alias("start"), F.lit(kind).alias("kind"), high.alias("end"), x["v"].alias("value")))
        kept = F.concat(acc["spans"], one) if keep is None else F.when(keep(x["v"]), F.concat(acc["spans"], one)).otherwise(acc["spans"])
        return F.struct(high.alias("at"), kept.alias("spans"))

    # matches in pieces, so that a text with very many does not copy one growing list
    def pieces(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda i: F.slice(x, i * CHUNK + 1, F.lit(CHUNK)))

    def placed(parts: Column) -> Column:
        wide = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + F.length(x["b"]) + F.length(x["m"])))
        before = _let(wide, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.aggregate(F.slice(w, F.lit(1), i), F.lit(0), lambda n, x: n + x)))
        begin = lambda at: F.struct(at.alias("at"), F.array().cast(f"array<{span}>").alias("spans"))
        return F.flatten(F.zip_with(parts, before, lambda p, at: F.aggregate(p, begin(at), step, lambda acc: acc["spans"])))

    spans = _let(both, lambda x: _let(pieces(x), placed))
    none = F.array().cast(f"array<{span}>")
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(none)


def _encoding(token: Column, pick) -> Column:
    out = None
    for name, pattern, alphabet in ENCODINGS:
        hit = F.rlike(token, F.lit(pattern))
        out = F.when(hit, pick(name, alphabet)) if out is None else out.when(hit, pick(name, alphabet))
    return out


def _erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (rational approximation, error under 1.2e-7)."""
    series = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]

    def tail(t: Column) -> Column:
        power = F.lit(series[-1])
        for c in series[-2::-1]:
            power = power * t + c
        return t * F.exp(-x * x + power)

    return _let(1 / (1 + x / 2), tail)


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _uniform(e: Column) -> Column:
    """Chi-squared test that all letters of the alphabet are as frequent, as a standard normal; only excess counts."""
    n, k = F.length(e["t"]).cast("double"), F.length(e["letters"]).cast("double")
    squares = F.aggregate(F.array_distinct(F.split(e["t"], "")), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.replace(e["t"], c, F.lit(""))), F.lit(2.0)))
    return F.greatest((k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n), F.lit(0.0))


def _runs(e: Column) -> Column:
    """Runs test on the halves of the alphabet."""
    n = F.length(e["halves"]).cast("double")
    swaps = lambda ab: (n - F.length(F.replace(e["halves"], F.lit(ab), F.lit("")))) / 2
    ones = n - F.length(F.replace(e["halves"], F.lit("a"), F.lit("")))
    mean = _let(ones, lambda m: 1 + 2 * m * (n - m) / n)
    return _let(mean, lambda m: (1 + swaps("ab") + swaps("ba") - m) / F.sqrt(F.greatest((m - 1) * (m - 2) / (n - 1), F.lit(0.25))))


def _serial(e: Column) -> Column:
    """Lag-1 serial correlation of the alphabet's indices."""
    index = F.transform(F.split(e["t"], ""), lambda c: F.instr(e["letters"], c).cast("double"))

    def correlate(x: Column) -> Column:
        n = F.size(x)
        add = lambda f: lambda acc, v: acc + f(v)
        total = F.aggregate(x, F.lit(0.0), add(lambda v: v))
        square = F.aggregate(x, F.lit(0.0), add(lambda v: v * v))
        lagged = F.aggregate(F.zip_with(F.slice(x, 1, n - 1), F.slice(x, 2, n - 1), lambda a, b: a * b), F.lit(0.0), add(lambda v: v))
        return _let(total * total / n, lambda base: (lagged - base) / F.greatest(square - base, F.lit(1e-9)) * F.sqrt(n.cast("double")))

    return _let(index, correlate)


def _battery(token: Column, use) -> Column:
    """use(statistic, letters of the alphabet) of the three tests together."""
    encoded = _encoding(token, lambda _, a: F.struct(token.alias("t"), F.lit(a).alias("letters"), F.translate(token, a, "a" * (len(a) // 2) + "b" * (len(a) - len(a) // 2)).alias("halves")))
    scores = _let(encoded, lambda e: F.struct(_uniform(e).alias("u"), _runs(e).alias("r"), _serial(e).alias("s"), F.length(e["letters"]).alias("k")))
    return _let(scores, lambda z: use(z["u"] * z["u"] + z["r"] * z["r"] + z["s"] * z["s"], z["k"]))


def randomness(token: Column) -> Column:
    """p-value of the hypothesis that the token's characters are drawn at random from its encoding's alphabet."""
    # survival function of chi-squared with three degrees of freedom
    tail = lambda t: _let(F.sqrt(t / 2), _erfc) + F.sqrt(t * (2 / math.pi)) * F.exp(-t / 2)
    return _battery(token, lambda statistic, k: _let(statistic, tail))


def evidence(token: Column) -> Column:
    """Standard deviations by which the token looks more random than a natural one of its length and alphabet."""
    def below(statistic: Column, k: Column) -> Column:
        natural = (k * REPEATS - 1) * (F.length(token) - 1) / F.sqrt(2.0 * (k - 1))
        return (natural - F.sqrt(statistic)) / SPREAD

    return _battery(token, below)


def _bin(z: Column) -> Column:
    return F.least(F.greatest(F.floor(z * 10), F.lit(0)), F.lit(BINS - 1)).cast("int")


def _class(length: Column) -> Column:
    return sum((F.when(length >= least, 1).otherwise(0) for least in CLASSES[1:]), F.lit(0))


def thresholds(histogram: list[tuple[int, int, int]], rate: float) -> list[int]:
    """By length class the least bin that counts as random (BINS: none), from (class, bin, count): Benjamini-Hochberg over the bins' p-values."""
    tested = [[0] * BINS for _ in CLASSES]
    for c, b, n in histogram:
        tested[c][b] += n
    out = []
    for counts in tested:
        m, beyond, best = sum(counts), 0, BINS
        for b in range(BINS - 1, 0, -1):
            beyond += counts[b]
            if beyond and math.erfc(b / 10 / math.sqrt(2)) / 2 <= rate * beyond / m:
                best = b
        out.append(best)
    return out


def scan(docs: DataFrame, text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base and found added: arrays of spans (start, kind, end, value), base ones and all."""
    text = text_of(text_col)
    token = F.explode(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias("t")
    tokens = docs.select(token).select(_class(F.length("t")).alias("c"), _bin(evidence(F.col("t"))).alias("b"))
    histogram = tokens.groupBy("c", "b").count().collect()  # a row per class and bin
    least = F.array(*[F.lit(x) for x in thresholds([tuple(r) for r in histogram], rate)])

    def is_random(t: Column) -> Column:
        return _bin(evidence(t)) >= F.element_at(least, _class(F.length(t)) + 1)

    known = (
        without(docs, ["n_assign", "n_access", "n_hex", "base", "found"])
        .withColumn("_qm_0", _spans(text, ASSIGN, 0, lambda v: F.length(v) >= 6, 2))
        .withColumn("_qm_1", _spans(text, ACCESS, 1))
        .withColumn("_qm_2", _spans(text, HEX, 2))
        .withColumn("_qm_3", _spans(text, TOKEN, 3, is_random))
    )
    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return (
        known.withColumns({f"n_{k}": F.size(f"_qm_{i}").cast("long") for i, k in enumerate(KINDS[:3])})
        .withColumn("base", F.array_sort(F.concat("_qm_0", "_qm_1", "_qm_2")))
        .withColumn("found", F.array_sort(F.concat("base", F.filter("_qm_3", apart))))
        .drop("_qm_0", "_qm_1", "_qm_2", "_qm_3")
    )


def digest(spans) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """One row a document: (id, n_assign, n_access, n_hex, base_sha256, spans)."""
    found = scan(docs.select(F.col(id_col), F.col(text_col)), text_col, rate)
    return found.select(id_col, "n_assign", "n_access", "n_hex", F.sha2(digest("base").cast("binary"), 256).alias("base_sha256"), digest("found").alias("spans"))
