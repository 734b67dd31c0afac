"""Evidence: quotes aligned to exact source spans, supports pruned, numbered and audited.

Offsets are code points, from 0, ends exclusive; `span_text` is the one place that
turns them into Spark's 1-based substrings.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill import shared

LIMIT = 80
LONGEST_QUOTE = 10_000

#: Marks that end a sentence of the source, the mark of a left-out passage, quotation marks that a copy may
#: leave out, brackets of edition notes, a glyph the source cannot show, and variants that stand for a common glyph.
SENTENCE_ENDS = "。！？；\n\r"
ELLIPSIS = "……"
QUOTATION_MARKS = "「」『』"
EDITION_NOTE = r"〈[^〈〉\r\n]*〉|［[^［］\r\n]*］|\([^()\r\n]*\)|（[^（）\r\n]*）"
NUMBERED_NOTE = r"\[\d+\]"
READING_OF_GAP = r"□(?:\([^()\r\n]*作「([^」\r\n]{1,4})」[^()\r\n]*\)|（[^（）\r\n]*作「([^」\r\n]{1,4})」[^（）\r\n]*）)"
NO_GLYPH = "\U000f2cf4"
VARIANTS = {"釡": "釜"}

SENTENCE = "。！？；.!?;"


def span_text(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start.cast("int") + 1, (end - start).cast("int"))


class Places:
    """A rewritten form of a source, and for each of its characters the span of the source that it stands for."""

    def __init__(self, pieces: Iterable[tuple[str, int, int]]):
        own = [(c, a, b) for piece, a, b in pieces for c in piece]
        self.text = "".join(c for c, _, _ in own)
        self.spans = [(a, b) for _, a, b in own]

    def find(self, quote: str, alone: bool) -> tuple[int, int] | None:
        """The source span of a quote in this form; `alone`: only if it stands there once."""
        at = self.text.find(quote) if len(quote) >= 2 else -1
        if at < 0 or (alone and self.text.count(quote) != 1):
            return None
        return self.spans[at][0], self.spans[at + len(quote) - 1][1]


def places(text: str, write: Callable[[str], str], left_out: str | None = None, readings: bool = False) -> Places:
    """The form of a source in which every character is what `write` makes of it, notes are left out and, with `readings`, a gap is what its note reads."""
    notes = "|".join(p for p in (READING_OF_GAP if readings else None, left_out) if p)
    pieces, at = [], 0
    for m in re.finditer(notes, text) if notes else ():
        pieces += [(write(text[i]), i, i + 1) for i in range(at, m.start())]
        if m.lastindex:
            pieces.append(("".join(map(write, m[m.lastindex])), *m.span()))
        at = m.end()
    pieces += [(write(text[i]), i, i + 1) for i in range(at, len(text))]
    return Places(pieces)


class Form(dict):
    """What `write` makes of each character, remembered by code point, as str.translate takes it."""

    def __init__(self, write: Callable[[str], str]):
        super().__init__()
        self.write = write

    def __missing__(self, code: int) -> str:
        self[code] = self.write(chr(code))
        return self[code]

    def __call__(self, c: str) -> str:
        return self[ord(c)]


def _place(text: str, form: Form, a: int, b: int, at: int) -> int:
    """Which character between a and b is written as the one at `at` of their form; halves are rewritten, so that it takes as long as one reading."""
    while b - a > 1:
        mid = (a + b) // 2
        n = len(text[a:mid].translate(form))
        a, b, at = (a, mid, at) if at < n else (mid, b, at - n)
    return a


def locate(text: str, quote: str, form: Form, left_out: str, alone: bool = True) -> tuple[int, int] | None:
    """`places(...).find(quote, alone)`; no places are worked out but the two ends of what is found."""
    if len(quote) < 2:
        return None
    cuts = [0, *[x for m in re.finditer(left_out, text) for x in m.span()], len(text)]
    parts = [text[a:b].translate(form) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
    whole = "".join(parts)
    at = whole.find(quote)
    if at < 0 or (alone and whole.count(quote) != 1):
        return None
    to, ends, done = at + len(quote) - 1, [], 0
    for a, b, own in zip(cuts[::2], cuts[1::2], parts, strict=True):
        ends += [_place(text, form, a, b, k - done) for k in (at, to) if done <= k < done + len(own)]
        done += len(own)
    return ends[0], ends[1] + 1


SAME = Form(str)


@lru_cache(maxsize=8)
def _writers(glyphs: tuple[tuple[int, str], ...]) -> tuple[Form, ...]:
    """How a character is written in display form and without punctuation, in a quote and in its source."""
    table = dict(glyphs)
    shown = lambda c: c.translate(table)
    display = lambda c: "" if c in QUOTATION_MARKS else shown(c)
    bare = lambda c: "" if c.isspace() or unicodedata.category(c) in ("Cf", "Cc") or unicodedata.category(c)[0] == "P" else shown(c)

    def of_source(write):
        return lambda c: "" if c == NO_GLYPH or unicodedata.category(c) == "Cf" else write(VARIANTS.get(c, c))

    return Form(display), Form(of_source(display)), Form(bare), Form(of_source(bare))


def _cut(text: str, span: tuple[int, int], limit: int) -> tuple[int, int]:
    """The span, or of a longer one what ends with the last sentence end within the limit, or its beginning."""
    a, b = span
    if b - a <= limit:
        return span
    end = max(text.rfind(c, a + 1, a + limit) for c in SENTENCE_ENDS)
    return (a, end + 1) if end > 0 else (a, a + limit)


def _across(text: str, left: str, right: str) -> tuple[int, int] | None:
    """The span from one part to another that follows it, each there once."""
    if text.count(left) != 1 or text.count(right) != 1:
        return None
    a = text.find(left)
    b = text.find(right, a + len(left))
    return None if b < 0 else (a, b + len(right))


def _left_out(text: str, quote: str, limit: int) -> tuple[int, int] | None:
    """The one span that all halves of a quote agree on, where what they leave out crosses a sentence end."""
    found = set()
    for cut in range(2, len(quote) - 1):
        if max(cut, len(quote) - cut) >= 8 and (span := _across(text, quote[:cut], quote[cut:])):
            gap = text[span[0] + cut : span[1] - (len(quote) - cut)]
            if any(c in SENTENCE_ENDS for c in gap) and span[1] - span[0] <= limit:
                found.add(span)
    return found.pop() if len(found) == 1 else None


def align(text: str, quote: str | None, glyphs: dict[int, str] | None = None, limit: int = LIMIT) -> tuple[int, int] | None:
    """The exact span of a quote in its source, or None: nothing is guessed, and a span is never longer than `limit`.

    Rungs, first success wins:
    1. the quote as it is (a longer one is cut at a sentence end);
    2. one marked omission between two parts that each stand once;
    3. the source without its edition notes (cut likewise);
    4. both in display form, without quotation marks, once;
    5. the same where a gap stands for what its note reads;
    6. both without punctuation and white space, once;
    7. an unmarked omission across a sentence end, the same for every way to halve the quote.
    """
    quote = (quote or "").strip()
    if not 2 <= len(quote) <= LONGEST_QUOTE:
        return None
    at = text.find(quote)
    if at >= 0:
        return _cut(text, (at, at + len(quote)), limit)
    fits = lambda span: span is not None and span[1] - span[0] <= limit
    if quote.count(ELLIPSIS) == 1:
        parts = quote.split(ELLIPSIS)
        if min(map(len, parts)) >= 2 and fits(span := _across(text, *parts)):
            return span
    if re.search(EDITION_NOTE, text) and (span := locate(text, quote, SAME, EDITION_NOTE, alone=False)):
        return _cut(text, span, limit)
    notes = f"{NUMBERED_NOTE}|{EDITION_NOTE}"
    display, display_source, bare, bare_source = _writers(tuple(sorted((glyphs or {}).items())))
    shown = quote.translate(display)
    if span := locate(text, shown, display_source, notes):
        a, b = span
        while a > 0 and text[a - 1] in QUOTATION_MARKS:
            a -= 1
        while b < len(text) and text[b] in QUOTATION_MARKS:
            b += 1
        if fits((a, b)):
            return a, b
    if re.search(READING_OF_GAP, text) and fits(span := places(text, display_source, notes, readings=True).find(shown, True)):
        return span
    if fits(span := locate(text, quote.translate(bare), bare_source, notes)):
        return span
    return _left_out(text, quote, limit) if 4 <= len(quote) <= limit else None


def align_segments(text: str, quote: str | None, glyphs: dict[int, str] | None = None, limit: int = LIMIT) -> list[tuple[int, int]] | None:
    """Spans of a quote's parts, cut at ellipses or else at sentence ends, or None.

    There must be two parts at least, every part must have two characters and be found,
    and what is found must stand in the source once and after the part before.
    """
    quote = quote or ""
    marked = re.split(r"……|\.{3,}", quote)
    parts = [p.strip() for p in (marked if len(marked) > 1 else re.findall("[^。！？；]+[。！？；]?", quote))]
    if len(marked) == 1:
        parts = [p for p in parts if p]
    if len(parts) < 2 or min(map(len, parts)) < 2:
        return None
    out: list[tuple[int, int]] = []
    for p in parts:
        span = align(text, p, glyphs, limit)
        if span is None or text.count(text[slice(*span)]) != 1 or (out and span[0] < out[-1][1]):
            return None
        out.append(span)
    return out


def _spans(find: Callable[[str, str], object], kind: str, text: Column | str = "text", quote: Column | str = "quote") -> Column:
    """find(text, quote) for each row, in batches."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, own in parts:
            yield pd.Series([find(t or "", q) for t, q in zip(texts, own, strict=True)], dtype=object)

    return F.pandas_udf(run, kind)(text, quote)


def _matched(quotes: DataFrame, texts: DataFrame, find: Callable[[str, str], object], kind: str, key: str, limit: int) -> DataFrame:
    """quotes with their text, the span (_qm_a, _qm_b) of one that is an exact substring, and as _qm_s what find gives for the others.

    One pass: texts and quotes of exact substrings go to Python as null, for which find gives null.
    """
    j = quotes.join(texts.select(key, "text"), key)
    j = j.withColumn("_qm_q", F.regexp_replace("quote", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    j = j.withColumn("_qm_a", (F.instr("text", F.col("_qm_q")) - 1).cast("long"))
    bare, n = F.col("_qm_q"), F.length("_qm_q")
    sound = F.coalesce((F.col("_qm_a") >= 0) & n.between(2, LONGEST_QUOTE), F.lit(False))
    until = F.length(F.regexp_extract(F.substring(bare, 1, limit), f"(?s)^.+[{SENTENCE_ENDS}]", 0))
    length = F.when(n <= limit, n).when(until > 0, until).otherwise(limit)
    j = j.withColumn("_qm_a", F.when(sound, F.col("_qm_a"))).withColumn("_qm_b", F.col("_qm_a") + length)
    rest = lambda c: F.when(F.col("_qm_a").isNull(), F.col(c))
    return j.withColumn("_qm_s", _spans(find, kind, rest("text"), rest("quote"))).drop("_qm_q")


def aligned(quotes: DataFrame, texts: DataFrame, key: str = "entry_id", glyphs: dict[int, str] | None = None, limit: int = LIMIT) -> DataFrame:
    """quotes (key, quote, ...) with start, end (null where unaligned) and excerpt; only quotes that are no exact substring go to Python."""
    j = _matched(quotes, texts, lambda t, q: align(t, q, glyphs, limit), "array<long>", key, limit)
    j = j.withColumns({"start": F.coalesce("_qm_a", F.get("_qm_s", F.lit(0))), "end": F.coalesce("_qm_b", F.get("_qm_s", F.lit(1)))})
    return j.withColumn("excerpt", span_text(F.col("text"), F.col("start"), F.col("end"))).drop("text", "_qm_a", "_qm_b", "_qm_s")


#: Type of the spans that a quote's parts have.
SPANS = "array<struct<start: long, end: long, excerpt: string>>"


def _pieces(text: str, own: list[tuple[int, int]] | None) -> list[dict] | None:
    return None if own is None else [{"start": a, "end": b, "excerpt": text[a:b]} for a, b in own]


def segmented(quotes: DataFrame, texts: DataFrame, key: str = "entry_id", glyphs: dict[int, str] | None = None, limit: int = LIMIT) -> DataFrame:
    """quotes (key, quote, ...) with `spans`, an array of (start, end, excerpt), null where a part is not found."""
    j = quotes.join(texts.select(key, "text"), key)
    return j.withColumn("spans", _spans(lambda t, q: _pieces(t, align_segments(t, q, glyphs, limit)), SPANS)).drop("text")


def settle(quotes: DataFrame, texts: DataFrame, required: DataFrame, key: str = "entry_id", glyphs: dict[int, str] | None = None, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """Evidence of the quotes (key, quote, supports) that stand in their source, and what becomes of the entries.

    A quote that does not align whole is tried by segments, each of which carries its
    supports; one that does not align at all goes. Spans are worked out once and written,
    as evidence and entries both come from them. An entry that has lost all evidence of
    a required support (key, support) is not ok: it fails closed instead of standing
    without proof. Returns (key, excerpt, start, end, supports) and (key, dropped, lost, ok).
    """
    def find(t: str, q: str | None) -> list[dict] | None:
        span = align(t, q, glyphs, limit)
        return _pieces(t, align_segments(t, q, glyphs, limit) if span is None else [span])

    j = _matched(quotes, texts, find, SPANS, key, limit)
    whole = F.array(F.struct(F.col("_qm_a").alias("start"), F.col("_qm_b").alias("end"), span_text(F.col("text"), F.col("_qm_a"), F.col("_qm_b")).alias("excerpt")))
    parts = shared.keep(j.select(key, "supports", F.when(F.col("_qm_a").isNotNull(), whole).otherwise(F.col("_qm_s")).alias("spans")), "spans")
    found = parts.select(key, "supports", F.inline("spans"))
    evidence = found.groupBy(key, "excerpt").agg(F.min("start").alias("start"), F.min("end").alias("end"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("supports")))).alias("supports"))
    dropped = parts.filter("spans is null").groupBy(key).agg(F.count("*").alias("dropped"))
    have = evidence.select(key, F.explode("supports").alias("support")).distinct()
    lost = required.distinct().join(have, [key, "support"], "left_anti").groupBy(key).agg(F.sort_array(F.collect_set("support")).alias("lost"))
    entries = texts.select(key).join(dropped, key, "left").join(lost, key, "left")
    entries = entries.select(key, F.coalesce("dropped", F.lit(0)).alias("dropped"), F.coalesce("lost", F.array().cast("array<string>")).alias("lost"))
    return evidence, entries.withColumn("ok", F.size("lost") == 0)


def evidence_map(rows: DataFrame, key: str = "entry_id") -> DataFrame:
    """(key, excerpt, supports): the set of supports of each excerpt."""
    return rows.groupBy(key, "excerpt").agg(F.sort_array(F.collect_set("support")).alias("supports"))


def prune(labels: DataFrame, evidence: DataFrame, key: str = "entry_id") -> DataFrame:
    """(key, label, kept): labels stay only with evidence that supports them."""
    have = evidence.select(key, F.explode("supports").alias("label")).distinct().withColumn("kept", F.lit(True))
    return labels.join(have, [key, "label"], "left").select(key, "label", F.coalesce("kept", F.lit(False)).alias("kept"))


def required_supports(record: DataFrame, key: str, single: list[str], many: list[str]) -> DataFrame:
    """(key, support): the paths of all labels that need evidence."""
    paths = [F.when(F.col(c).isNotNull(), F.array(F.concat(F.lit(f"{c}."), F.col(c).cast("string")))).otherwise(F.array().cast("array<string>")) for c in single]
    prefixed = lambda c: lambda v: F.concat(F.lit(f"{c}."), v)
    paths += [F.transform(c, prefixed(c)) for c in many]
    return record.select(key, F.explode(F.flatten(F.array(*paths))).alias("support")).distinct()


def retain_targets(evidence: DataFrame, targets: DataFrame, key: str = "entry_id") -> DataFrame:
    """Evidence whose supports point at existing targets only; excerpts with none left go."""
    rows = evidence.select(key, "excerpt", F.explode("supports").alias("support")).join(targets, [key, "support"], "left_semi")
    return evidence_map(rows, key)


def number(evidence: DataFrame, texts: DataFrame, key: str = "entry_id") -> DataFrame:
    """evidence with id, start and end: numbered by place in the source."""
    j = evidence.join(texts.select(key, "text"), key).withColumn("start", (F.instr("text", F.col("excerpt")) - 1).cast("long"))
    n = F.row_number().over(W.partitionBy(key).orderBy("start", "excerpt"))
    return j.withColumns({"end": F.col("start") + F.length("excerpt"), "id": F.format_string("E%02d", n)}).drop("text")


def offset_audit(evidence: DataFrame, texts: DataFrame, key: str = "entry_id", limit: int = LIMIT) -> DataFrame:
    """(key, id, code) of evidence out of range, too long, or not what stands there."""
    j = evidence.join(texts.select(key, "text"), key)
    out = (F.col("start") < 0) | (F.col("end") > F.length("text")) | (F.col("start") >= F.col("end"))
    code = F.when(out, "range").when(F.length("excerpt") > limit, "length").when(span_text(F.col("text"), F.col("start"), F.col("end")) != F.col("excerpt"), "not_exact")
    return j.select(key, "id", code.alias("code")).filter("code is not null")


def support_audit(evidence: DataFrame, required: DataFrame, key: str = "entry_id") -> DataFrame:
    """(key, support, code): required supports without evidence, and supports that nothing requires."""
    have = evidence.select(key, F.explode("supports").alias("support")).distinct()
    missing = required.join(have, [key, "support"], "left_anti").select(key, "support", F.lit("missing").alias("code"))
    return missing.union(have.join(required, [key, "support"], "left_anti").select(key, "support", F.lit("dangling").alias("code")))


def unresolved_references(references: DataFrame, evidence: DataFrame, key: str = "entry_id") -> DataFrame:
    """(key, field, id) of references to evidence the same record does not have."""
    return references.select(key, "field", F.explode("ids").alias("id")).join(evidence.select(key, "id"), [key, "id"], "left_anti")


def recover_quote(quotes: DataFrame, texts: DataFrame, key: str = "entry_id", least: int = 4) -> DataFrame:
    """(key, quote, fragment): the longest piece of a quote, of at least `least` characters, that stands in the source."""
    pieces = quotes.select(key, "quote", F.explode(F.split("quote", f"[…{SENTENCE},，、]+")).alias("p")).withColumn("p", F.trim("p")).filter(F.length("p") >= least)
    hits = pieces.join(texts.select(key, "text"), key).filter(F.contains("text", F.col("p")))
    return hits.groupBy(key, "quote").agg(F.max(F.struct(F.length("p").alias("n"), "p"))["p"].alias("fragment"))


def compact(evidence: DataFrame, required: DataFrame, key: str = "entry_id", most: int = 24) -> DataFrame:
    """(key, excerpt, start, ok): at most `most` excerpts an entry that cover the required supports; ok is false where that takes more.

    Entries that hold no more are passed through; the others go through greedy cover: most
    new supports, then shorter, then earlier. Of an entry only two things count, its first
    `most` excerpts and, of each different set of supports, the excerpt that comes first
    (an equal set adds nothing after it), so that these few are one row an entry.
    """
    count = evidence.groupBy(key).agg(F.count("*").alias("_qm_n"))
    own = evidence.select(key, "excerpt", "start", F.sort_array(F.array_distinct("supports")).alias("supports"))
    place = F.row_number().over(W.partitionBy(key).orderBy("start", "excerpt", "supports"))
    first = own.withColumn("_qm_i", place).filter(F.col("_qm_i") <= most).groupBy(key).agg(F.collect_list(F.struct("start", "excerpt", "supports")).alias("first"))
    best = own.groupBy(key, "supports").agg(F.min(F.struct(F.length("excerpt").alias("n"), "start", "excerpt")).alias("b"))
    best = best.groupBy(key).agg(F.collect_list(F.struct("b.start", "b.excerpt", "supports")).alias("best"))
    need = required.groupBy(key).agg(F.collect_set("support").alias("need"))
    j = count.join(first, key).join(best, key).join(need, key, "left")
    few = j.filter(F.col("_qm_n") <= most).select(key, F.inline("first")).select(key, "excerpt", "start", F.lit(True).alias("ok"))
    kind = dict(evidence.dtypes)[key]

    def cover(first: list, best: list, need: list | None) -> tuple[list, bool]:
        rows = sorted((r["start"], r["excerpt"], tuple(r["supports"])) for r in first)
        sets, left, chosen = [(r["start"], r["excerpt"], tuple(r["supports"])) for r in best], set(need if need is not None else ()), []
        while left and sets:
            pick = min(sets, key=lambda r: (-len(left.intersection(r[2])), len(r[1]), r[0], r[1]))
            if not left.intersection(pick[2]):
                break
            chosen.append(pick)
            sets.remove(pick)
            left.difference_update(pick[2])
        for r in chosen:
            if r in rows:
                rows.remove(r)
        return sorted((chosen + rows)[: max(most, 0)], key=lambda r: r[:2]), not left and len(chosen) <= most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, *parts in zip(b[key], b["first"], b["best"], b["need"], strict=True):
                chosen, ok = cover(*parts)
                out += [(k, e, start, ok) for start, e, _ in chosen]
            yield pd.DataFrame(out, columns=[key, "excerpt", "start", "ok"])

    many = j.filter(F.col("_qm_n") > most).select(key, "first", "best", "need")
    return few.unionByName(many.mapInPandas(run, f"{key} {kind}, excerpt string, start long, ok boolean"))
