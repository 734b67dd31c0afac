"""Text functions on columns; null in, null out unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentence marks at which a clipped text may end.
SENTENCE_END = "[。！？；.!?;]"
#: What counts as private detail in a conversation.
MAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
MOBILE = r"(?<!\d)1[3-9]\d{9}(?!\d)"
ID_CARD = r"(?<!\d)\d{17}[\dXx](?!\d)"
DIGIT_RUN = r"(?<!\d)\d{6,}(?!\d)"


def stable_hash(value: Column) -> Column:
    """SHA-256 of the canonical JSON of a struct whose fields are declared alphabetically; nulls are kept."""
    return F.sha2(F.to_json(value, {"ignoreNullFields": "false"}).cast("binary"), 256)


def text_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def compact_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def nfkc(text: Column) -> Column:
    """Unicode compatibility form; Spark has no built-in for it."""
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.pandas_udf(run, "string")(text)


def comparison_text(text: Column, notes: str | None = None, normalise: bool = True) -> Column:
    """What two copies of a text share: compatibility form, without trailing notes, punctuation and separators."""
    t = nfkc(text) if normalise else text
    if notes:
        t = F.regexp_replace(t, f"(?:{notes})$", "")
    return F.regexp_replace(t, r"[\p{P}\p{Z}]", "")


def clip_at_sentence(text: Column, limit: int) -> Column:
    """Compacted text of at most `limit` characters and an ellipsis, cut back to a sentence end that keeps enough of it."""
    t = compact_text(text)
    head = F.substring(t, 1, limit)
    cut = F.regexp_extract(head, f"(?s)^(.*{SENTENCE_END})", 1)
    kept = F.when(F.length(cut) - 1 >= max(40, limit // 2), cut).otherwise(head)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(kept), F.lit("…")))


def length_bucket(n: Column, edges: tuple[int, ...] = (100, 500, 1000, 3000)) -> Column:
    """Number of edges that the length has passed."""
    return sum((F.when(n >= e, 1).otherwise(0) for e in edges), F.lit(0))


def chunks(text: Column, size: int = 1500, overlap: int = 150) -> Column:
    """Overlapping pieces with absolute offsets: array of (start, piece)."""
    last = F.greatest(F.length(text) - overlap - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last, F.lit(size - overlap)), lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("piece")))


def clean_copy(text: Column) -> Column:
    """Collapsed white space, single book marks, no mark repeated in a row, no space before a mark."""
    t = F.regexp_replace(F.regexp_replace(compact_text(text), "《+", "《"), "》+", "》")
    return F.regexp_replace(F.regexp_replace(t, r"([。！？；，、.,!?;])\1+", "$1"), r" +([。！？；，、.,!?;])", "$1")


def clauses(text: Column, prefix: str = "^(?:user|I)[：:]", least: int = 3) -> Column:
    """Distinct clauses of at least `least` characters, speaker marks removed, in order."""
    parts = F.transform(F.split(compact_text(text), "[。！？!?；;，,.]+"), lambda c: F.trim(F.regexp_replace(F.trim(c), prefix, "")))
    return F.array_distinct(F.filter(parts, lambda c: F.length(c) >= least))


def scrub_identity(text: Column) -> Column:
    """Mail addresses, mobile numbers, id-card numbers and long digit runs become a space."""
    t = compact_text(text)
    for pattern in (MAIL, MOBILE, ID_CARD, DIGIT_RUN):
        t = F.regexp_replace(t, pattern, " ")
    return compact_text(t)


def matched_terms(text: Column, terms: Column, most: int = 4) -> Column:
    """The first `most` terms that the text contains."""
    return F.slice(F.filter(terms, lambda t: F.contains(text, t)), 1, most)


def page_url(base: str, title: Column) -> Column:
    return F.concat(F.lit(base), F.url_encode(title))


def revision_of(link: Column) -> Column:
    """The numeric oldid of a permalink."""
    return F.try_parse_url(link, F.lit("QUERY"), F.lit("oldid")).try_cast("long")


def timestamp_problem(value: Column, now: Column) -> Column:
    """Why a timestamp text is not acceptable, null if it is; five minutes of slack for clocks."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"
    t = F.try_to_timestamp(value)
    return F.when(~F.rlike(value, F.lit(shape)), "shape").when(t.isNull(), "not_a_time").when(t > now + F.expr("interval 5 minutes"), "future")


def bounded(text: Column, least: int, most: int) -> Column:
    return F.length(F.trim(text)).between(least, most)


def json_object(raw: Column) -> Column:
    """The text if it parses as a JSON object, else null."""
    v = F.try_parse_json(raw)
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")) & F.rlike(raw, F.lit(r"\}\s*$")), raw)


def nonnegative_int(value: Column) -> Column:
    """An integer of at least 0, null for anything else, booleans included."""
    n = F.when(F.rlike(value, F.lit(r"^\d+$")), value.try_cast("long"))
    return F.when(n >= 0, n)


def context_window(text: Column, start: Column, end: Column, reach: int = 38, most: int = 80) -> Column:
    """The exact stretch around [start, end) up to sentence marks, at most `most` characters."""
    left_part = F.substring(text, F.greatest(start - reach, F.lit(0)) + 1, F.least(start, F.lit(reach)))
    left = F.regexp_extract(left_part, r"(?s)([^。；！？.;!?\n\r]*)$", 1)
    right = F.regexp_extract(F.substring(text, end + 1, F.lit(reach)), r"(?s)^([^。；！？.;!?\n\r]*[。；！？.;!?]?)", 1)
    inner = F.substring(text, start + 1, end - start)
    return F.substring(F.trim(F.concat(left, inner, right)), 1, most)


def is_unknown_statement(value: Column) -> Column:
    """Whether a text only says that nothing is known."""
    t = F.lower(F.regexp_replace(value, r"\s+", ""))
    return F.rlike(t, F.lit(r"^(?:unknown|unclear|none|n/a|未知|不明|无)$|^no(?:clear|explicit|evident).*trigger"))


#: Fixed value: marks and spaces that do not count at the ends of a term.
TERM_MARKS = r"[\s，。！？；：、,.!?;:()（）]+"


def specific_term(value: Column, generic: list[str], least: int = 3, most: int = 16) -> Column:
    """The term if it is long enough, not generic and not made of generic terms only; else null."""
    t = F.regexp_replace(value, rf"^{TERM_MARKS}|{TERM_MARKS}$|\s", "")
    rest = F.regexp_replace(t, "|".join(sorted(generic, key=len, reverse=True)), "") if generic else t
    return F.when(F.length(t).between(least, most) & (F.length(rest) > 0), t)


def simplified(text: Column, mapping: dict[str, str]) -> Column:
    """Glyphs replaced by a given one-to-one table."""
    return F.translate(text, "".join(mapping), "".join(mapping.values())) if mapping else text
