"""Token counts at every prefix, by dynamic programming over byte-level BPE.

For each prefix of a pre-token exactly one vocabulary token can end its encoding:
the one whose predecessor (the last token of the prefix before it) does not merge
into it. So count[i] = count[i - len(token)] + 1, computed left to right, and
gives the exact count of every prefix (`PrefixCounter.prefixes`). Counts of
pre-tokens add up along a text, hence one array a text answers "how many tokens",
"what fits into a budget" and "is it over a limit" with no further encoding.

The vocabulary is read from a public tokenizer file whose path is a parameter; it
is never trained or changed here. Special tokens written inside a text count as
one token each, as the library does by default.

Cases: a null text counts as empty, with 0 tokens; whole texts are always
processed; repeated rows are counted each; an empty table gives an empty result;
input columns that clash with those added are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import text_of, without

#: Fixed value: the published pre-token pattern of the byte-level vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Everything str.isspace accepts but space and line feed.
ODD_SPACE = [c for c in map(chr, [*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]) if c != "\n"]
CACHE = 300_000


def byte_alphabet() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, others are shifted past 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.ids = {to_bytes(k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        names = {v: k for k, v in self.ids.items()}
        self.size = {v: len(k) for v, k in names.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, m in enumerate(spec["model"]["merges"]):
            left, right = (to_bytes(x) for x in (m.split(" ") if isinstance(m, str) else m))
            self.rank[self.ids[left], self.ids[right]] = (n, self.ids[left + right])
        self.parts = {new: pair for pair, (_, new) in sorted(self.rank.items(), key=lambda x: -x[1][0])}
        # Lengths of the tokens that end in given three bytes, longest first: the only ones worth looking up.
        ends: dict[bytes, set[int]] = {}
        for k in self.ids:
            if len(k) > 2:
                ends.setdefault(k[-3:], set()).add(len(k))
        self.ends = {k: (*sorted(v, reverse=True), 2, 1) for k, v in ends.items()}
        self.findall = regex.compile(PRETOKEN).findall
        self.fits: dict[tuple[int, int], bool] = {}
        self.chunks: dict[str, int] = {}
        self.pretokens: dict[str, int] = {}

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether the encoding of a's bytes followed by b's bytes is a, b: no merge across the border comes before those inside."""
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            got = self.fits[a, b] = self._border_holds(a, b)
        return got

    def _border_holds(self, a: int, b: int) -> bool:
        # Take the later of the two tokens apart, merge by merge, and see whether the border could have merged first.
        limit = 1 << 60
        while True:
            hit = self.rank.get((a, b))
            if hit is not None and hit[0] < limit:
                return False
            pa, pb = self.parts.get(a), self.parts.get(b)
            ra = self.rank[pa][0] if pa else -1
            rb = self.rank[pb][0] if pb else -1
            if ra < 0 and rb < 0:
                return True
            # Of equal ranks the leftmost merge comes first, so a merge across the border
            # goes before an equal one inside the right token and after one inside the left.
            if ra > rb:
                limit, a = ra, pa[1]
            else:
                limit, b = rb + 1, pb[0]

    def prefixes(self, piece: bytes) -> np.ndarray:
        """count[i]: tokens of the first i bytes of one pre-token, for every i."""
        count, last = [0], [-1]
        self._extend(piece, count, last)
        return np.array(count)

    def _extend(self, piece: bytes, count: list[int], last: list[int]) -> None:
        """Carries the table on from the prefix it already covers to all of piece."""
        get, ends, fits = self.ids.get, self.ends.get, self.fits
        for i in range(len(count), len(piece) + 1):
            for size in ends(piece[i - 3 : i], (2, 1)) if i > 2 else (2, 1):
                j = i - size
                if j < 0:
                    continue
                t = get(piece[j:i])
                if t is None:
                    continue
                if j:
                    pair = last[j], t
                    ok = fits.get(pair)
                    if ok is None:
                        ok = self._may_follow(*pair)
                    if not ok:
                        continue
                count.append(count[j] + 1)
                last.append(t)
                break

    def learn(self, pieces: set[str]) -> dict[str, int]:
        """Counts of new pre-tokens. In sorted order neighbours share prefixes, whose table entries are kept."""
        out, count, last, before = {}, [0], [-1], b""
        for piece, s in sorted((s.encode(), s) for s in pieces):
            same, most = 0, min(len(before), len(piece))
            while same < most and before[same] == piece[same]:
                same += 1
            del count[same + 1 :], last[same + 1 :]
            self._extend(piece, count, last)
            out[s], before = count[-1], piece
        return out

    def pieces(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk; the pattern's common cases need no pattern."""
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha():
            return [chunk]
        if word[:-1].isalpha() and word[-1] in ".,;:!?":
            return [chunk[:-1], chunk[-1]]
        return self.findall(chunk)

    def chunked(self, text: str) -> list[str]:
        """The text in chunks that encode alike wherever they stand: cut before single spaces between other characters."""
        if not text:
            return []
        if text[0] != " " and text[-1] != " " and "  " not in text and " \n" not in text and "\n " not in text and not any(c in text for c in ODD_SPACE):
            return text.replace(" ", "\0 ").split("\0") if "\0" not in text else [text]
        return [text]

    def counts(self, texts: list[str]) -> list[int]:
        """Exact token counts of whole texts, special strings as one token each."""
        parts, extra = [], []
        for t in texts:
            if self.split_special and any(s in t for s in self.special):
                found = self.split_special.split(t)
                parts.append([c for x in found for c in self.chunked(x)])
                extra.append(len(found) - 1)
            else:
                parts.append(self.chunked(t))
                extra.append(0)
        chunks, pre = self.chunks, self.pretokens
        if len(chunks) > CACHE:
            chunks.clear()
        if len(pre) > CACHE:
            pre.clear()
        new = {c: self.pieces(c) for p in parts for c in set(p).difference(chunks)}
        pre.update(self.learn({x for p in new.values() for x in p if x not in pre}))
        found = {c: sum(map(pre.__getitem__, p)) for c, p in new.items()}
        chunks.update(found)
        out = [sum(map(chunks.__getitem__, p)) + e for p, e in zip(parts, extra, strict=True)]
        for long in (c for c in found if len(c) > 64):
            del chunks[long]
        for long in [x for p in new.values() for x in p if len(x) > 64]:
            pre.pop(long, None)
        return out

    def count(self, text: str) -> int:
        return self.counts([text])[0]

    def boundaries(self, text: str) -> tuple[list[int], list[int]]:
        """Byte offset and token count after every pre-token; between them `prefixes` of the pre-token adds on."""
        at, n, ends, counts = 0, 0, [], []
        pieces = self.split_special.split(text) if self.split_special else [text]
        marks = self.split_special.findall(text) if self.split_special else []
        for k, piece in enumerate(pieces):
            for s in self.findall(piece):
                at, n = at + len(s.encode()), n + int(self.prefixes(s.encode())[-1])
                ends.append(at)
                counts.append(n)
            if k < len(marks):
                at, n = at + len(marks[k].encode()), n + 1
                ends.append(at)
                counts.append(n)
        return ends, counts


def _slices(texts: list[str], chars: int = 2_000_000) -> Iterator[list[str]]:
    """Runs of texts of about so many characters, to bound what is held at once."""
    own, n = [], 0
    for t in texts:
        own.append(t)
        n += len(t)
        if n > chars:
            yield own
            own, n = [], 0
    if own:
        yield own


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit) added. No shuffle; the path must be readable on every executor."""
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(tokenizer)
        for s in texts:
            yield pd.Series([n for part in _slices(list(s)) for n in c.counts(part)], dtype="int64")

    n = F.pandas_udf(run, "long")(text_of(text_col))
    return (
        without(docs, ["n_bytes", "n_tokens", "over_limit"])
        .withColumn("n_bytes", F.octet_length(text_of(text_col)).cast("long"))
        .withColumn("n_tokens", n)
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def token_prefixes(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """docs with prefix_bytes and prefix_tokens: offset and exact token count after each pre-token of the whole text."""
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = counter(tokenizer)
        for s in texts:
            yield pd.DataFrame([c.boundaries(t) for t in s], columns=["prefix_bytes", "prefix_tokens"])

    both = F.pandas_udf(run, "prefix_bytes array<long>, prefix_tokens array<long>")(text_of(text_col))
    return without(docs, ["prefix_bytes", "prefix_tokens"]).withColumn("_qm_p", both).select("*", "_qm_p.*").drop("_qm_p")


def fit_budget(prefixed: DataFrame, budget) -> DataFrame:
    """Adds fit_bytes and fit_tokens: the longest run of whole pre-tokens within `budget` tokens (a number or a column)."""
    k = F.size(F.filter("prefix_tokens", lambda n: n <= budget))
    at = lambda c: F.when(k > 0, F.element_at(c, F.greatest(k, F.lit(1)))).otherwise(F.lit(0).cast("long"))
    return prefixed.withColumns({"fit_bytes": at("prefix_bytes"), "fit_tokens": at("prefix_tokens")})
