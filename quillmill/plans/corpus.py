"""Queries of text functions, scans, filters, dedup and corpus aggregates, over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as tx
from quillmill.operators import dedup
from quillmill.registry import Tables, query


def entries(t: Tables) -> DataFrame:
    """documents as corpus entries: source is the work, doc_id the entry."""
    return t.documents.select(F.col("doc_id").alias("entry_id"), F.col("source").alias("work"), "lang", "text")


def marked(t: Tables) -> DataFrame:
    return dedup.mark_duplicates(dedup.with_hashes(entries(t)))


MARKED = r"""
e AS (SELECT doc_id AS entry_id, source AS work, lang, text, length(text)::INT AS char_count, sha256(text) AS text_sha256,
      sha256(regexp_replace(text, '[\p{P}\p{Z}]', '', 'g')) AS normal_sha256 FROM documents),
m AS (SELECT *, first_value(entry_id) OVER (PARTITION BY normal_sha256 ORDER BY work, entry_id) AS canonical_id FROM e),
k AS (SELECT *, CASE WHEN entry_id = canonical_id THEN 'canonical' ELSE 'exact_duplicate' END AS dedupe_status, entry_id = canonical_id AS runtime_eligible FROM m)"""


@query("w1_exact_dedup", f"WITH {MARKED} SELECT entry_id, normal_sha256, canonical_id, dedupe_status, runtime_eligible FROM k")
def _(t):
    return marked(t).select("entry_id", "normal_sha256", "canonical_id", "dedupe_status", "runtime_eligible")


@query("a3_work_counts", f"WITH {MARKED} SELECT work, count(*) AS n FROM k WHERE runtime_eligible GROUP BY ROLLUP (work)")
def canonical_counts(t):
    return dedup.work_counts(dedup.canonical_entries(marked(t)))


@query("s1_canonical_scan", f"WITH {MARKED} SELECT entry_id, work, char_count, true AS hash_ok FROM k WHERE runtime_eligible")
def _(t):
    return dedup.canonical_entries(marked(t)).select("entry_id", "work", "char_count", "hash_ok")


@query("j4_dangling_pointers", f"WITH {MARKED} SELECT entry_id, canonical_id FROM k WHERE dedupe_status = 'exact_duplicate' AND canonical_id NOT IN (SELECT entry_id FROM k WHERE runtime_eligible AND char_count >= 500)")
def _(t):
    # against the rows of a published edition that leaves short ones out, so that there is something to find
    m = marked(t)
    published = m.filter((F.col("dedupe_status") == "exact_duplicate") | (F.col("char_count") >= 500))
    return dedup.dangling_pointers(published).select("entry_id", "canonical_id")


@query("a4_build_summary", f"""WITH {MARKED} SELECT count(*) AS raw, count(*) FILTER (length(trim(text)) < 20) AS rejected, count(*) FILTER (length(trim(text)) >= 20) AS accepted,
count(*) FILTER (NOT runtime_eligible) AS duplicates, count(*) FILTER (runtime_eligible) AS unique_rows, count(DISTINCT work) AS works FROM k""")
def _(t):
    return dedup.build_summary(marked(t))


@query("p1_length_gate", "SELECT source AS work, count(*) AS raw, count(*) FILTER (length(trim(text)) < 20) AS rejected, count(*) FILTER (length(trim(text)) >= 20) AS accepted FROM documents GROUP BY source")
def _(t):
    return dedup.length_gate(entries(t))


@query("a8_build_fingerprint", f"""WITH {MARKED}, z AS (SELECT greatest(1, ceil(count(*) / 5000.0))::BIGINT AS z FROM documents), l AS (SELECT ('0x' || substr(sha256(entry_id::VARCHAR), 1, 8))::BIGINT % (SELECT z FROM z) AS b, entry_id, concat_ws(':', entry_id::VARCHAR, normal_sha256, runtime_eligible::VARCHAR) AS line FROM k),
h AS (SELECT b, sha256(string_agg(line, chr(10) ORDER BY entry_id)) AS h, count(*) AS n FROM l GROUP BY b) SELECT sha256(string_agg(h, chr(10) ORDER BY b)) AS fingerprint, sum(n)::BIGINT AS n FROM h""")
def _(t):
    m = marked(t)
    return dedup.fingerprint(m, F.concat_ws(":", "entry_id", "normal_sha256", F.col("runtime_eligible").cast("string")))


@query("p2_record_keys", """WITH s AS (SELECT doc_id, source, lang, n_chars, sha256(concat_ws('|', source, lang, doc_id::VARCHAR, n_chars::VARCHAR, length(text)::VARCHAR, 'v1', sha256(text))) AS source_key FROM documents)
SELECT doc_id, source_key, 'Q-' || substr(source_key, 1, 24) AS entry_id, source || ' · ' || doc_id::VARCHAR AS locator FROM s""")
def _(t):
    key = F.sha2(F.concat_ws("|", "source", "lang", F.col("doc_id").cast("string"), F.col("n_chars").cast("string"), F.length("text").cast("string"), F.lit("v1"), tx.text_hash(F.col("text"))).cast("binary"), 256)
    return t.documents.select("doc_id", key.alias("source_key")).withColumn("entry_id", F.concat(F.lit("Q-"), F.substring("source_key", 1, 24))).join(
        t.documents.select("doc_id", F.concat(F.col("source"), F.lit(" · "), F.col("doc_id").cast("string")).alias("locator")), "doc_id"
    )


@query("p8_clip_at_sentence", r"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), h AS (SELECT doc_id, t, substr(t, 1, 260) AS head FROM c),
x AS (SELECT *, regexp_extract(head, '(?s)^(.*[。！？；.!?;])', 1) AS cut FROM h)
SELECT doc_id, CASE WHEN length(t) <= 260 THEN t ELSE rtrim(CASE WHEN length(cut) - 1 >= 130 THEN cut ELSE head END) || '…' END AS summary FROM x""")
def _(t):
    return t.documents.select("doc_id", tx.clip_at_sentence(F.col("text"), 260).alias("summary"))


@query("p10_length_bucket", "SELECT doc_id, ((length(text) >= 100)::INT + (length(text) >= 500)::INT + (length(text) >= 1000)::INT + (length(text) >= 3000)::INT) AS bucket5, ((length(text) >= 100)::INT + (length(text) >= 500)::INT + (length(text) >= 1000)::INT + (length(text) >= 3000)::INT + (length(text) >= 4000)::INT) AS bucket6 FROM documents")
def _(t):
    n = F.length("text")
    return t.documents.select("doc_id", tx.length_bucket(n).alias("bucket5"), tx.length_bucket(n, (100, 500, 1000, 3000, 4000)).alias("bucket6"))


@query("p11_length_routing", """WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents), s AS (SELECT doc_id, text, n, unnest(generate_series(0, greatest(n - 151, 0), 1350)) AS start FROM d)
SELECT doc_id, n > 3000 AS alone, start::INT AS start, length(substr(text, start + 1, 1500))::INT AS piece_chars, sha256(substr(text, start + 1, 1500)) AS piece_sha FROM s""")
def _(t):
    pieces = t.documents.select("doc_id", (F.length("text") > 3000).alias("alone"), F.explode(tx.chunks(F.col("text"))).alias("c"))
    return pieces.select("doc_id", "alone", "c.start", F.length("c.piece").alias("piece_chars"), tx.text_hash(F.col("c.piece")).alias("piece_sha"))


@query("f1_stable_hash", """SELECT doc_id, sha256(text) AS text_sha256, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS record_sha256 FROM documents""")
def _(t):
    return t.documents.select("doc_id", tx.text_hash(F.col("text")).alias("text_sha256"), tx.stable_hash(F.struct("doc_id", "lang", "source")).alias("record_sha256"))


@query("f2_comparison_text", r"SELECT doc_id, sha256(regexp_replace(text, '[\p{P}\p{Z}]', '', 'g')) AS comparison_sha256 FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.text_hash(tx.comparison_text(F.col("text"))).alias("comparison_sha256"))


@query("f3_compact_text", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS compacted FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.compact_text(F.col("text")).alias("compacted"))


#: A user's glyph table for the query below: long to plain letters of the tables' languages.
GLYPHS = {"é": "e", "è": "e", "ê": "e", "ç": "c", "ä": "a", "ö": "o", "ü": "u", "ñ": "n", "í": "i", "ó": "o"}


@query("f4_simplified", "SELECT doc_id, sha256(translate(text, 'éèêçäöüñíó', 'eeecaounio')) AS plain_sha256, true AS fixed_point FROM documents")
def _(t):
    once = tx.simplified(F.col("text"), GLYPHS)
    return t.documents.select("doc_id", tx.text_hash(once).alias("plain_sha256"), (tx.simplified(once, GLYPHS) == once).alias("fixed_point"))


_MARKS = "。！？；，、.,!?;"
_SQL_SINGLE = "t"
for _m in _MARKS:
    _SQL_SINGLE = f"regexp_replace({_SQL_SINGLE}, '[{_m}]+', '{_m}', 'g')"


@query("f5_clean_copy", rf"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '《+', '《', 'g'), '》+', '》', 'g') AS t FROM documents)
SELECT doc_id, sha256(regexp_replace({_SQL_SINGLE}, ' +([。！？；，、.,!?;])', '\1', 'g')) AS clean_sha256 FROM c""")
def _(t):
    return t.documents.select("doc_id", tx.text_hash(tx.clean_copy(F.col("text"))).alias("clean_sha256"))


@query("f6_clauses", r"""WITH c AS (SELECT conv_id, turn, unnest(string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), '[。！？!?；;，,.]+')) AS c FROM conversations)
SELECT conv_id, turn, count(DISTINCT trim(c)) AS n FROM c WHERE length(trim(c)) >= 3 GROUP BY conv_id, turn""")
def _(t):
    return t.conversations.select("conv_id", "turn", F.size(tx.clauses(F.col("text"))).cast("long").alias("n")).filter("n > 0")


#: A long digit run is private whatever it is; an id card may end in a letter, and neighbours share what stands between them.
SCRUBBED = r"""regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}', ' ', 'g'),
 '(^|\D)\d{17}[Xx](\D|$)', '\1 \2', 'g'), '(^|\D)\d{17}[Xx](\D|$)', '\1 \2', 'g'), '\d{6,}', ' ', 'g'), '\s+', ' ', 'g')), '^\s+', '')"""


@query("f7_scrub_identity", f"SELECT doc_id, {SCRUBBED} AS scrubbed FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.scrub_identity(F.col("text")).alias("scrubbed"))


#: Terms of a user's query, for the queries below.
TERMS = ["tion", "ment", "the", "keit", "ción", "lich"]


@query("f8_matched_terms", "SELECT doc_id, array_to_string(list_filter(['tion', 'ment', 'the', 'keit', 'ción', 'lich'], lambda x: contains(text, x))[1:4], ',') AS matched FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(tx.matched_terms(F.col("text"), F.array(*[F.lit(x) for x in TERMS])), ",").alias("matched"))


@query("f9_page_url", "SELECT page_id, url, 'https://example.org/wiki?title=' || replace(url_encode(url), '%20', '+') || '&oldid=' || page_id AS link, page_id AS revision FROM pages")
def _(t):
    link = F.concat(tx.page_url("https://example.org/wiki?title=", F.col("url")), F.lit("&oldid="), F.col("page_id").cast("string"))
    return t.pages.select("page_id", "url", link.alias("link")).withColumn("revision", tx.revision_of(F.col("link")))


@query("f10_timestamps", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'shape' WHEN ts > TIMESTAMP '2024-01-20 00:05:00' THEN 'future' END AS problem FROM events")
def _(t):
    good = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    value = F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "yyyy/MM/dd HH:mm")).otherwise(good)
    return t.events.select("event_id", tx.timestamp_problem(value, F.lit("2024-01-20 00:00:00").cast("timestamp")).alias("problem"))


@query("f11_bounded_text", "SELECT doc_id, length(trim(text)) BETWEEN 20 AND 4000 AS ok FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.bounded(F.col("text"), 20, 4000).alias("ok"))


@query("f12_json_object", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN props END AS object FROM events")
def _(t):
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("["), F.col("props"), F.lit("]"))).when(k == 1, F.col("props")).otherwise(F.concat(F.col("props"), F.lit("x")))
    return t.events.select("event_id", tx.json_object(raw).alias("object"))


@query("f13_generated_fields", "SELECT doc_id, path, value FROM (SELECT doc_id, unnest(['lang', 'source']) AS path, unnest([lang, source]) AS value FROM documents) WHERE value <> ''")
def _(t):
    return unpivot_fields(t.documents, "doc_id", ["lang", "source"])


def unpivot_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, path, value) for every non-empty text among the named, possibly nested fields."""
    pairs = F.array(*[F.struct(F.lit(f).alias("path"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(key, F.inline(pairs)).filter("value <> ''")


@query("f14_nonnegative_int", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN NULL ELSE user_id END AS n FROM events")
def _(t):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.lit("true")).when(k == 1, F.concat(F.lit("-"), F.col("event_id").cast("string"), F.lit("1"))).otherwise(F.col("user_id").cast("string"))
    return t.events.select("event_id", tx.nonnegative_int(raw).alias("n"))


@query("f15_context_window", r"""WITH p AS (SELECT doc_id, text, position('tion' IN text) - 1 AS s FROM documents WHERE contains(text, 'tion'))
SELECT doc_id, substr(trim(regexp_extract(substr(text, greatest(s - 38, 0) + 1, least(s, 38)), '([^。；！？.;!?\n\r]*)$', 1) || 'tion' || regexp_extract(substr(text, s + 5, 38), '^([^。；！？.;!?\n\r]*[。；！？.;!?]?)', 1), ' '), 1, 80) AS excerpt FROM p""")
def _(t):
    at = F.instr("text", "tion") - 1
    return t.documents.filter(F.contains("text", F.lit("tion"))).select("doc_id", tx.context_window(F.col("text"), at, at + 4).alias("excerpt"))


@query("p14_unknown_statement", r"""WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'no clear ' || event_type || ' trigger' WHEN 1 THEN ' Un known' WHEN 2 THEN event_type ELSE 'unknown ' || event_type END AS v FROM events)
SELECT event_id, regexp_matches(lower(regexp_replace(v, '\s+', '', 'g')), '^(?:unknown|unclear|none|n/a|未知|不明|无)$|^no(?:clear|explicit|evident).*trigger') AS is_unknown FROM v""")
def _(t):
    k, e = F.col("event_id") % 4, F.col("event_type")
    v = F.when(k == 0, F.concat(F.lit("no clear "), e, F.lit(" trigger"))).when(k == 1, F.lit(" Un known")).when(k == 2, e).otherwise(F.concat(F.lit("unknown "), e))
    return t.events.select("event_id", tx.is_unknown_statement(v).alias("is_unknown"))


@query("p15_specific_terms", r"""WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS w FROM benchmark), c AS (SELECT item_id, regexp_replace(w, '^[\s，。！？；：、,.!?;:()（）]+|[\s，。！？；：、,.!?;:()（）]+$|\s', '', 'g') AS t FROM w)
SELECT item_id, t, count(*) AS n FROM c WHERE length(t) BETWEEN 3 AND 16 AND length(regexp_replace(t, 'tion|the|and|in|on', '', 'g')) > 0 GROUP BY item_id, t""")
def _(t):
    words = t.benchmark.select("item_id", F.explode(F.split("text", " ")).alias("w"))
    return words.select("item_id", tx.specific_term(F.col("w"), ["the", "and", "in", "on", "tion"]).alias("t")).filter("t is not null").groupBy("item_id", "t").agg(F.count("*").alias("n"))
