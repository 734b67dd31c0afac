"""Queries of rule tagging and of retrieval, with benchmark items as users' queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.operators import kept_index, rules, sampling
from quillmill.operators import retrieval as rt
from quillmill.registry import query
from quillmill.shared import shared_folder

#: A user's rule tables for the queries below.
FLAG_RULES = [("idiot|moron", ["insult", "anger"]), ("stupid|loser", ["insult"]), ("trash|scum", ["contempt"]), ("clown", ["mockery"])]
SIGNALS = [("waste", "worthless|trash", ["trash is"], ["contempt"]), ("fool", "stupid|clown", ["clown the"], ["mockery"])]
IMPLIED = {"insult": ["hostility"], "contempt": ["hostility", "disgust"]}
THEMES = [("motion", ["tion", "ment"]), ("being", ["heit", "keit"]), ("doing", ["ing", "ando"]), ("place", ["ll", "tz"]), ("time", ["th"])]

_FLAG_SQL = "list_distinct(flatten([CASE WHEN regexp_matches(text, 'idiot|moron') THEN ['insult', 'anger'] ELSE [] END, CASE WHEN regexp_matches(text, 'stupid|loser') THEN ['insult'] ELSE [] END, CASE WHEN regexp_matches(text, 'trash|scum') THEN ['contempt'] ELSE [] END, CASE WHEN regexp_matches(text, 'clown') THEN ['mockery'] ELSE [] END]))"
_FLAGS = f"f AS (SELECT doc_id, text, {_FLAG_SQL} AS flags FROM documents)"


def flagged(t):
    return t.documents.select("doc_id", "text", rules.required_flags(F.col("text"), FLAG_RULES).alias("flags"))


@query("r1_required_flags", f"WITH {_FLAGS} SELECT doc_id, array_to_string(list_sort(flags), ',') AS flags FROM f")
def _(t):
    return flagged(t).select("doc_id", F.array_join("flags", ",").alias("flags"))


@query("r2_masked_signals", f"WITH {_FLAGS} SELECT doc_id, CASE WHEN regexp_matches(replace(text, 'clown the', '         '), 'stupid|clown') AND NOT list_contains(flags, 'mockery') THEN 'fool' ELSE '' END AS fool, CASE WHEN regexp_matches(replace(text, 'trash is', '        '), 'worthless|trash') AND NOT list_contains(flags, 'contempt') THEN 'waste' ELSE '' END AS waste FROM f")
def _(t):
    s = flagged(t).withColumn("s", rules.uncovered_signals(F.col("text"), F.col("flags"), SIGNALS))
    return s.select("doc_id", *[F.when(F.array_contains("s", n), n).otherwise("").alias(n) for n in ("fool", "waste")])


@query("r3_implications", f"WITH {_FLAGS} SELECT doc_id, array_to_string(list_sort(list_distinct(flags || CASE WHEN list_contains(flags, 'insult') THEN ['hostility'] ELSE [] END || CASE WHEN list_contains(flags, 'contempt') THEN ['hostility', 'disgust'] ELSE [] END)), ',') AS flags FROM f")
def _(t):
    return flagged(t).select("doc_id", F.array_join(rules.implied(F.col("flags"), IMPLIED), ",").alias("flags"))


@query("r4_locked_flags", f"WITH {_FLAGS} SELECT doc_id, array_to_string(list_sort(list_filter(flags, lambda x: x <> 'anger' AND x <> 'insult' OR doc_id % 2 = 0)), ',') AS dropped FROM f")
def _(t):
    overlay = F.when(F.col("doc_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("anger"), F.lit("insult")))
    return flagged(t).select("doc_id", F.array_join(rules.missing_locked(F.col("flags"), overlay), ",").alias("dropped"))


@query("r5_flag_backstop", f"WITH {_FLAGS}, m AS (SELECT doc_id, text, unnest(list_filter(list_sort(flags), lambda x: x <> 'insult')) AS flag FROM f) SELECT doc_id, flag, position(regexp_extract(text, 'idiot|moron|trash|scum|clown') IN text) - 1 AS start FROM m")
def _(t):
    missing = flagged(t).select("doc_id", "text", F.explode(F.array_except("flags", F.array(F.lit("insult")))).alias("flag"))
    return missing.select("doc_id", "flag", (F.instr("text", F.regexp_extract("text", "idiot|moron|trash|scum|clown", 0)) - 1).cast("long").alias("start"))


@query("r6_signal_backstop", f"WITH {_FLAGS} SELECT doc_id, 'harm_unspecified' AS flag, 'low' AS confidence FROM f WHERE regexp_matches(replace(text, 'trash is', '        '), 'worthless|trash') AND NOT list_contains(flags, 'contempt')")
def _(t):
    s = flagged(t).withColumn("s", rules.uncovered_signals(F.col("text"), F.col("flags"), SIGNALS[:1])).filter(F.size("s") > 0)
    return s.select("doc_id", F.lit("harm_unspecified").alias("flag"), F.lit("low").alias("confidence"))


@query("r7_coverage_audit", f"WITH {_FLAGS}, i AS (SELECT doc_id, unnest([CASE WHEN list_contains(flags, 'insult') THEN 'flag_missing' END, CASE WHEN regexp_matches(replace(text, 'trash is', '        '), 'worthless|trash') AND NOT list_contains(flags, 'contempt') THEN 'signal_uncovered' END, CASE WHEN list_contains(flags, 'contempt') THEN 'cross_label_missing' END]) AS code FROM f) SELECT code, count(*) AS n FROM i WHERE code IS NOT NULL GROUP BY code")
def _(t):
    from quillmill.operators import curation

    f = flagged(t).withColumn("kept", F.array_remove("flags", "insult"))
    r = {
        "flag_missing": F.size(rules.missing_locked(F.col("flags"), F.col("kept"))) == 0,
        "signal_uncovered": F.size(rules.uncovered_signals(F.col("text"), F.col("kept"), SIGNALS[:1])) == 0,
        "cross_label_missing": F.size(F.array_except(rules.implied(F.col("kept"), {"contempt": IMPLIED["contempt"]}), F.col("kept"))) == 0,
    }
    return curation.issues(f, "doc_id", r).groupBy("code").agg(F.count("*").alias("n"))


@query("r8_routing", r"WITH n AS (SELECT conv_id, turn, regexp_replace(text, '(?i)not (?:the|de)\b', ' ', 'g') AS t FROM conversations), c AS (SELECT conv_id, turn, t, regexp_matches(t, '(?i)\b(?:the|der) [a-z]+ion') AS a, regexp_matches(t, '(?i)\ble [a-z]+ment') AS b FROM n) SELECT conv_id, turn, a OR b AS blocked, array_to_string(list_filter([CASE WHEN a THEN 'harm_self' END, CASE WHEN b THEN 'harm_other' END, CASE WHEN (a OR b) AND regexp_matches(t, '(?i)now|est') THEN 'immediate_danger' END], lambda x: x IS NOT NULL), ',') AS categories FROM c")
def _(t):
    r = rules.route(F.col("text"), [r"(?i)not (?:the|de)\b"], [("harm_self", r"(?i)\b(?:the|der) [a-z]+ion"), ("harm_other", r"(?i)\ble [a-z]+ment")], "(?i)now|est")
    return t.conversations.select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", "r.blocked", F.array_join("r.categories", ",").alias("categories"))


_THEME_CASE = ", ".join(f"CASE WHEN regexp_matches(text, '{'|'.join(terms)}') THEN '{n}' END" for n, terms in THEMES)


@query("r9_themes", f"WITH h AS (SELECT doc_id, list_filter([{_THEME_CASE}], lambda x: x IS NOT NULL) AS l FROM documents) SELECT doc_id, CASE WHEN len(l) > 0 THEN array_to_string(l[1:4], ',') ELSE 'plain' END AS themes FROM h")
def _(t):
    return t.documents.select("doc_id", F.array_join(rules.themes(F.col("text"), THEMES, "plain"), ",").alias("themes"))


TERMS = [("motion", 0, "tion", True), ("motion", 0, "mention", False), ("being", 1, "heit", False), ("doing", 2, "ing", True), ("doing", 2, "hering", False), ("place", 3, "tz", False)]
_TERM_SQL = ", ".join(f"('{a}', {b}, '{c}', {str(d).lower()})" for a, b, c, d in TERMS)


def term_table(t):
    return t.spark.createDataFrame(TERMS, "theme string, place int, term string, generic boolean")


@query("r10_user_theme", f"""WITH m AS (SELECT * FROM (VALUES {_TERM_SQL}) v(theme, place, term, generic)), h AS (SELECT item_id, theme, place, sum(CASE WHEN generic THEN 1 ELSE 3 END) AS weight, first(term ORDER BY generic, length(term) DESC, term DESC) AS evidence FROM benchmark JOIN m ON contains(text, term) GROUP BY ALL)
SELECT item_id, theme, weight, evidence FROM h QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, place) = 1""")
def _(t):
    return rules.theme_of(t.benchmark, "item_id", "text", term_table(t))


@query("j6_lexicon_join", f"WITH m AS (SELECT * FROM (VALUES {_TERM_SQL}) v(theme, place, term, generic)) SELECT term, count(*) AS n FROM documents JOIN m ON contains(text, term) GROUP BY term")
def _(t):
    lexicon = term_table(t)
    return t.documents.select("doc_id", "text").join(F.broadcast(lexicon), F.contains("text", F.col("term"))).groupBy("term").agg(F.count("*").alias("n"))


ALIASES = [("tion", 0, "mention", 1), ("tion", 0, "ration", 2), ("tion", 0, "nation", 3), ("the", 1, "there", 1), ("ing", 2, "hering", 1), ("ing", 2, "there", 2)]
_ALIAS_SQL = ", ".join(f"('{a}', {b}, '{c}', {d})" for a, b, c, d in ALIASES)


@query("j7_query_expansion", f"""WITH m AS (SELECT * FROM (VALUES {_ALIAS_SQL}) v(name, place, alias, nth)), h AS (SELECT item_id, alias, min(place * 10 + nth) AS at_ FROM benchmark JOIN m ON contains(text, name) WHERE nth <= 2 GROUP BY ALL)
SELECT item_id, alias AS term, row_number() OVER (PARTITION BY item_id ORDER BY at_, alias)::INT AS place FROM h""")
def _(t):
    return rt.expand_terms(t.benchmark, "item_id", "text", t.spark.createDataFrame(ALIASES, "name string, place int, alias string, nth int"))


@query("w10_first_distinct", "WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS k FROM benchmark), f AS (SELECT item_id, w, min(k) AS k FROM w GROUP BY ALL) SELECT item_id, string_agg(w, ' ' ORDER BY k) AS terms FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY k) <= 8) GROUP BY item_id")
def _(t):
    return t.benchmark.select("item_id", F.array_join(F.slice(F.array_distinct(F.split("text", " ")), 1, 8), " ").alias("terms"))


_GRAMS = """v AS (SELECT doc_id, unnest(['title', 'text', 'source', 'lang']) AS field, unnest([lower(string_split(text, chr(10))[1]), lower(text), lower(source), lower(lang)]) AS v FROM documents),
g AS (SELECT doc_id, field, unnest(list_transform(range(1, greatest(length(v) - 1, 1)), lambda i: substr(v, i, 3))) AS gram FROM v)"""


@query("q1_gram_index", f"WITH {_GRAMS} SELECT doc_id, field, gram, count(*) AS tf FROM g GROUP BY ALL")
def _(t):
    return rt.build_index(titled(t), "doc_id", ["title", "text", "source", "lang"])


#: Phrases of each query: its third and fourth word together, and its sixth word.
_PHRASES = "p AS (SELECT item_id, unnest([string_split(text, ' ')[3] || ' ' || string_split(text, ' ')[4], string_split(text, ' ')[6]]) AS term FROM benchmark), ph AS (SELECT DISTINCT item_id, term FROM p WHERE length(term) >= 3)"
#: Fields of a document and what a phrase found there weighs; the id is not searched.
WEIGHTS = {"doc": 0.0, "title": 8.0, "text": 1.0, "source": 2.0, "lang": 2.0}
_MATCH = _PHRASES + """, v AS (SELECT doc_id AS doc, unnest(['title', 'text', 'source', 'lang']) AS field, unnest([lower(string_split(text, chr(10))[1]), lower(text), lower(source), lower(lang)]) AS v FROM documents), m AS (SELECT item_id, term, doc, field,
(length(v) - length(replace(v, lower(term), ''))) // length(term) AS tf, length(v) AS len FROM ph JOIN v ON contains(v, lower(term)))"""
_BM25 = _MATCH + """, a AS (SELECT field, avg(length(v)) AS mean FROM v GROUP BY field), w AS (SELECT item_id, term, doc, sum(CASE field WHEN 'title' THEN 8 WHEN 'text' THEN 1 ELSE 2 END * tf / (1 - 0.75 + 0.75 * len / mean)) AS tf, (SELECT count(*) FROM documents) AS n FROM m JOIN a USING (field) GROUP BY item_id, term, doc), df AS (SELECT term, count(DISTINCT doc) AS df FROM w GROUP BY term),
s AS (SELECT item_id, doc, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2)), 6) AS score FROM w JOIN df USING (term) GROUP BY ALL)"""


def titled(t):
    """Documents with their first line as title."""
    return t.documents.withColumn("title", F.split("text", "\n")[0])


def phrases(t):
    w = F.split("text", " ")
    both = F.array(F.concat_ws(" ", w[2], w[3]), w[5])
    return t.benchmark.select("item_id", F.explode(both).alias("term")).filter(F.length("term") >= 3).distinct()


@query("q2_phrase_recall", f"WITH {_MATCH} SELECT item_id, term, doc, field, tf, len AS length FROM m")
def _(t):
    return rt.phrase_matches(titled(t), "doc_id", ["title", "text", "source", "lang"], phrases(t), "item_id")


def scores(t):
    return rt.bm25(titled(t), "doc_id", WEIGHTS, phrases(t), "item_id").withColumn("score", F.round("score", 6))


@query("q3_bm25", f"WITH {_BM25} SELECT item_id, doc, score FROM s")
def _(t):
    return scores(t)


def recalled(t, k=24):
    return rt.top_k(scores(t), "item_id", k, [F.desc("score"), F.col("doc")])


@query("k1_top_recall", f"WITH {_BM25} SELECT item_id, doc, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc)::INT AS rank FROM s QUALIFY rank <= 24")
def _(t):
    return recalled(t)


#: Phrases of three characters or more have a gram; the queries have no shorter ones.
@query("k1_index_recall", f"WITH {_BM25} SELECT item_id, doc, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc)::INT AS rank FROM s QUALIFY rank <= 24")
def _(t):
    # an index of most documents, a segment for the others, both merged
    path, docs, fields = shared_folder(t.spark, "index"), titled(t), [f for f, w in WEIGHTS.items() if w > 0]
    kept_index.create(docs.filter("doc_id % 5 <> 0"), "doc_id", fields, path)
    kept_index.add(docs.filter("doc_id % 5 = 0"), "doc_id", fields, path)
    kept_index.merge(t.spark, path)
    found = kept_index.phrase_matches(kept_index.postings(t.spark, path), docs, "doc_id", fields, phrases(t), "item_id")
    scored = rt.bm25(docs, "doc_id", WEIGHTS, phrases(t), "item_id", matches=found, size=kept_index.sizes(t.spark, path)).withColumn("score", F.round("score", 6))
    return rt.top_k(scored, "item_id", 24, [F.desc("score"), F.col("doc")])


@query("j5_fetch_rows", f"WITH {_BM25}, r AS (SELECT item_id, doc, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc)::INT AS rank FROM s QUALIFY rank <= 3) SELECT item_id, doc, rank, source, sha256(text) AS text_sha256 FROM r JOIN documents ON doc_id = doc")
def _(t):
    top = recalled(t, 3).drop("score")
    return rt.fetch_rows(top, t.documents, "doc_id", ["source", "text"]).select("item_id", "doc", "rank", "source", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("q4_fill_shortfall", f"""WITH {_BM25}, r AS (SELECT item_id, doc, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc)::INT AS rank FROM s QUALIFY rank <= 6),
i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents), q AS (SELECT item_id, ('0x' || substr(sha256('s2|' || text), 1, 15))::BIGINT % (SELECT count(*) FROM documents) AS off FROM benchmark),
c AS (SELECT item_id, doc_id AS doc, place FROM q, (SELECT unnest(range(0, 12)) AS place) JOIN i ON i.idx = (off + place) % i.n),
b AS (SELECT item_id, doc, 0 AS late, rank AS o FROM r UNION ALL SELECT item_id, doc, 1, place FROM c WHERE NOT EXISTS (FROM r WHERE r.item_id = c.item_id AND r.doc = c.doc))
SELECT item_id, doc, row_number() OVER (PARTITION BY item_id ORDER BY late, o, doc)::INT AS place, CASE late WHEN 0 THEN 'full_text' ELSE 'stable_sample' END AS mode FROM b QUALIFY place <= 6""")
def _(t):
    sampled = sampling.circular_sample(t.documents, t.benchmark, "doc_id", 12, "s2", "item_id", "text").withColumnRenamed("doc_id", "doc")
    return rt.fill_shortfall(recalled(t, 6), sampled, "item_id", 6)


@query("q13_search_probe", f"WITH {_MATCH} SELECT item_id, count(*) > 0 AS found FROM m WHERE field = 'text' GROUP BY item_id")
def _(t):
    hits = rt.phrase_matches(t.documents, "doc_id", ["text"], phrases(t), "item_id")
    return hits.groupBy("item_id").agg((F.count("*") > 0).alias("found"))


@query("q11_pool_membership", "SELECT lang, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS eligible FROM documents GROUP BY lang")
def _(t):
    good = t.labels.filter("quality = 1").select("doc_id").distinct().withColumn("g", F.lit(1))
    return t.documents.join(good, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count("g").alias("eligible"))


FACETS = [("motion", ["tion", "ment", "ing"], ["tion", "tionst"]), ("being", ["heit", "ere"], ["ther", "ere"])]
_PAIRS = _BM25 + """, r AS (SELECT item_id, doc, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc)::INT AS rank FROM s QUALIFY rank <= 24),
x AS (SELECT r.item_id, doc, source AS family, doc % 2 = 0 AS curated, b.text AS q, d.text AS story, (SELECT count(*) FROM ph WHERE ph.item_id = r.item_id AND contains(lower(d.text), lower(term))) AS matched FROM r JOIN benchmark b ON b.item_id = r.item_id JOIN documents d ON d.doc_id = doc),
y AS (SELECT *, (CASE WHEN (contains(q, 'tion')::INT + contains(q, 'ment')::INT + contains(q, 'ing')::INT) > 0 AND regexp_matches(story, 'tion|tionst') THEN 4 + least(contains(q, 'tion')::INT + contains(q, 'ment')::INT + contains(q, 'ing')::INT - 1, 2) ELSE 0 END
 + CASE WHEN (contains(q, 'heit')::INT + contains(q, 'ere')::INT) > 0 AND regexp_matches(story, 'ther|ere') THEN 4 + least(contains(q, 'heit')::INT + contains(q, 'ere')::INT - 1, 2) ELSE 0 END
 + CASE WHEN family = 'src3' THEN 3 ELSE 0 END + 2 * (contains(q, 'tz') AND contains(story, 'tz'))::INT + least(6, matched * 3))::INT AS relevance FROM x)"""


def relevant(t):
    p = phrases(t)
    top = recalled(t).drop("score", "rank")
    text = rt.fetch_rows(top, t.documents, "doc_id", ["source", "text"]).withColumnsRenamed({"text": "story", "source": "family"})
    m = text.join(p, "item_id").groupBy("item_id", "doc").agg(F.count_if(F.contains(F.lower("story"), F.lower("term"))).alias("matched"))
    x = text.join(m, ["item_id", "doc"]).join(t.benchmark.withColumnRenamed("text", "q"), "item_id").withColumn("curated", F.col("doc") % 2 == 0)
    direct = (F.contains("q", F.lit("tz")) & F.contains("story", F.lit("tz"))).cast("int")
    score = rt.facet_score(x, "q", "story", FACETS, F.col("family") == "src3", direct, F.col("matched"), F.col("curated"), F.lit(False))
    return x.withColumn("relevance", score.cast("int"))


@query("q6_facet_relevance", f"WITH {_PAIRS} SELECT item_id, doc, matched, relevance FROM y")
def _(t):
    return relevant(t).select("item_id", "doc", "matched", "relevance")


@query("k2_ranking", f"WITH {_PAIRS} SELECT item_id, doc, row_number() OVER (PARTITION BY item_id ORDER BY relevance DESC, family, doc)::INT AS rank FROM y QUALIFY rank <= 10")
def _(t):
    return rt.top_k(relevant(t).select("item_id", "doc", "family", "relevance"), "item_id", 10, [F.desc("relevance"), F.col("family"), F.col("doc")]).select("item_id", "doc", "rank")


@query("k3_rerank_shortlist", f"WITH {_PAIRS}, z AS (SELECT *, row_number() OVER (PARTITION BY item_id, curated ORDER BY relevance DESC, family, doc) AS tp FROM y QUALIFY tp <= CASE WHEN curated THEN 6 ELSE 2 END) SELECT item_id, doc, row_number() OVER (PARTITION BY item_id ORDER BY relevance DESC, family, doc)::INT AS place FROM z QUALIFY place <= 8")
def _(t):
    x = relevant(t).withColumn("tier", F.when(F.col("curated"), "curated").otherwise("recalled"))
    return rt.rerank_shortlist(x, "item_id", "tier", {"curated": 6, "recalled": 2}, [F.desc("relevance"), F.col("family"), F.col("doc")]).select("item_id", "doc", "place")


#: A model's answers as a table: a score from the ids; one in nine queries answers a candidate twice.
_MODEL = "((doc * 7 + item_id) % 100) / 100.0"


def model(x):
    s = ((F.col("doc") * 7 + F.col("item_id")) % 100) / 100.0
    a = x.select("item_id", "doc", s.alias("model"))
    return a.union(a.filter("item_id % 9 = 0"))


@query("q8_rerank_validation", f"WITH {_PAIRS} SELECT item_id, doc, CASE WHEN item_id % 9 <> 0 THEN {_MODEL} END AS model FROM y")
def _(t):
    x = relevant(t).select("item_id", "doc", "relevance")
    return rt.valid_rerank(model(x), x, "item_id").select("item_id", "doc", "model")


@query("j15_rerank_join", f"WITH {_PAIRS} SELECT item_id, doc, CASE WHEN doc % 3 = 0 THEN -1.0 ELSE {_MODEL} END AS model FROM y")
def _(t):
    x = relevant(t).select("item_id", "doc")
    answered = model(x).distinct().filter("doc % 3 <> 0")
    return x.join(answered, ["item_id", "doc"], "left").select("item_id", "doc", F.coalesce("model", F.lit(-1.0)).alias("model"))


_CONF = f"z AS (SELECT *, CASE WHEN item_id % 9 <> 0 THEN {_MODEL} END AS model, regexp_matches(q, 'tion|ment|ing|heit|ere') AS specific FROM y), c AS (SELECT * FROM z WHERE coalesce(model >= 0.55, true) AND CASE WHEN curated THEN relevance >= 3 OR coalesce(model >= 0.72, false) OR (NOT specific AND relevance >= 1) ELSE matched > 0 AND relevance >= 3 END)"


def confident(t):
    x = relevant(t)
    x = rt.valid_rerank(model(x), x, "item_id")
    specific = F.rlike("q", F.lit("tion|ment|ing|heit|ere"))
    return x.filter(rt.confident(F.col("relevance"), F.col("model"), F.col("curated"), F.col("matched"), specific))


@query("q7_confidence_gate", f"WITH {_PAIRS}, {_CONF} SELECT item_id, doc FROM c")
def _(t):
    return confident(t).select("item_id", "doc")


@query("w7_best_of_family", f"WITH {_PAIRS} SELECT item_id, family, doc FROM y QUALIFY row_number() OVER (PARTITION BY item_id, family ORDER BY relevance DESC, doc) = 1")
def _(t):
    return rt.best_of_family(relevant(t), "item_id", "family", [F.desc("relevance"), F.col("doc")]).select("item_id", "family", "doc")


@query("q9_offers", f"""WITH {_PAIRS}, {_CONF}, f AS (SELECT * FROM c WHERE family <> 'src1' QUALIFY row_number() OVER (PARTITION BY item_id, family ORDER BY relevance DESC, doc) = 1)
SELECT item_id, family, doc, row_number() OVER (PARTITION BY item_id ORDER BY relevance DESC, doc)::INT AS place, CASE WHEN count(*) OVER (PARTITION BY item_id) >= 3 THEN 'matched' ELSE 'partial' END AS status, count(*) OVER (PARTITION BY item_id) <= 3 AS exhausted FROM f QUALIFY place <= 3""")
def _(t):
    seen = t.benchmark.select("item_id", F.lit("src1").alias("family"))
    out = rt.offers(confident(t), seen, "item_id", "family", 5, [F.desc("relevance"), F.col("doc")])
    return out.select("item_id", "family", "doc", "place", "status", "exhausted")


@query("k4_bounded_offers", "SELECT item_id, least(greatest(length(text) // 40, 2), 3)::INT AS offers, least(greatest(length(text), 2), 60)::INT AS pool FROM benchmark")
def _(t):
    bound = lambda c, low, high: F.least(F.greatest(c.cast("int"), F.lit(low)), F.lit(high))
    n = F.length("text")
    return t.benchmark.select("item_id", bound(F.floor(n / 40), 2, 3).alias("offers"), bound(n, 2, 60).alias("pool"))


@query("q5_query_plan", f"WITH m AS (SELECT * FROM (VALUES {_TERM_SQL}) v(theme, place, term, generic)) SELECT item_id, array_to_string(list_sort(list(term))[1:8], ',') AS terms FROM benchmark JOIN m ON contains(text, term) GROUP BY item_id")
def _(t):
    lexicon = term_table(t)
    hits = t.benchmark.join(F.broadcast(lexicon), F.contains("text", F.col("term")))
    return hits.groupBy("item_id").agg(F.array_join(F.slice(F.sort_array(F.collect_set("term")), 1, 8), ",").alias("terms"))


@query("q10_reason", r"""WITH c AS (SELECT item_id, trim(c) AS c FROM (SELECT item_id, unnest(string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), '[。！？!?；;，,.]+')) AS c FROM benchmark) WHERE length(trim(c)) >= 3)
SELECT item_id, first(c ORDER BY (contains(c, 'tion')::INT + contains(c, 'ing')::INT) DESC, least(length(c), 48) DESC, c DESC) AS clause FROM c GROUP BY item_id""")
def _(t):
    from quillmill.functions import text as tx

    c = t.benchmark.select("item_id", F.explode(tx.clauses(F.col("text"))).alias("c"))
    worth = F.struct(sum((F.contains("c", F.lit(s)).cast("int") for s in ("tion", "ing")), F.lit(0)).alias("hits"), F.least(F.length("c"), F.lit(48)).alias("n"), "c")
    return c.groupBy("item_id").agg(F.max(worth)["c"].alias("clause"))


@query("u1_candidate_union", f"WITH {_BM25}, r AS (SELECT item_id, doc, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc)::INT AS rank FROM s QUALIFY rank <= 4) SELECT item_id, doc, 'recalled' AS tier FROM r UNION ALL SELECT item_id, doc, 'curated' FROM benchmark JOIN (SELECT source, min(doc_id) AS doc FROM documents GROUP BY source) ON source = 'src' || (item_id % 20)")
def _(t):
    # the curated row of the family that a query names
    first = t.documents.groupBy("source").agg(F.min("doc_id").alias("doc"))
    named = t.benchmark.select("item_id", F.concat(F.lit("src"), F.col("item_id") % 20).alias("source"))
    curated = named.join(first, "source").select("item_id", "doc", F.lit("curated").alias("tier"))
    return recalled(t, 4).select("item_id", "doc", F.lit("recalled").alias("tier")).unionByName(curated, allowMissingColumns=True)


_SUMMARY = "u AS (SELECT text, min(source) AS source FROM documents WHERE length(text) >= 20 GROUP BY text), s AS (SELECT (SELECT count(*) FROM documents) AS raw, (SELECT count(*) FROM documents WHERE length(text) < 20) AS rejected, (SELECT count(*) FROM u) AS unique_rows, (SELECT count(*) FROM u WHERE length(text) > 100) AS full_rows)"


@query("q14_summary_gate", f"WITH {_SUMMARY}, c AS (SELECT 'as_counted' AS kind, * FROM s UNION ALL SELECT 'off_by_one', raw, rejected, unique_rows + 1, full_rows FROM s UNION ALL SELECT 'too_full', raw, rejected, unique_rows, unique_rows + 1 FROM s) SELECT * FROM c WHERE kind = 'as_counted'")
def _(t):
    n = F.length("text")
    unique = t.documents.filter(n >= 20).groupBy("text").agg(F.min("source").alias("source"))
    s = t.documents.agg(F.count("*").alias("raw"), F.count_if(n < 20).alias("rejected")).join(unique.agg(F.count("*").alias("unique_rows"), F.count_if(n > 100).alias("full_rows")))  # one row each
    wrong = {"as_counted": ("unique_rows", "full_rows"), "off_by_one": ("unique_rows + 1", "full_rows"), "too_full": ("unique_rows", "unique_rows + 1")}
    told = [s.select(F.lit(k).alias("kind"), "raw", "rejected", F.expr(u).alias("unique_rows"), F.expr(f).alias("full_rows")) for k, (u, f) in wrong.items()]
    return rt.summary_gate(told[0].union(told[1]).union(told[2]), unique.groupBy("source").agg(F.count("*").alias("n")))


@query("q12_dense_fusion", """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT q.vec_id AS query, v.vec_id, list_cosine_similarity(v.e, q.e) AS score FROM n v, n q WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT query, vec_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM p QUALIFY rank <= 10),
l AS (SELECT q.vec_id AS query, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY v.vec_id) AS rank FROM embeddings v JOIN embeddings q ON v.label = q.label AND q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id QUALIFY rank <= 10)
SELECT query, vec_id, round(sum(1.0 / (60 + rank)), 6) AS fused FROM (FROM r UNION ALL FROM l) GROUP BY ALL""")
def _(t):
    e = t.embeddings
    chosen = e.filter("vec_id % 20 = 0")
    dense = rt.cosine_top_k(e, chosen, "vec_id", "vec_id", "embedding", 10)
    # the first 11 of a label hold the first 10 besides any one of them
    head = rt.top_k(e.select("vec_id", "label"), "label", 11, [F.col("vec_id")]).drop("rank")
    same = chosen.select(F.col("vec_id").alias("query"), "label").join(head, "label").filter("query <> vec_id")
    literal = rt.top_k(same, "query", 10, [F.col("vec_id")])
    return rt.fuse_ranks([dense, literal], "query", "vec_id").select("query", "vec_id", F.round("fused", 6).alias("fused"))
