"""The review-run validator over runs built from documents, with every check broken somewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.operators import review_run as rr
from quillmill.registry import query

WANTED = {m: {"model": "reader", "prompt_version": f"{m}-2", "prompt_sha256": f"{m}-p", "schema_sha256": "s"} for m in (*rr.MODES, "merged")}
CODES = [("missing_tone", "TONE"), ("wrong_tone", "TONE"), ("missing_place", "PLACE"), ("wrong_end", "END")]

_OTHER = "named_struct('code', {code}, 'field', 'tone', 'excerpt', 'new', 'hint', 'h')"
_DOUBLE = "concat({0}, slice({0}, 1, 1))"

#: What is spoilt (layer, column, SQL expression; `gone` and `twice` for whole rows) and what must be said, with how often.
FAULTS = [
    ("entry", "gone", None, "annotation:orphan=1 omission:orphan=1 contradiction:orphan=1 merged:orphan=1"),
    ("entry", "twice", None, "entry:repeated=1"),
    ("annotation", "gone", None, "annotation:missing=1 omission:candidate_sha256=1 contradiction:candidate_sha256=1 merged:candidate_sha256=1"),
    ("annotation", "status", "'stale'", "annotation:status=1"),
    ("annotation", "candidate_sha256", "'x'", "omission:candidate_sha256=1 contradiction:candidate_sha256=1 merged:candidate_sha256=1"),
    ("omission", "gone", None, "omission:missing=1 merged:added=1"),
    ("contradiction", "twice", None, "contradiction:repeated=1"),
    ("omission", "mode", "'other'", "omission:missing=1 stage:strange_mode=1 merged:added=1"),
    ("omission", "status", "'queued'", "omission:status=1"),
    ("contradiction", "source_sha256", "'x'", "contradiction:source_sha256=1"),
    ("contradiction", "candidate_sha256", "null", "contradiction:candidate_sha256=1"),
    ("omission", "model", "'x'", "omission:model=1"),
    ("omission", "prompt_version", "'x'", "omission:prompt_version=1"),
    ("contradiction", "prompt_sha256", "'x'", "contradiction:prompt_sha256=1"),
    ("contradiction", "schema_sha256", "'x'", "contradiction:schema_sha256=1"),
    ("merged", "gone", None, "merged:missing=1 merged:lost=3"),
    ("merged", "status", "'uncertain'", "merged:status=1"),
    ("merged", "verdict", "'pass'", "merged:status=1 merged:verdict=1"),
    ("merged", "source_sha256", "'x'", "merged:source_sha256=1"),
    ("merged", "model", "null", "merged:model=1"),
    ("merged", "prompt_version", "'x'", "merged:prompt_version=1"),
    ("merged", "prompt_sha256", "'x'", "merged:prompt_sha256=1"),
    ("merged", "schema_sha256", "'x'", "merged:schema_sha256=1"),
    # a stage is not what its raw response says
    ("omission", "issues", "slice(issues, 1, 1)", "omission:lost=1 merged:added=1"),
    ("omission", "raw", "slice(raw, 1, 1)", "omission:added=1"),
    ("contradiction", "issues", _DOUBLE.format("issues"), "contradiction:added=1"),
    ("contradiction", "raw", _DOUBLE.format("raw"), "contradiction:lost=1"),
    # the merged review is not the union of its stages
    ("merged", "issues", "slice(issues, 1, 2)", "merged:lost=1"),
    ("merged", "issues", _DOUBLE.format("issues"), "merged:added=1"),
    ("merged", "issues", f"concat(issues, array({_OTHER.format(code=chr(39) + 'TONE' + chr(39))}))", "merged:added=1"),
    ("merged", "issues", f"concat(slice(issues, 1, 2), array({_OTHER.format(code=chr(39) + 'END' + chr(39))}))", "merged:added=1 merged:lost=1"),
    ("merged", "issues", "slice(issues, 1, 0)", "merged:verdict=1 merged:lost=3"),
    # a code that no one has named
    ("omission", "issues", f"concat(issues, array({_OTHER.format(code=chr(39) + 'missing_all' + chr(39))}))", "omission:added=1 stage:unknown_code=1"),
    ("merged", "status", "'later'", "merged:status=1 merged:final=1"),
]
EVERY = 1 + len(FAULTS)


def run(documents: DataFrame) -> dict[str, DataFrame]:
    """A whole run: of three issues, one is told in both directions."""
    c = F.col
    sha = lambda x: F.sha2(F.concat(F.lit(x), c("entry_id").cast("string")).cast("binary"), 256)
    d = documents.select(c("doc_id").cast("long").alias("entry_id"), F.sha2(c("text").cast("binary"), 256).alias("source_sha256"), F.substring("text", 1, 8).alias("excerpt"))
    issue = lambda code, field: F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), c("excerpt"), F.lit(f"mend {field}").alias("hint"))
    told = {"omission": [("missing_tone", "tone"), ("missing_place", "place")], "contradiction": [("wrong_tone", "tone"), ("wrong_end", "end")]}
    facts = lambda m: ["source_sha256", sha("candidate").alias("candidate_sha256"), *[F.lit(v).alias(k) for k, v in WANTED[m].items()]]
    out = {"entry": d.select("entry_id", "source_sha256"), "annotation": d.select("entry_id", F.lit("valid").alias("status"), sha("candidate").alias("candidate_sha256"))}
    for m, issues in told.items():
        own = F.array(*[issue(*i) for i in issues])
        out[m] = d.select("entry_id", F.lit(m).alias("mode"), F.lit("valid").alias("status"), *facts(m), own.alias("issues"), own.alias("raw"))
    merged = F.array(issue("TONE", "tone"), issue("PLACE", "place"), issue("END", "end"))
    out["merged"] = d.select("entry_id", F.lit("revise").alias("status"), F.lit("revise").alias("verdict"), *facts("merged"), merged.alias("issues"))
    return out


def spoilt(own: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The run with fault k in the entries with entry_id % EVERY = k."""
    out = dict(own)
    for k, (layer, column, change, _) in enumerate(FAULTS, 1):
        here, df = F.col("entry_id") % EVERY == k, out[layer]
        if column == "gone":
            out[layer] = df.filter(~here)
        elif column == "twice":
            out[layer] = df.withColumn("_qm_k", F.explode(F.sequence(F.lit(1), F.when(here, 2).otherwise(1)))).drop("_qm_k")
        else:
            out[layer] = df.withColumn(column, F.when(here, F.expr(change).cast(df.schema[column].dataType)).otherwise(F.col(column)))
    return out


_PLANTED = ", ".join(f"({k}, '{x.split('=')[0]}', {x.split('=')[1]})" for k, f in enumerate(FAULTS, 1) for x in f[3].split() if "=" in x)


@query("v13_review_run", f"WITH p(k, code, n) AS (VALUES {_PLANTED}) SELECT doc_id AS entry_id, code, n::BIGINT AS n FROM documents JOIN p ON doc_id % {EVERY} = k")
def _(t):
    x = spoilt(run(t.documents))
    codes = t.spark.createDataFrame(CODES, "stage_code string, code string")
    return rr.review_run(x["entry"], x["annotation"], x["omission"].unionByName(x["contradiction"]), x["merged"], codes, WANTED, ("pass", "revise", "uncertain"))


@query("v13_run_counts", "SELECT unnest(['entry', 'annotation', 'omission', 'contradiction', 'contradiction', 'merged']) AS layer, unnest(['selected', 'valid', 'valid', 'valid', 'queued', 'revise']) AS status, unnest([n, n, n, n - q, q, n]) AS rows FROM (SELECT count(*) AS n, count(*) FILTER (doc_id % 7 = 3) AS q FROM documents)")
def _(t):
    x = run(t.documents)
    late = x["contradiction"].withColumn("status", F.when(F.col("entry_id") % 7 == 3, "queued").otherwise("valid"))
    return rr.run_counts(x["entry"], x["annotation"], x["omission"].unionByName(late), x["merged"])
