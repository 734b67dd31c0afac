"""A review run as a whole: layers that must agree, and merged reviews that are the union of their stages.

Layers are the entries selected, their annotations, two directional stages and the merged
reviews. Whether each entry is in each layer exactly once is one aggregate over all
layers' ids. Whether the issues agree is another one, a signed difference of multisets:
an issue counts +1 in a stage and -1 in the raw response it was read from, and in a
merged review +1 against the -1 of the stages' union; what does not cancel out names the
layer at fault. No issue list is compared as a whole, so an entry with very many issues
is spread like any other.

Columns, beside entry_id: entries source_sha256; annotations status, candidate_sha256;
stages mode, status, issues, raw and `PROVENANCE`; merged status, verdict, issues and
`PROVENANCE`. Issues are arrays of `ISSUE` structs, in stages with the codes of their
direction, in merged reviews with unified ones.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("omission", "contradiction")
ISSUE = "struct<code: string, field: string, excerpt: string, hint: string>"
PROVENANCE = ("source_sha256", "candidate_sha256", "model", "prompt_version", "prompt_sha256", "schema_sha256")
FINAL = ("pass",)


def presence(entries: DataFrame, annotations: DataFrame, stages: DataFrame, merged: DataFrame) -> DataFrame:
    """(entry_id, code): layers in which a selected entry is missing or repeated, or one that is not selected is there."""
    layers = {"annotation": annotations, **{m: stages.filter(F.col("mode") == m) for m in MODES}, "merged": merged, "strange": stages.filter(~F.col("mode").isin(*MODES) | F.col("mode").isNull())}
    rows = reduce(DataFrame.unionByName, [df.select("entry_id", F.lit(k).alias("layer")) for k, df in {"entry": entries, **layers}.items()])
    by = rows.groupBy("entry_id").agg(*[F.count_if(F.col("layer") == k).alias(k) for k in ("entry", *layers)])
    here = F.col("entry") > 0
    codes = [F.when(F.col("entry") > 1, F.lit("entry:repeated")), F.when(F.col("strange") > 0, F.lit("stage:strange_mode"))]
    for k in layers:
        if k != "strange":
            n = F.col(k)
            codes.append(F.when(here & (n == 0), F.lit(f"{k}:missing")).when(here & (n > 1), F.lit(f"{k}:repeated")).when(~here & (n > 0), F.lit(f"{k}:orphan")))
    return by.select("entry_id", F.explode(F.array_compact(F.array(*codes))).alias("code"))


def _failed(df: DataFrame, layer: Column, checks: Mapping[str, Column]) -> DataFrame:
    """(entry_id, code) of rows that fail a check, or of which it cannot be told."""
    codes = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    return df.select("entry_id", F.explode(F.array_compact(F.array(*codes))).alias("what"), layer.alias("layer")).select("entry_id", F.concat_ws(":", "layer", "what").alias("code"))


def provenance(entries: DataFrame, annotations: DataFrame, stages: DataFrame, merged: DataFrame, wanted: Mapping[str, Mapping[str, str]], final: tuple[str, ...] = FINAL) -> DataFrame:
    """(entry_id, code): rows of a layer that are not final, not of the current text, candidate, model or prompt, or whose verdict is not what their issues say."""
    current = entries.join(annotations.select("entry_id", "candidate_sha256"), "entry_id", "left").select("entry_id", F.col("source_sha256").alias("now_source"), F.col("candidate_sha256").alias("now_candidate"))
    facts = {"source_sha256": F.col("source_sha256") == F.col("now_source"), "candidate_sha256": F.col("candidate_sha256") == F.col("now_candidate")}
    out = _failed(annotations, F.lit("annotation"), {"status": F.col("status") == "valid"})
    for m in MODES:
        own = {k: F.col(k) == v for k, v in wanted[m].items()}
        out = out.unionByName(_failed(stages.filter(F.col("mode") == m).join(current, "entry_id"), F.lit(m), {"status": F.col("status") == "valid"} | facts | own))
    verdict = F.when(F.size("issues") > 0, F.col("verdict").isin("revise", "uncertain")).otherwise(F.col("verdict") == "pass")
    own = {"status": F.col("status") == F.col("verdict"), "final": F.col("status").isin(*final), "verdict": verdict} | facts | {k: F.col(k) == v for k, v in wanted["merged"].items()}
    return out.unionByName(_failed(merged.join(current, "entry_id"), F.lit("merged"), own))


def issue_balance(stages: DataFrame, merged: DataFrame, codes: DataFrame) -> DataFrame:
    """(entry_id, code, n): issues that one layer has more (`added`) or less (`lost`) often than the layer it comes from.

    codes: (stage_code, code), a small table of the unified code of each stage's code; a
    code that is not in it is unknown. A stage is balanced against its raw response, a
    merged review against the distinct union of its stages.
    """
    parts = ["code", "field", "excerpt", "hint"]
    took = lambda df, column, layer: df.select("entry_id", layer.alias("layer"), F.inline(column)).select("entry_id", "layer", *parts)
    told = stages.filter(F.col("mode").isin(*MODES))
    rows = took(told, "issues", F.col("mode")).unionByName(took(told, "raw", F.concat(F.lit("raw_"), "mode")))
    rows = rows.join(F.broadcast(codes.select(F.col("stage_code").alias("code"), F.col("code").alias("unified"))), "code", "left").withColumn("own", F.col("code"))
    rows = rows.withColumn("code", F.coalesce("unified", F.concat(F.lit("?"), "code"))).drop("unified")
    rows = rows.unionByName(took(merged, "issues", F.lit("merged")).withColumn("own", F.lit(None).cast("string")))
    # first by the codes of a direction, then by unified ones: an issue that both directions tell counts once
    layers = [*MODES, *[f"raw_{m}" for m in MODES], "merged"]
    by = rows.groupBy("entry_id", *parts, "own").agg(*[F.count_if(F.col("layer") == k).alias(k) for k in layers])
    balance = lambda n: F.when(n > 0, F.lit("added")).when(n < 0, F.lit("lost"))
    stage = by.select("entry_id", F.inline(F.array(*[F.struct(F.lit(m).alias("layer"), (F.col(m) - F.col(f"raw_{m}")).alias("n")) for m in MODES])))
    union = by.groupBy("entry_id", *parts).agg(F.max(F.greatest(*MODES)).alias("told"), F.sum("merged").alias("merged"))
    union = union.select("entry_id", "code", (F.col("merged") - (F.col("told") > 0).cast("int")).alias("n"))
    unknown = union.filter(F.startswith("code", F.lit("?"))).select("entry_id", F.lit("stage:unknown_code").alias("code"), F.lit(1).cast("long").alias("n"))
    found = stage.withColumn("code", F.concat_ws(":", "layer", balance(F.col("n")))).filter("n <> 0").select("entry_id", "code", F.abs("n").alias("n"))
    found = found.unionByName(union.filter("n <> 0 and not startswith(code, '?')").select("entry_id", F.concat_ws(":", F.lit("merged"), balance(F.col("n"))).alias("code"), F.abs("n").alias("n"))).unionByName(unknown)
    return found.groupBy("entry_id", "code").agg(F.sum("n").alias("n"))


def review_run(entries: DataFrame, annotations: DataFrame, stages: DataFrame, merged: DataFrame, codes: DataFrame, wanted: Mapping[str, Mapping[str, str]], final: tuple[str, ...] = FINAL) -> DataFrame:
    """(entry_id, code, n) of all that keeps a run from being whole; nothing if it is."""
    one = F.lit(1).cast("long").alias("n")
    out = presence(entries, annotations, stages, merged).select("entry_id", "code", one)
    out = out.unionByName(provenance(entries, annotations, stages, merged, wanted, final).select("entry_id", "code", one))
    return out.unionByName(issue_balance(stages, merged, codes))


def run_counts(entries: DataFrame, annotations: DataFrame, stages: DataFrame, merged: DataFrame) -> DataFrame:
    """(layer, status, rows) over all layers."""
    one = lambda df, layer, status: df.select(layer.alias("layer"), status.alias("status"))
    rows = [one(entries, F.lit("entry"), F.lit("selected")), one(annotations, F.lit("annotation"), F.col("status")), one(stages, F.col("mode"), F.col("status")), one(merged, F.lit("merged"), F.col("status"))]
    return reduce(DataFrame.unionByName, rows).groupBy("layer", "status").agg(F.count("*").alias("rows"))
