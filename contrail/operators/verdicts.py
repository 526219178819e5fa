"""Judge-verdict parsing, faithfulness rates, arm comparison and judge-vs-human agreement.

Parsing is native column work: strip, keep the longest fenced chunk, drop a leading ``json``
tag, cut from the first ``{`` to the last ``}``, parse strictly: the cut text must be one JSON object
and nothing else. Rows that do not parse, or miss a dimension's ``present`` key, are kept with
``parse_ok = false`` and an ``error`` text instead of failing the job. A flag is raised by any value
of ``present`` but false, null, zero and empty texts, lists and objects (so ``1`` and ``"no"`` raise it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUND = 9
# FIXED VALUES: the four judged failure modes, in report order
DIMENSIONS = ["fabrication", "direction_error", "certainty_language", "probability_misrepresented"]

# FIXED VALUES: JSON texts that do not raise a flag; other spellings of zero are found by value
FALSY = ["false", "null", '""', "[]", "{}"]

_WS_CHARS = " \\t\\n\\r\\f\\u000B"


def with_json_text(df: DataFrame, raw: str = "raw", out: str = "_body") -> DataFrame:
    """Add the candidate JSON object text of a judge reply (null when no braces are found).

    Each step is its own column so every expensive expression is evaluated once per row. The
    outer whitespace trim and the fence split (an interpreted higher-order function) only run on
    replies that have fences: trimming never adds or removes a fence or a brace, so for the
    others the first ``{`` to the last ``}`` of the raw text is the same object text.
    """
    d = df.withColumn("_f", F.instr(F.col(raw), "```") > 0)
    d = d.withColumn("_s", F.when(F.col("_f"), F.expr(f"trim(BOTH '{_WS_CHARS}' FROM `{raw}`)")))
    longest = F.aggregate(F.split("_s", "```"), F.lit(""),
                          lambda acc, x: F.when(F.length(x) > F.length(acc), x).otherwise(acc))
    d = d.withColumn("_lg", F.when(F.col("_f"), longest))
    d = d.withColumn("_ld", F.expr(f"ltrim('{_WS_CHARS}', _lg)"))
    fenced = F.when(F.col("_ld").startswith("json"), F.expr("substring(_ld, 5)")).otherwise(F.col("_lg"))
    d = d.withColumn("_t", F.when(F.col("_f"), fenced).otherwise(F.col(raw)))
    # first '{' and last '}' (substring_index scans from the end without copying the text)
    d = d.withColumn("_a", F.instr(F.col("_t"), "{")).withColumn(
        "_b", F.length("_t") - F.length(F.substring_index(F.col("_t"), "}", -1)))
    length = F.greatest(F.col("_b") - F.col("_a") + 1, F.lit(0))
    d = d.withColumn(out, F.when((F.col("_a") > 0) & (F.col("_b") > 0), F.col("_t").substr(F.col("_a"), length)))
    return d.drop("_f", "_s", "_lg", "_ld", "_t", "_a", "_b")


def parse_verdicts(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds parse_ok, error, one boolean per dimension, evidence per dimension, faithful.

    The parsed JSON leaves through a one-element ``inline`` generator: a later filter on the
    flags (say ``faithful``) cannot be pushed below it and re-expand the JSON parse inside the
    filter, so each reply is parsed exactly once; the flags are cheap map lookups above it.
    """
    d = with_json_text(df, raw)
    # the body text passes through the generator too, so no predicate on the flags references
    # a column below it (a pushed-down conjunct would re-inline the whole extraction chain)
    # inside a list, whatever follows the first object makes the text invalid or a longer list
    d = d.withColumn("_l", F.try_parse_json(F.concat(F.lit("["), F.col("_body"), F.lit("]"))))
    one = F.col("_l").isNotNull() & F.try_variant_get("_l", "$[1]", "variant").isNull()
    d = d.select(*df.columns, F.inline(F.array(F.struct(
        F.col("_body").alias("_jb"), one.alias("_one"),
        *[F.to_json(F.try_variant_get("_l", f"$[0].{dim}.present", "variant")).alias(f"_p_{dim}") for dim in DIMENSIONS],
        *[F.try_variant_get("_l", f"$[0].{dim}.evidence", "string").alias(f"_e_{dim}") for dim in DIMENSIONS]))))
    all_dims = None
    for dim in DIMENSIONS:
        h = F.col(f"_p_{dim}").isNotNull()
        all_dims = h if all_dims is None else all_dims & h
    ok = F.col("_jb").isNotNull() & F.col("_one") & all_dims
    err = (F.when(F.col("_jb").isNull(), F.lit("no JSON object found"))
            .when(~F.col("_one"), F.lit("invalid JSON"))
            .when(~all_dims, F.lit("malformed verdict")))
    present = {dim: ~(F.col(f"_p_{dim}").isin(*FALSY) | F.coalesce(F.expr(f"try_cast(_p_{dim} as double)") == 0, F.lit(False)))
               for dim in DIMENSIONS}
    anyp = None
    for dim in DIMENSIONS:
        anyp = present[dim] if anyp is None else (anyp | present[dim])
    fields = [ok.alias("parse_ok"), F.when(~ok, err).alias("error")]
    for dim in DIMENSIONS:
        fields += [F.when(ok, present[dim]).alias(dim),
                   F.when(ok, F.col(f"_e_{dim}")).alias(f"{dim}_evidence")]
    fields.append(F.when(ok, ~anyp).alias("faithful"))
    return d.select(*df.columns, *fields)


def verdict_rates(v: DataFrame, group: list[str]) -> DataFrame:
    """Per group, over parsed verdicts: count, faithful share, share present per dimension."""
    p = v.where(F.col("parse_ok"))
    return p.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col("faithful").cast("double")), ROUND).alias("faithful_rate"),
        *[F.round(F.avg(F.col(d).cast("double")), ROUND).alias(f"rate_{d}") for d in DIMENSIONS])


def flagged_sample(v: DataFrame, id_col: str = "flight_id", evidence_chars: int = 130) -> DataFrame:
    """Unfaithful rows with their first hit dimension and its evidence cut to ``evidence_chars``."""
    hit = F.coalesce(*[F.when(F.col(d), F.lit(d)) for d in DIMENSIONS])
    ev = F.coalesce(*[F.when(F.col(d), F.col(f"{d}_evidence")) for d in DIMENSIONS])
    return (v.where(F.col("parse_ok") & ~F.col("faithful"))
             .select(id_col, hit.alias("hit"), F.substring(ev, 1, evidence_chars).alias("evidence")))


def arm_comparison(v: DataFrame, arm: str = "arm", base_arm: str = "naive", new_arm: str = "grounded") -> DataFrame:
    p = v.where(F.col("parse_ok"))
    r = lambda a: F.avg(F.when(F.col(arm) == a, F.col("faithful").cast("double")))
    return p.agg(F.round(r(new_arm), ROUND).alias(f"{new_arm}_rate"), F.round(r(base_arm), ROUND).alias(f"{base_arm}_rate"),
                 F.round((r(new_arm) - r(base_arm)) * 100, ROUND).alias("delta_pts"))


def judge_agreement(human: DataFrame, judge: DataFrame, id_col: str = "flight_id",
                    human_col: str = "human_faithful", judge_col: str = "faithful") -> DataFrame:
    """Confusion counts with *unfaithful* as the positive class, raw agreement, Cohen's kappa,
    precision and recall of the judge (zero division gives 0)."""
    j = human.select(id_col, human_col).join(judge.select(id_col, F.col(judge_col).alias("_j")), id_col)
    hu, ju = ~F.col(human_col), ~F.col("_j")
    a = j.agg(F.count(F.lit(1)).alias("n"),
              F.count_if(hu & ju).alias("tp"), F.count_if(~hu & ju).alias("fp"),
              F.count_if(hu & ~ju).alias("fn"), F.count_if(~hu & ~ju).alias("tn"))
    n = F.col("n").cast("double")
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    po = F.try_divide(tp + tn, n)
    pe = F.try_divide((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return a.select("n", "tp", "fp", "fn", "tn",
                    F.round(po, ROUND).alias("agreement"),
                    F.round(F.when(pe != 1, (po - pe) / (1 - pe)), ROUND).alias("kappa"),
                    F.round(F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), ROUND).alias("precision"),
                    F.round(F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0), ROUND).alias("recall"))


def judge_disagreements(human: DataFrame, judge: DataFrame, id_col: str = "flight_id",
                        human_col: str = "human_faithful", judge_col: str = "faithful") -> DataFrame:
    j = human.select(id_col, human_col).join(judge.select(id_col, F.col(judge_col).alias("judge_faithful")), id_col)
    return j.where(F.col(human_col) != F.col("judge_faithful"))
