"""Scorecards, integrity checks and comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import text

COUNTERS = (
    "pages", "units", "correct", "neighbours", "conflicts", "missing", "solid", "crops", "prelabelFallback", "baselineBlocks",
    "emptySvgs", "svgBytes",
)
FALLBACK_CONFIDENCE = 0.65
UNCERTAIN_CONFIDENCE = 0.75


def round3(c: Column) -> Column:
    return F.floor(c * 1000 + 0.5) / 1000


def rate(part: Column, total: Column) -> Column:
    """A share to three places; 0 of nothing."""
    return F.when(total == 0, F.lit(0.0)).otherwise(round3(part / total))


def paper_scores(pages: DataFrame, by: Sequence[str] = ("id", "field", "sourceType")) -> DataFrame:
    """Sums of the counters by paper, Jaccard weighted by units."""
    own = [c for c in COUNTERS if c in pages.columns]
    return pages.groupBy(*by).agg(*(F.sum(c).alias(c) for c in own), F.sum(F.col("jaccard") * F.col("units")).alias("jaccardSum"))


def grouped_scores(papers: DataFrame, keys: Sequence[str] = ("field", "sourceType")) -> DataFrame:
    """The same rows grouped by each key by itself, in one pass; ``grouped_by`` names the key."""
    own = [c for c in (*COUNTERS, "jaccardSum") if c in papers.columns]
    out = papers.groupingSets([[F.col(k)] for k in keys], *(F.col(k) for k in keys)).agg(
        *(F.sum(c).alias(c) for c in own), *(F.grouping(k).alias(f"g_{k}") for k in keys)
    )
    label = reduce(lambda a, k: F.when(F.col(f"g_{k}") == 0, F.lit(k)).otherwise(a), keys, F.lit(None))
    value = F.coalesce(*(F.when(F.col(f"g_{k}") == 0, F.col(k)) for k in keys))
    out = out.select(label.alias("grouped_by"), value.alias("value"), *own)
    if {"correct", "units"} <= set(own):
        out = out.withColumn("exact", rate(F.col("correct"), F.col("units")))
    if {"jaccardSum", "units"} <= set(own):
        out = out.withColumn("meanJaccard", rate(F.col("jaccardSum"), F.col("units")))
    if {"prelabelFallback", "units"} <= set(own):
        out = out.withColumn("fallback", rate(F.col("prelabelFallback"), F.col("units")))
    return out


def composition(units: DataFrame) -> DataFrame:
    """Counts by field, source, type and in all."""
    kind = F.concat(F.when(F.col("type") == "display", "display").otherwise("inline"), F.when(F.coalesce("equationNumber", F.lit(False)), "+eq").otherwise(""))
    own = units.select("field", "sourceType", kind.alias("kind"))
    out = own.groupingSets([[F.col("field")], [F.col("sourceType")], [F.col("kind")], []], F.col("field"), F.col("sourceType"), F.col("kind")).agg(
        F.count("*").alias("n"), F.grouping_id().alias("g")
    )
    name = F.when(F.col("g") == 3, "field").when(F.col("g") == 5, "sourceType").when(F.col("g") == 6, "type").otherwise("total")
    return out.select(name.alias("grouped_by"), F.coalesce("field", "sourceType", "kind").alias("value"), "n")


def fallback_rate(units: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    low = F.coalesce("fallback", F.lit(False)) | F.coalesce(F.col("confidence") < FALLBACK_CONFIDENCE, F.lit(False))
    for c in ("empty", "degenerate"):
        low = low | F.coalesce(c, F.lit(False)) if c in units.columns else low
    own = units.groupBy(*by).agg(F.count_if(low).alias("fallback"), F.count("*").alias("total"))
    return own.withColumn("rate", F.when(F.col("total") == 0, 0.0).otherwise(F.col("fallback") / F.col("total")))


def judge_pages(judgments: DataFrame, elements: DataFrame) -> DataFrame:
    """Each judgment (id, source, paper, page, expect, elementIds, must) met or not by the elements' labels and units.

    expect: ``text`` (all are text), ``same-unit`` (all share one unit), ``not-same-unit``.
    """
    each = judgments.select("*", F.explode_outer("elementIds").alias("elementId"))
    own = elements.select("paper", "page", F.col("id").alias("elementId"), "label", "unitId")
    g = each.join(own, ["paper", "page", "elementId"], "left").groupBy("id", "source", "expect", "must").agg(
        F.bool_and(F.coalesce(F.col("label") == "text", F.lit(False))).alias("all_text"), F.countDistinct("unitId").alias("units"),
        F.count_if(F.col("unitId").isNull()).alias("loose"),
    )
    same = (F.col("units") == 1) & (F.col("loose") == 0)
    met = F.when(F.col("expect") == "text", F.col("all_text")).when(F.col("expect") == "same-unit", same).otherwise(~same)
    return g.select("id", "source", "must", met.alias("met"))


def judgment_summary(results: DataFrame) -> DataFrame:
    """Passed and in all by source, and overall (null source)."""
    return results.rollup("source").agg(
        F.count_if("met").alias("passed"), F.count("*").alias("total"), F.count_if(F.col("must") & ~F.col("met")).alias("must_failed"),
        F.grouping("source").alias("overall"),
    ).orderBy("overall", "source")


def ab_summary(rows: DataFrame, arms: DataFrame, channels: DataFrame) -> DataFrame:
    """Counts by arm, provider and model, groups without rows as zeros; rates only over measured rows."""
    spine = arms.select("arm").crossJoin(channels.select("provider", "model"))  # every group, with rows or not
    m = F.coalesce("measured", F.lit(False))
    of = lambda c: F.count_if(m & F.coalesce(F.col(c), F.lit(False)))
    own = rows.groupBy("arm", "provider", "model").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("sent", F.lit(False))).alias("sent"), F.count_if(m).alias("measured"),
        of("verified").alias("verified"), of("matches").alias("matches"), F.sum(F.when(m, F.col("latencyMs"))).alias("latencyMs"),
    )
    out = spine.join(own, ["arm", "provider", "model"], "left").fillna(0, ["n", "sent", "measured", "verified", "matches", "latencyMs"])
    none = F.col("measured") == 0
    ratio = lambda c: F.when(~none, F.col(c) / F.col("measured"))
    return out.withColumns({"verifiedRate": ratio("verified"), "matchRate": ratio("matches"), "meanLatency": ratio("latencyMs")})


def ab_best(summary: DataFrame, primary: str) -> DataFrame:
    """The best group of each arm: match rate, verified rate, lower latency, the primary provider, then name."""
    w = Window.partitionBy("arm").orderBy(
        F.col("matchRate").desc_nulls_last(), F.col("verifiedRate").desc_nulls_last(), F.col("meanLatency").asc_nulls_last(),
        (F.col("provider") == primary).desc(), "provider", "model",
    )
    return summary.where("measured > 0").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def coverage(expected: DataFrame, sampled: DataFrame) -> DataFrame:
    """How many expected formulas and pages the sample holds, and whether all."""
    own = expected.join(sampled.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    return own.agg(
        F.count("*").alias("expected"), F.count("hit").alias("sampled"), F.countDistinct("page").alias("pages"),
        F.countDistinct(F.when(F.col("hit"), F.col("page"))).alias("sampled_pages"), F.bool_and(F.col("hit").isNotNull()).alias("complete"),
    )


def rebuild_units(elements: DataFrame) -> DataFrame:
    """Units of labelled elements: display and numbered if any member is, confidence the least, id from the members."""
    own = elements.where("unitId is not null").groupBy("page", F.col("unitId").alias("was")).agg(
        F.array_sort(F.collect_set("id")).alias("elementIds"), F.bool_or(F.coalesce(F.col("unitType") == "display", F.lit(False))).alias("display"),
        F.bool_or(F.coalesce("equationNumber", F.lit(False))).alias("equationNumber"), F.min("confidence").alias("confidence"),
    )
    return own.select("page", "was", ids.unit_id(F.col("elementIds")).alias("id"), F.when(F.col("display"), "display").otherwise("inline").alias("type"), "equationNumber", "confidence", "elementIds")


def review_status(units: DataFrame, reviewed: DataFrame) -> DataFrame:
    """By paper and page: units, uncertain ones, and whether the page is reviewed."""
    seen = reviewed.select("paper", "page").distinct().withColumn("seen", F.lit(True))
    return (
        units.groupBy("paper", "page").agg(F.count("*").alias("units"), F.count_if(F.col("confidence") < UNCERTAIN_CONFIDENCE).alias("uncertain"))
        .join(seen, ["paper", "page"], "left").withColumn("reviewed", F.coalesce("seen", F.lit(False))).drop("seen")
    )


def merge_issues(units: DataFrame, records: DataFrame) -> DataFrame:
    """Elements with several owners, and merge pointers to a unit that is absent or itself merged."""
    owners = units.select("page", "unitId", F.explode("elementIds").alias("elementId")).groupBy("page", "elementId").agg(F.countDistinct("unitId").alias("n"))
    many = owners.where("n > 1").select("page", F.col("elementId").alias("id"), F.lit("multi-owner").alias("issue"))
    merged = records.where("mergedInto is not null")
    to = units.select("page", F.col("unitId").alias("mergedInto"), F.lit(True).alias("there"))
    lost = merged.join(to, ["page", "mergedInto"], "left").where("there is null").select("page", F.col("unitId").alias("id"), F.lit("merge-target-missing").alias("issue"))
    again = merged.select("page", F.col("unitId").alias("mergedInto")).distinct()
    chain = merged.join(again, ["page", "mergedInto"], "left_semi").select("page", F.col("unitId").alias("id"), F.lit("merge-chain").alias("issue"))
    return many.unionByName(lost).unionByName(chain)


LABELS, KINDS, UNIT_TYPES = ("formula", "text", "code", "other"), ("glyph", "path", "image"), ("display", "inline")


def label_issues(elements: DataFrame, units: DataFrame) -> DataFrame:
    """(page, id, issue) of page labels: enumerations, recomputed ids, duplicates, ordinal gaps, membership.

    ``elements`` has page, id, kind, char, font, bbox (array), pathHash, ordinal, label, unitId.
    """
    box = [F.col("bbox")[k] for k in range(4)]
    fp = ids.element_fingerprint(F.col("kind"), F.col("char"), F.col("font"), box, F.col("pathHash"))
    own = elements.withColumn("fp", fp)
    say = lambda df, issue: df.select("page", "id", F.lit(issue).alias("issue"))
    w = Window.partitionBy("page", "fp").orderBy("ordinal", "id")
    parts = [
        say(own.where(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))), "kind"),
        say(own.where(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False))), "label"),
        say(own.where(F.col("id") != ids.element_id(F.col("fp"), F.col("ordinal"))), "identity"),
        say(own.groupBy("page", "id").count().where("count > 1"), "duplicate"),
        say(own.withColumn("k", F.row_number().over(w) - 1).where("k <> ordinal"), "ordinal"),
        say(units.where(~F.coalesce(F.col("type").isin(*UNIT_TYPES), F.lit(False))), "unit-type"),
        say(units.where(F.col("id") != ids.unit_id(F.col("elementIds"))), "unit-identity"),
    ]
    members = units.select("page", F.col("id").alias("unit"), F.explode("elementIds").alias("id"))
    known = elements.select("page", "id", F.col("unitId").alias("own_unit"), F.lit(True).alias("there"))
    joined = members.join(known, ["page", "id"], "left")
    parts.append(say(joined.where("there is null"), "member-missing"))
    parts.append(say(joined.where("there and not (own_unit <=> unit)"), "member-unit"))
    return reduce(DataFrame.unionByName, parts)


def neighbour_content(selected: DataFrame, labels: DataFrame) -> DataFrame:
    """Selected ids whose label is not formula, or that have none."""
    own = selected.join(labels.select("id", "label"), "id", "left")
    return own.where("label is null or label <> 'formula'").withColumn("problem", F.when(F.col("label").isNull(), "unlabelled").otherwise("neighbour"))


def source_audit(items: DataFrame, excluded: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each source item is to stand in exactly one block, or be excluded: excluded, missing, duplicate or owned."""
    owners = blocks.select("page", F.explode("sourceItems").alias("item")).groupBy("page", "item").agg(F.count("*").alias("n"))
    out = items.select("page", "item").join(owners, ["page", "item"], "left").join(excluded.select("page", "item", F.lit(True).alias("ex")), ["page", "item"], "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("page", "item", F.when((n == 0) & F.col("ex"), "excluded").when(n == 0, "missing").when(n > 1, "duplicate").otherwise("owned").alias("verdict"))


def ink(images: DataFrame) -> DataFrame:
    """Missing, extra and out-of-bounds ink and the difference of two grey images (id, width, height, own, truth: bytes)."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples():
                shape = (r.height, r.width)
                a, t = (np.frombuffer(x, np.uint8).reshape(shape).astype(int) for x in (r.own, r.truth))
                d, ai, ti = np.abs(a - t), a < 128, t < 128
                edge = np.ones(shape, bool)
                edge[1:-1, 1:-1] = False
                rows.append((r.id, int((ti & ~ai).sum()), int((ai & ~ti).sum()), int((ai & edge).sum()), int(d.max(initial=0)), float(d.mean()) if d.size else 0.0, int((d > 0).sum())))
            yield pd.DataFrame(rows, columns=["id", "missing", "extra", "out", "max_diff", "mean_diff", "n_diff"])

    return images.select("id", "width", "height", "own", "truth").mapInPandas(run, "id long, missing long, extra long, out long, max_diff long, mean_diff double, n_diff long")


def leak_scan(papers: DataFrame, before: Column, after: Column) -> DataFrame:
    """Leaks by paper before and after a repair (columns of text)."""
    from ..functions.text import leak_counts

    total = lambda c: reduce(Column.__add__, leak_counts(c).values())
    return papers.select("paper", total(before).alias("before"), total(after).alias("after"))


def leak_bar(scan: DataFrame, sample: DataFrame, leaks: int = 20, papers: int = 5) -> DataFrame:
    """A sample's leaks against the bar for merging; papers of the sample without a scan are counted as missing."""
    own = sample.select("paper").distinct().join(scan, "paper", "left")
    out = own.agg(
        F.coalesce(F.sum("after"), F.lit(0)).alias("leaks"), F.count_if(F.col("after") > 0).alias("leaky"), F.count_if(F.col("after").isNull()).alias("missing")
    )
    return out.withColumn("passes", (F.col("leaks") <= leaks) & (F.col("leaky") <= papers) & (F.col("missing") == 0))


#: Rows of a Markdown table at most.
TABLE_ROWS = 1000


def markdown_table(rows: DataFrame, most: int = TABLE_ROWS) -> str:
    """A small result as a Markdown table; more than ``most`` rows are an error, as a report is no place for them."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a table of over {most} rows")
    cells = [rows.columns, ["---"] * len(rows.columns), *([("" if v is None else str(v)) for v in r] for r in got)]
    return "\n".join("| " + " | ".join(r) + " |" for r in cells)


def tokens_of(usage: Column) -> Column:
    """Prompt, completion and total tokens under any vendor's names, from a map of counts."""
    pick = lambda *names: F.coalesce(*(usage[n] for n in names))
    p, c = pick("prompt_tokens", "input_tokens", "promptTokenCount"), pick("completion_tokens", "output_tokens", "candidatesTokenCount")
    return F.struct(p.alias("prompt"), c.alias("completion"), F.coalesce(pick("total_tokens", "totalTokenCount"), p + c).alias("total"))


def audit_summary(findings: DataFrame) -> DataFrame:
    """Distinct findings counted by queue index."""
    return findings.dropDuplicates(["queueIndex", "rule", "elementId"]).groupBy("queueIndex").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("rule")).alias("rules"))


def slot_assignments(formulas: DataFrame) -> DataFrame:
    """Slots with exactly one passing formula."""
    return formulas.where("passes and slot is not null").groupBy("slot").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")


def splice_plans(formulas: DataFrame) -> DataFrame:
    """(block, start, end) where all formulas pass and none has a slot, with their LaTeX in order."""
    own = formulas.groupBy("block", "start", "end").agg(
        F.bool_and(F.coalesce("passes", F.lit(False))).alias("ok"), F.bool_or(F.col("slot").isNotNull()).alias("slotted"),
        F.array_sort(F.collect_list(F.struct("ord", "latex"))).alias("f"),
    )
    return own.where("ok and not slotted").select("block", "start", "end", F.array_join(F.transform("f", lambda x: x["latex"]), " ").alias("latex"))


def verdict(stored: Column, current: Column, version: Column, live: Column, compatible: Sequence[str] = ()) -> Column:
    """Of a page's stored formulas: absent, unchecked, stale, current or compatible."""
    return (
        F.when(stored.isNull(), "absent").when(version.isNull(), "unchecked").when(stored != current, "stale").when(version == live, "current")
        .when(version.isin(*compatible) if compatible else F.lit(False), "compatible").otherwise("stale")
    )


def page_stamp(pairs: DataFrame, by: Sequence[str] = ("docHash", "page")) -> DataFrame:
    """The one version that all pairs of a page bear; empty when mixed or missing."""
    own = pairs.groupBy(*by).agg(F.countDistinct("version").alias("n"), F.count_if(F.col("version").isNull()).alias("none"), F.min("version").alias("v"))
    return own.select(*by, F.when((F.col("n") == 1) & (F.col("none") == 0), F.col("v")).otherwise("").alias("version"))


def page_fingerprint(blocks: DataFrame, by: Sequence[str] = ("docHash", "page")) -> DataFrame:
    """SHA-256 of a page's source texts in order."""
    own = blocks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ord", text("text").alias("text")))).alias("b"))
    return own.select(*by, F.sha2(F.array_join(F.transform("b", lambda x: x["text"]), "\n"), 256).alias("fingerprint"))


def arbitrate(a_ok: Column, b_ok: Column, same: Column, a_score: Column, b_score: Column) -> Column:
    """Between two candidates: agreement, the only passing one, the better score, or undecided."""
    return (
        F.when(a_ok & b_ok & same, "agree").when(a_ok & ~b_ok, "a").when(b_ok & ~a_ok, "b").when(~a_ok & ~b_ok, "undecided")
        .when(a_score > b_score, "a").when(b_score > a_score, "b").otherwise("undecided")
    )


def cascade(tiers: dict[str, tuple[Column, Column]]) -> tuple[Column, Column]:
    """The first tier that is available and passes, and the trace of those tried; tiers: name to (available, passes)."""
    won = F.coalesce(*(F.when(a & p, F.lit(n)) for n, (a, p) in tiers.items()), F.lit("crop"))
    tried = F.array(*(F.when(a, F.concat(F.lit(f"{n}:"), F.when(p, "pass").otherwise("fail"))) for n, (a, p) in tiers.items()))
    return won, F.filter(tried, lambda x: x.isNotNull())


def same_number(a: Column, b: Column) -> Column:
    """Equation numbers agree when equal without brackets, or when either is missing."""
    bare = lambda c: F.regexp_replace(text(c), r"[()\s]", "")
    return (bare(a) == "") | (bare(b) == "") | (bare(a) == bare(b))


def tier_counts(formulas: DataFrame) -> DataFrame:
    """Formulas of a document by bucket of their tier."""
    bucket = F.when(F.col("status") == "pending", "pending").when(F.col("tier").isin("source", "arxiv"), "source").when(F.col("tier") == "crop", "crop").otherwise("model")
    return formulas.groupBy("docHash", bucket.alias("bucket")).count()


def status_order(status: DataFrame) -> DataFrame:
    """Pages to review: most uncertain units first, then by paper and page."""
    return status.orderBy(F.desc("uncertain"), "paper", "page")


def units_for_manifest(units: DataFrame, manifest: DataFrame) -> DataFrame:
    """The units that a manifest (n, queueIndex: places in the queue from 1) names, in its order; places beyond the queue are dropped.

    ``units`` has ``queue``, the place from 1.
    """
    return manifest.join(units, F.col("queueIndex") == F.col("queue")).drop("queue").orderBy("n")


def audit_window(queue: DataFrame, confirmed: DataFrame, limit: int | None = None, key: Sequence[str] = ("paperId", "page", "unitId")) -> DataFrame:
    """The first ``limit`` of the queue (queue: the place from 1), else all up to the last confirmed one; ``confirmed`` tells which are."""
    own = queue.join(confirmed.select(*key).distinct().withColumn("__hit", F.lit(True)), list(key), "left")
    own = own.withColumn("confirmed", F.coalesce("__hit", F.lit(False))).drop("__hit")
    if limit is not None:
        return own.where(F.col("queue") <= limit)
    last = own.where("confirmed").agg(F.coalesce(F.max("queue"), F.lit(0))).first()[0]  # one number
    return own.where(F.col("queue") <= last)


def text_coverage(model: DataFrame, layer: DataFrame, gap: str, key: str = "page") -> DataFrame:
    """By page: characters of the model's blocks over those of the text layer, white space and gap marks aside; 1 without a text layer."""
    bare = lambda c: F.regexp_replace(F.replace(c, F.lit(gap), F.lit("")), r"\s+", "")
    shown = F.coalesce(F.nullif("text", F.lit("")), F.col("latex"), F.lit("")) if "latex" in model.columns else text("text")
    m = model.groupBy(key).agg(F.sum(F.length(bare(shown))).alias("m"))
    t = layer.groupBy(key).agg(F.sum(F.length(bare(text("text")))).alias("t"))
    ratio = F.when(F.coalesce("t", F.lit(0)) == 0, 1.0).otherwise(F.coalesce("m", F.lit(0)) / F.col("t"))
    return t.join(m, key, "full_outer").select(key, ratio.alias("coverage"))


#: Least share of characters that a candidate and its source have in common.
CHARSET_BAR = 0.9


def verify_candidate(latex: Column, source: Column, unknown: Column, charset: Column) -> Column:
    """(pass, reason, confidence) of a candidate's characters (``charset``: array, ``unknown``: its commands that no table holds) against the
    text of its source. The drawing itself is not checked."""
    from .match import chars_of, jaccard

    theirs = chars_of(source)
    j = F.when((F.size(charset) == 0) | (F.size(theirs) == 0), 0.0).otherwise(jaccard(charset, theirs))
    reason = (
        F.when(F.size(unknown) > 0, "unknown-command").when(F.size(charset) == 0, "charset-mismatch").when(F.size(theirs) == 0, "uncheckable-glyph")
        .when(j < CHARSET_BAR, "charset-mismatch")
    )
    sure = F.when((F.size(unknown) > 0) | (F.size(charset) == 0) | (F.size(theirs) == 0), 0.0).otherwise(j)
    return F.struct(reason.isNull().alias("pass"), reason.alias("reason"), sure.alias("confidence"))
