"""Translation memory and the batched pipeline with a model as a plain callable."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as tx

TRANSLATABLE = ("title", "heading", "text", "caption", "aside")
VISUAL = ("formula", "figure", "table")
BATCH, FAILED_PAGES = 8, 3


def is_translatable(label: Column, text: Column, skip: Column) -> Column:
    return label.isin(*TRANSLATABLE) & ~F.coalesce(skip, F.lit(False)) & (tx.collapse(text) != "")


def prepare(blocks: DataFrame) -> DataFrame:
    """Blocks without headers and footers; visual ones without text."""
    own = blocks.where(~F.coalesce(F.col("label").isin("header", "footer"), F.lit(False)))
    return own.withColumn("text", F.when(~F.coalesce(F.col("label").isin(*VISUAL), F.lit(False)), F.col("text")))


def needing(units: DataFrame, script: str = "han") -> DataFrame:
    return units.where(~tx.settled(F.col("translation"), F.col("text"), script))


def paint(blocks: DataFrame, results: DataFrame) -> DataFrame:
    """Translations onto blocks by bid, else by id for rows without one; others are dropped, empty ones clear nothing unless they failed.

    Of several results for one key the last by ``ord`` holds where there is such a column, then the greatest text.
    """
    ord_ = F.col("ord") if "ord" in results.columns else F.lit(0)
    r = results.select("bid", "id", F.struct(ord_.alias("ord"), tx.text("translation").alias("t"), F.coalesce("failed", F.lit(False)).alias("f")).alias("r"))
    by_bid = r.where("bid <> ''").groupBy("bid").agg(F.max("r").alias("rb"))
    by_id = r.where("coalesce(bid, '') = '' and id <> ''").groupBy("id").agg(F.max("r").alias("ri"))
    j = blocks.join(by_bid, "bid", "left").join(by_id, "id", "left")
    hit = F.coalesce("rb", "ri")
    can = is_translatable(F.col("label"), F.col("text"), F.col("skip")) & hit.isNotNull() & ~((hit["t"] == "") & (tx.text("translation") != "") & ~hit["f"])
    return j.withColumn("translation", F.when(can, hit["t"]).otherwise(F.col("translation"))).drop("rb", "ri")


def paint_aliases(blocks: DataFrame, results: DataFrame, script: str = "han") -> DataFrame:
    """As ``paint``, but a block (bid, aliases, id) also takes results that name an alias, and of all its results the first that landed, else the first.

    Order: its own bid, its aliases as listed, its id for results without a bid. A source that was handed back under the own bid thus
    does not hide a translation stored under an alias.
    """
    ord_ = F.col("ord") if "ord" in results.columns else F.lit(0)
    one = F.struct(ord_.alias("ord"), tx.text("translation").alias("t"), F.coalesce("failed", F.lit(False)).alias("f"))
    named = results.where("bid <> ''").groupBy(F.col("bid").alias("key")).agg(F.max(one).alias("r")).withColumn("kind", F.lit("bid"))
    by_id = results.where("coalesce(bid, '') = '' and id <> ''").groupBy(F.col("id").alias("key")).agg(F.max(one).alias("r")).withColumn("kind", F.lit("id"))
    own = blocks.withColumn("__row", F.struct(*blocks.columns))
    bids = F.filter(F.array_distinct(F.concat(F.array(tx.text("bid")), F.coalesce("aliases", F.array().cast("array<string>")))), lambda b: F.coalesce(b, F.lit("")) != "")
    keys = F.concat(F.transform(bids, lambda b, i: F.struct(i.alias("k"), F.lit("bid").alias("kind"), b.alias("key"))), F.array(F.struct(F.lit(1 << 20).alias("k"), F.lit("id").alias("kind"), tx.text("id").alias("key"))))
    hits = own.select("__row", F.inline(keys)).join(named.unionByName(by_id), ["kind", "key"])
    late = ~F.coalesce(tx.landed(F.col("r.t"), F.col("__row.text"), script), F.lit(False))
    best = hits.groupBy("__row").agg(F.min_by("r", F.struct(late, F.col("k"))).alias("hit"))
    b, hit = own.join(best, "__row", "left"), F.col("hit")
    can = is_translatable(F.col("label"), F.col("text"), F.col("skip")) & hit.isNotNull() & ~((hit["t"] == "") & (tx.text("translation") != "") & ~hit["f"])
    return b.withColumn("translation", F.when(can, hit["t"]).otherwise(F.col("translation"))).drop("hit", "__row")


def invalidate_page(pairs: DataFrame, layouts: DataFrame, blocks: DataFrame, protocol: str) -> tuple[DataFrame, DataFrame]:
    """What stays of pairs and layouts (docHash, page, ...) when the ``blocks`` of some pages take their place; other pages stay whole.

    A pair stays whose bid or alias is a live block of the page with the same source and that is no echo; a layout of the current protocol that names the
    same blocks in the same order (``bids``).
    """
    page = ["docHash", "page"]
    live = blocks.select(*page, F.explode(F.array_union(F.array("bid"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("bid"), ids.reuse_key("text").alias("k"))
    touched = blocks.select(*page).distinct()
    own = pairs.withColumn("k", ids.reuse_key("text"))
    kept = own.join(live, [*page, "bid", "k"], "left_semi").where(~tx.is_echo(F.col("translation"), F.col("text")))
    pairs = own.join(touched, page, "left_anti").unionByName(kept).drop("k")
    order = blocks.groupBy(*page).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "bid"))), lambda x: x["bid"]).alias("bids"))
    same = layouts.where(F.col("protocol") == protocol).join(order, [*page, "bids"], "left_semi")
    return pairs, layouts.join(touched, page, "left_anti").unionByName(same.select(*layouts.columns))


def remap_slots(live: Column, prior: Column, translation: Column) -> Column:
    """(kind, translation) of a reused translation whose placeholders are those of ``prior``, for the placeholders of ``live``: arrays of (token, formula).

    ``keep`` where the tokens agree or there are none, ``remapped`` where each names a live one, ``retranslate`` else. First by place, where
    formulas agree or hold one another; then by formula, where each stands once. Tokens are swapped at once, so none is taken for another.
    """
    tokens = tx.placeholders(translation)
    size = F.size(live)
    formula = lambda t, i: F.coalesce(F.try_element_at(F.filter(prior, lambda p: p["token"] == t), F.lit(1))["formula"], F.try_element_at(prior, i + 1)["formula"], F.lit(""))
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    agrees = lambda a, b: (a == "") | (b == "") | a.contains(b) | b.contains(a)
    by_place = (F.size(tokens) == size) & ~F.exists(
        F.transform(tokens, lambda t, i: agrees(bare(formula(t, i)), bare(F.try_element_at(live, i + 1)["formula"]))), lambda ok: ~ok
    )
    match = lambda t: F.filter(live, lambda s: s["formula"] == F.try_element_at(F.filter(prior, lambda p: p["token"] == t), F.lit(1))["formula"])
    mapped = F.transform(tokens, lambda t: F.when(F.size(match(t)) == 1, F.try_element_at(match(t), F.lit(1))["token"]))
    by_formula = ~F.exists(mapped, lambda t: t.isNull()) & (F.size(F.array_distinct(mapped)) == size) & (F.size(tokens) == size)
    target = F.when(by_place, F.transform(live, lambda s: s["token"])).when(by_formula, mapped)
    # the text between tokens, then token and text in turn
    parts = F.split(translation, tx.PLACEHOLDER, -1)
    text = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.try_element_at(target, i + 1), F.lit("")))), "")
    same = F.transform(live, lambda s: s["token"])
    kind = (
        F.when((F.size(tokens) == 0) | (tokens == same), "keep").when(size == 0, "retranslate")
        .when(target.isNotNull() & (target == same), "remapped").otherwise("retranslate")
    )
    return F.struct(kind.alias("kind"), F.when(kind == "remapped", text).alias("translation"))


def pair_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests (req, pos, bid) with their answer (req, pos, bid, translation): the first of a bid, by position where unkeyed."""
    keyed = responses.where("bid <> ''").groupBy("req", "bid").agg(F.min(F.struct("pos", "translation")).alias("kt")).withColumn("kt", F.col("kt.translation"))
    plain = responses.where("coalesce(bid, '') = ''").groupBy("req", "pos").agg(F.min("translation").alias("pt"))
    return requests.join(keyed, ["req", "bid"], "left").join(plain, ["req", "pos"], "left").withColumn("translation", F.coalesce("kt", "pt")).drop("kt", "pt")


def merge_rows(prior: DataFrame, incoming: DataFrame, script: str = "han") -> DataFrame:
    """Rows by (doc, page, bid): settled ones stay, others take what comes, new ones are added."""
    p, i = prior.alias("p"), incoming.where("bid <> ''").alias("i")
    key = ["doc", "page", "bid"]
    keep = F.coalesce(tx.settled(F.col("p.translation"), F.col("p.text"), script), F.lit(False)) & ~F.coalesce(
        tx.is_echo(F.col("p.translation"), F.col("p.text")) & tx.landed(F.col("i.translation"), F.col("i.text"), script), F.lit(False)
    )
    pick = lambda c: F.when(keep, F.col(f"p.{c}")).otherwise(F.coalesce(f"i.{c}", f"p.{c}"))
    return p.join(i, key, "full_outer").select(*key, pick("text").alias("text"), pick("translation").alias("translation"))


def memory(pairs: DataFrame) -> DataFrame:
    """Source keys with their translation; a key with several translations is a conflict and gives none."""
    own = pairs.where(tx.collapse("translation") != "").select(ids.reuse_key("text").alias("key"), "translation")
    g = own.groupBy("key").agg(F.countDistinct("translation").alias("n"), F.min("translation").alias("t"), F.count("*").alias("pairs"))
    return g.select("key", "n", "pairs", (F.col("n") > 1).alias("conflict"), F.when(F.col("n") == 1, F.col("t")).alias("translation"))


def reuse(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """Saved translations for units: by bid with an equal source, then sourceId, then a source without conflict; ``how`` tells which.

    A bid whose source changed is ``changed`` and gives nothing. Of several pairs of a bid the least translation counts.
    """
    own = units.withColumn("key", ids.reuse_key("text"))
    p = pairs.where(tx.collapse("translation") != "").withColumn("key", ids.reuse_key("text"))
    b = p.where("bid <> ''").groupBy("bid").agg(F.min(F.struct("translation", "key")).alias("b")).select("bid", F.col("b.translation").alias("bt"), F.col("b.key").alias("bk"))
    s = p.where("sourceId <> ''").groupBy("sourceId", "key").agg(F.min("translation").alias("st"), F.countDistinct("translation").alias("sn")).where("sn = 1").drop("sn")
    m = memory(pairs).where("not conflict").select("key", F.col("translation").alias("mt"))
    j = own.join(b, "bid", "left").join(s, ["sourceId", "key"], "left").join(m, "key", "left")
    how = F.when(F.col("bk") == F.col("key"), "bid").when(F.col("bk").isNotNull() & F.col("mt").isNull(), "changed").when(F.col("st").isNotNull(), "sourceId").when(F.col("mt").isNotNull(), "memory")
    t = F.when(how == "bid", F.col("bt")).when(how == "sourceId", F.col("st")).when(how == "memory", F.col("mt"))
    return j.withColumn("how", how).withColumn("reused", t).drop("bt", "bk", "st", "mt", "key")


def verified(pairs: DataFrame, blocks: DataFrame, aliases: bool = False) -> DataFrame:
    """Pairs whose bid (or an alias) is live with the same source."""
    live = blocks.select(F.explode(F.array_union(F.array("bid"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("bid"), ids.reuse_key("text").alias("k")) if aliases else blocks.select("bid", ids.reuse_key("text").alias("k"))
    return pairs.withColumn("k", ids.reuse_key("text")).join(live, ["bid", "k"], "left_semi").drop("k")


def coverage(units: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """Share of units by group that a saved pair covers."""
    hit = pairs.where(tx.collapse("translation") != "").select("bid").distinct().withColumn("hit", F.lit(True))
    g = units.join(hit, "bid", "left").groupBy(*by).agg(F.count("*").alias("units"), F.count("hit").alias("covered"))
    return g.withColumn("coverage", F.col("covered") / F.col("units"))


def page_state(results: DataFrame, by: list[str], script: str = "han") -> DataFrame:
    """A page's state from its rows (text, translation, failed): empty, done, failed or partial."""
    ok = tx.settled(F.col("translation"), F.col("text"), script)
    g = results.groupBy(*by).agg(F.count("text").alias("n"), F.count_if(ok).alias("done"))
    return g.select(*by, F.when(F.col("n") == 0, "empty").when(F.col("done") == F.col("n"), "done").when(F.col("done") == 0, "failed").otherwise("partial").alias("state"))


def stub(texts: list[str]) -> list[str]:
    """Stands in for a model: deterministic and offline."""
    return [f"译：{t}" for t in texts]


def run(units: DataFrame, pairs: DataFrame, model: Callable[[list[str]], list[str]] = stub, batch: int = BATCH, polish: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """units (doc, page, bid, sourceId, text) with translation and ``how`` (bid, sourceId, memory or model).

    Memory first, then each missing source text once through the model in batches; a second callable may polish the
    drafts, which stand where it fails. The model's rate is bounded by the partitions of that step.
    """
    hits = reuse(units, pairs)
    miss = hits.where("reused is null").select(ids.reuse_key("text").alias("key"), tx.collapse("text").alias("source")).dropDuplicates(["key"])

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k in range(0, len(pdf), batch):
                own = pdf.source.iloc[k : k + batch].tolist()
                got = model(own)
                if len(got) != len(own):
                    got = [""] * len(own)
                if polish:
                    try:
                        better = polish(got)
                        got = better if len(better) == len(got) else got
                    except Exception:  # noqa: BLE001 - drafts stand
                        pass
                out += got
            yield pd.DataFrame({"key": pdf.key, "drafted": out})

    new = miss.mapInPandas(call, "key string, drafted string")
    own = hits.withColumn("key", ids.reuse_key("text")).join(new, "key", "left")
    done = F.when(F.col("reused").isNotNull(), F.col("how")).when(tx.text("drafted") != "", "model")
    return own.withColumn("how", done).withColumn("translation", F.coalesce("reused", F.nullif("drafted", F.lit("")))).drop("key", "drafted", "reused")


#: Models by name: callables that take a list of texts and give as many.
PROVIDERS: dict[str, Callable[[list[str]], list[str]]] = {"stub": stub}


def provider(name: str) -> Callable[[list[str]], list[str]]:
    """The registered model of that name; the callable itself goes to the workers."""
    if name not in PROVIDERS:
        raise KeyError(f"no model named {name!r}; known: {sorted(PROVIDERS)}")
    return PROVIDERS[name]
