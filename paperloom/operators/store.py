"""Keyed collections: scans, revision-aware merges, change feeds, deletes, nested documents.

A collection is a DataFrame with its key columns named by the caller. Operators return new snapshots;
writing them is the caller's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import redact, text

#: Key and index columns of each collection, as stored.
COLLECTIONS = {
    "notes": (["id"], {"byDoc": ["docHash"], "byDocPage": ["docHash", "page"], "byUpdated": ["updatedAt"]}),
    "docs": (["docHash"], {}),
    "meta": (["key"], {}),
    "papers": (["docHash"], {"byOpened": ["lastOpenedAt"], "byUpdated": ["updatedAt"], "byArxiv": ["arxiv.key"]}),
    "pages": (["docHash", "page"], {"byDoc": ["docHash"]}),
    "layouts": (["docHash", "page", "mode", "protocol"], {"byDoc": ["docHash"]}),
    "groups": (["docHash", "groupId"], {"byDoc": ["docHash"], "byStartPage": ["docHash", "startPage"]}),
    "sources": (["docHash"], {}),
    "changes": (["seq"], {"byDoc": ["docHash"]}),
}
RANGE_FIELDS = {"index", "equals", "from", "to", "fromExclusive", "toExclusive", "direction", "limit"}
DONE_STATES = ("done", "skipped", "empty", "held")
OPEN_STATES = ("failed", "partial", "queued", "running", "layout")
RUN_STATES = (*DONE_STATES, *OPEN_STATES)


class DataError(ValueError):
    """A query or record that the store cannot read."""


def check_query(query: dict | None) -> dict:
    """A plain dict of known fields; else DataError."""
    if query is None:
        return {}
    if type(query) is not dict or not set(query) <= RANGE_FIELDS:
        raise DataError(f"not a plain query: {query!r}")
    if query.get("direction", "next") not in ("next", "prev"):
        raise DataError(f"no such direction: {query['direction']!r}")
    n = query.get("limit")
    if n is not None and (type(n) is not int or n < 0):
        raise DataError(f"no such limit: {n!r}")
    return query


def get(rows: DataFrame, key: Sequence[str], values: Sequence) -> DataFrame:
    """The row of a key."""
    return rows.where(reduce(Column.__and__, (F.col(k) == v for k, v in zip(key, values))))


def _tuple_cmp(cols: list[Column], values: list, strict: bool, less: bool) -> Column:
    """Compares a composite key to a prefix of values, element by element."""
    out = F.lit(not strict)
    for c, v in reversed(list(zip(cols, values))):
        before = c < v if less else c > v
        out = before | ((c == v) & out)
    return out


def scan(rows: DataFrame, index: Sequence[str], key: Sequence[str], query: dict | None = None) -> DataFrame:
    """Range scan over an index: rows with a null index column are not in it; sorted by index then key, limit last.

    ``equals``, ``from``, ``to`` take a value or a list, a prefix of the index. The filter reaches
    the scan, and order with limit runs as a bounded top-k.
    """
    q = check_query(query)
    cols = [F.col(c) for c in index]
    as_list = lambda v: list(v) if isinstance(v, (list, tuple)) else [v]
    out = rows.where(reduce(Column.__and__, (c.isNotNull() for c in cols)))
    if q.get("equals") is not None:
        out = out.where(reduce(Column.__and__, (c == v for c, v in zip(cols, as_list(q["equals"])))))
    if q.get("from") is not None:
        out = out.where(_tuple_cmp(cols, as_list(q["from"]), bool(q.get("fromExclusive")), False))
    if q.get("to") is not None:
        out = out.where(_tuple_cmp(cols, as_list(q["to"]), bool(q.get("toExclusive")), True))
    down = q.get("direction") == "prev"
    out = out.orderBy(*((F.col(c).desc() if down else F.col(c).asc()) for c in [*index, *(k for k in key if k not in index)]))
    return out if q.get("limit") is None else out.limit(q["limit"])


def live(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("deletedAt").isNull())


def search_papers(papers: DataFrame, query: str) -> DataFrame:
    """Title or file name holds the text, case folded; a blank query finds all."""
    needle = (query or "").strip().lower()
    if not needle:
        return papers
    return papers.where(F.lower(text.collapse("title")).contains(needle) | F.lower(text.text("fileName")).contains(needle))


def sort_papers(papers: DataFrame, by: str = "opened") -> DataFrame:
    own = F.col("bytes") if by == "size" else F.col("lastOpenedAt")
    return papers.orderBy(F.coalesce(own, F.lit(0)).desc(), F.col("docHash"))


def recent_papers(papers: DataFrame, current: str, limit: int = 15) -> DataFrame:
    return live(papers).where(F.col("docHash") != current).orderBy(F.coalesce("lastOpenedAt", F.lit(0)).desc(), "docHash").limit(limit)


def summary(papers: DataFrame) -> DataFrame:
    """What a list of papers shows: clean title and scrubbed URL."""
    shown = ["docHash", "pageCount", "pagesTranslated", "pagesIncomplete", "lastOpenedAt", "createdAt", "updatedAt", "rev", "fileName", "deletedAt"]
    own = [c for c in shown if c in papers.columns]
    return papers.select(*own, text.collapse("title").alias("title"), redact.scrub_url("sourceUrl").alias("sourceUrl"))


# --- merges ---------------------------------------------------------------------------------------


def newest(rows: DataFrame, key: Sequence[str], local: str | None = None) -> DataFrame:
    """One row a key: higher rev, then later updatedAt, then the local one. Combined before the shuffle."""
    rank = F.struct(F.coalesce("rev", F.lit(0)), F.coalesce("updatedAt", F.lit(0)), F.col(local) if local else F.lit(True))
    own = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), rank).alias("row"))
    return own.select("row.*")


def merge(local: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Last write wins; nothing local is deleted."""
    both = local.withColumn("__local", F.lit(True)).unionByName(incoming.withColumn("__local", F.lit(False)), allowMissingColumns=True)
    return newest(both, key, "__local").drop("__local")


def merge_outcomes(local: DataFrame, incoming: DataFrame, key: Sequence[str], newest_schema: int | None = None) -> DataFrame:
    """Key and outcome of every incoming key: added, updated, skipped, or rejected for a null key or a newer schema."""
    best = newest(incoming, key)
    mine = local.select(*key, F.coalesce("rev", F.lit(0)).alias("__rev"), F.coalesce("updatedAt", F.lit(0)).alias("__at"))
    bad = reduce(Column.__or__, (F.col(k).isNull() for k in key))
    if newest_schema is not None and "schema" in incoming.columns:
        bad = bad | (F.coalesce("schema", F.lit(0)) > newest_schema)
    rev, at = F.coalesce("rev", F.lit(0)), F.coalesce("updatedAt", F.lit(0))
    later = (rev > F.col("__rev")) | ((rev == F.col("__rev")) & (at > F.col("__at")))
    outcome = F.when(bad, "rejected").when(F.col("__rev").isNull(), "added").when(later, "updated").otherwise("skipped")
    return best.join(mine, list(key), "left").withColumn("outcome", outcome)


def tally(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of each outcome, overall or by column."""
    each = [F.count_if(F.col("outcome") == o).alias(o) for o in ("added", "updated", "skipped", "rejected")]
    return outcomes.groupBy(*by).agg(*each)


def put(
    rows: DataFrame, records: DataFrame, key: Sequence[str], accept: Column | None = None, combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Upsert: records replace rows of their key.

    ``accept`` keeps records out by a predicate; ``combine`` makes the records to write from the stored rows of their keys and
    the records, as page writes do that merge pairs.
    """
    records = records if accept is None else records.where(accept)
    if combine is not None:
        records = combine(rows.join(records.select(*key).distinct(), list(key), "left_semi"), records)
    return rows.join(records.select(*key), list(key), "left_anti").unionByName(records, allowMissingColumns=True)


def delete(rows: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.join(keys.select(*key), list(key), "left_anti")


def changes_since(changes: DataFrame, since: int, limit: int | None = None) -> DataFrame:
    """The change feed after a cursor, in order; every row bears the cursor to go on from."""
    own = changes.where(F.col("seq") > since)
    out = own.orderBy("seq") if limit is None else own.orderBy("seq").limit(limit)
    return out.withColumn("nextSeq", F.col("seq"))


def apply_changes(rows: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Remote puts by last write; deletes are never applied, and rows unseen arrive only by put."""
    puts = changes.where(F.col("op") == "put").select(*(c for c in rows.columns if c in changes.columns))
    return merge(rows, newest(puts, key), key)


def notes_since(notes: DataFrame, rev: int) -> DataFrame:
    return notes.where(F.col("rev") > rev).orderBy("rev", "id")


# --- pages and counts -----------------------------------------------------------------------------


def counts_as_translated(state: Column, skipped: Column, any_translation: Column) -> Column:
    s = F.coalesce(state, F.lit(""))
    return F.when(s.isin(*OPEN_STATES), False).when(s.isin(*DONE_STATES) | F.coalesce(skipped, F.lit(False)), True).when(s != "", False).otherwise(
        F.coalesce(any_translation, F.lit(False))
    )


def page_outcomes(pages: DataFrame, doc: str = "docHash", order: str = "ord") -> DataFrame:
    """Distinct pages of a document, the first row of each: translated and incomplete. Page numbers below 1 stand alone."""
    own = F.when(F.floor("page") >= 1, F.concat(F.lit("p:"), F.floor("page").cast("string"))).otherwise(F.concat(F.lit("i:"), F.col(order).cast("string")))
    first = pages.groupBy(F.col(doc), own.alias("__page")).agg(F.min_by(F.struct("runState", "skipped", "any_translation"), order).alias("r"))
    done = counts_as_translated(F.col("r.runState"), F.col("r.skipped"), F.col("r.any_translation"))
    return first.groupBy(doc).agg(
        F.count_if(done).alias("translated"), F.count_if(~done & F.coalesce(F.col("r.runState").isin("failed", "partial"), F.lit(False))).alias("incomplete")
    )


def storage(collections: dict[str, DataFrame], doc: str = "docHash") -> DataFrame:
    """Bytes of JSON by document over several collections."""
    size = lambda df: df.select(doc, F.octet_length(F.to_json(F.struct(*df.columns))).cast("long").alias("bytes"))
    return reduce(DataFrame.unionByName, map(size, collections.values())).groupBy(doc).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("records"))


def storage_update(known: DataFrame, dirty: DataFrame, collections: dict[str, DataFrame], doc: str = "docHash") -> DataFrame:
    """Measures only the dirty documents anew."""
    again = storage({n: df.join(dirty.select(doc).distinct(), doc, "left_semi") for n, df in collections.items()}, doc)
    return known.join(dirty, doc, "left_anti").unionByName(again)


def build_paper(existing: DataFrame, patch: DataFrame, now: int, revive: bool = False) -> DataFrame:
    """Patch over existing by docHash: rev + 1, creation kept, a tombstone kept unless revived, preprint id from the URL."""
    from ..functions.ids import arxiv_id

    cols = [c for c in existing.columns if c not in ("docHash", "rev", "createdAt", "updatedAt", "deletedAt")]
    e, p = existing.alias("e"), patch.alias("p")
    take = lambda c: F.coalesce(f"p.{c}", f"e.{c}") if c in patch.columns else F.col(f"e.{c}")
    out = e.join(p, "docHash", "full_outer").select(
        "docHash", *(take(c).alias(c) for c in cols),
        F.when(F.col("p.__hit"), F.coalesce("e.rev", F.lit(0)) + 1).otherwise(F.col("e.rev")).alias("rev"),
        F.coalesce("e.createdAt", F.lit(now)).alias("createdAt"),
        F.when(F.col("p.__hit"), F.lit(now)).otherwise(F.col("e.updatedAt")).alias("updatedAt"),
        (F.when(~F.coalesce("p.__hit", F.lit(False)), F.col("e.deletedAt")) if revive else F.col("e.deletedAt")).alias("deletedAt"),
    ) if "__hit" in patch.columns else build_paper(existing, patch.withColumn("__hit", F.lit(True)), now, revive)
    if "sourceUrl" in cols and "arxivId" not in out.columns:
        out = out.withColumn("arxivId", arxiv_id("sourceUrl")["id"])
    return out


def valid_pages(pages: DataFrame) -> DataFrame:
    """Pages with a known run state or none."""
    return pages.where(F.col("runState").isNull() | F.col("runState").isin(*RUN_STATES))


def delete_document(collections: dict[str, DataFrame], doc_hash: str, now: int, open_hash: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Drops pages, groups and layouts, leaves a tombstone on the paper, and gives the rows for the change log; not of the open paper."""
    if doc_hash == open_hash:
        raise DataError("the open paper stays")
    mine = F.col("docHash") == doc_hash
    out, log = {}, []
    for name, df in collections.items():
        log.append(df.where(mine).groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), F.lit(doc_hash).alias("docHash"), F.lit("delete").alias("op"), "n", F.lit(now).alias("at")))
        if name == "papers":
            out[name] = df.withColumn("deletedAt", F.when(mine, F.lit(now)).otherwise(F.col("deletedAt")))
        else:
            out[name] = df.where(~mine)
    return out, reduce(DataFrame.unionByName, log).where("n > 0")


def clear_translations(pages: DataFrame, doc_hash: str) -> DataFrame:
    """The pages without those of a document; papers, notes and sources are other collections and stay."""
    return pages.where(F.col("docHash") != doc_hash)


def repair_papers(papers: DataFrame, pages: DataFrame) -> DataFrame:
    """Papers whose recounted pages or scrubbed URL differ, put right; updatedAt as it was."""
    counted = page_outcomes(pages)
    own = papers.join(counted, "docHash", "left")
    url = redact.scrub_url("sourceUrl")
    wrong = (F.coalesce("translated", F.lit(0)) != F.coalesce("pagesTranslated", F.lit(0))) | (url != text.text("sourceUrl"))
    return own.where(wrong).select(
        *(c for c in papers.columns if c not in ("pagesTranslated", "pagesIncomplete", "sourceUrl")),
        F.coalesce("translated", F.lit(0)).alias("pagesTranslated"), F.coalesce("incomplete", F.lit(0)).alias("pagesIncomplete"), url.alias("sourceUrl"),
    )


def set_deleted(notes: DataFrame, ids: DataFrame, at: int | None) -> DataFrame:
    """Soft delete (a time) or restore (None) of notes by id."""
    hit = notes.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    when = F.lit(at).cast("long")
    return hit.withColumn("deletedAt", F.when(F.col("__hit"), when).otherwise(F.col("deletedAt"))).withColumn("rev", F.col("rev") + F.when(F.col("__hit"), 1).otherwise(0)).drop("__hit")


def purge(notes: DataFrame, ids: DataFrame) -> DataFrame:
    return notes.join(ids.select("id"), "id", "left_anti")


def pick_layout(layouts: DataFrame, engine: str) -> DataFrame:
    """One layout a page: of the engine, then of unknown, then of other mode; the newest."""
    rank = F.when(F.col("mode") == engine, 0).when(text.text("mode") == "", 1).otherwise(2)
    w = Window.partitionBy("docHash", "page").orderBy(rank, F.col("savedAt").desc_nulls_last(), "mode", "protocol")
    return layouts.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def flatten_document(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A nested document (docHash, title, pages: array of (page, pairs, layouts)) as papers, pages and layouts; first of equal keys kept."""
    papers = docs.select("docHash", text.collapse("title").alias("title"), F.size("pages").alias("pageCount"))
    each = docs.select("docHash", F.posexplode("pages").alias("ord", "p")).select("docHash", "ord", "p.*")
    w = Window.partitionBy("docHash", "page").orderBy("ord")
    pages = each.withColumn("__k", F.row_number().over(w)).where("__k = 1").select("docHash", "page", "pairs")
    lay = each.select("docHash", "page", "ord", F.posexplode("layouts").alias("o2", "l")).select("docHash", "page", "ord", "o2", "l.*")
    w = Window.partitionBy("docHash", "page", "mode", "protocol").orderBy("ord", "o2")
    return papers, pages, lay.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "ord", "o2")


def nest_document(papers: DataFrame, pages: DataFrame, layouts: DataFrame, engine: str) -> DataFrame:
    """Papers with their pages in order, each with the picked layout."""
    own = pages.join(pick_layout(layouts, engine).select("docHash", "page", "layout"), ["docHash", "page"], "left")
    nested = own.groupBy("docHash").agg(F.array_sort(F.collect_list(F.struct("page", "pairs", "layout"))).alias("pages"))
    return papers.join(nested, "docHash", "left")


def bundle(papers: DataFrame, pages: DataFrame, notes: DataFrame, with_pages: bool = True, with_notes: bool = True) -> DataFrame:
    """One JSON text a live document: sorted pages and notes nested, secret fields stripped."""
    out = live(papers)
    if with_pages:
        rest = [c for c in pages.columns if c not in ("docHash", "page")]
        out = out.join(pages.groupBy("docHash").agg(F.array_sort(F.collect_list(F.struct("page", F.struct(*rest).alias("data")))).alias("pages")), "docHash", "left")
    if with_notes:
        rest = [c for c in notes.columns if c not in ("docHash", "id")]
        out = out.join(live(notes).groupBy("docHash").agg(F.array_sort(F.collect_list(F.struct("id", F.struct(*rest).alias("data")))).alias("notes")), "docHash", "left")
    return out.select("docHash", redact.strip_secrets(F.to_json(F.struct(*out.columns))).alias("json"))


def layouts_for(keys: DataFrame, layouts: DataFrame, legacy: DataFrame) -> DataFrame:
    """The layout of each key, else the legacy one of its document and page."""
    key = ["docHash", "page", "mode", "protocol"]
    old = legacy.select("docHash", "page", F.col("layout").alias("old"))
    return keys.join(layouts.select(*key, "layout"), key, "left").join(old, ["docHash", "page"], "left").select(*key, F.coalesce("layout", "old").alias("layout"))


def first_unfinished(pages: DataFrame, totals: DataFrame) -> DataFrame:
    """The smallest page of 1..pageCount that is not translated, by document; null when all are."""
    every = totals.select("docHash", F.explode(F.sequence(F.lit(1), F.greatest("pageCount", F.lit(1)))).alias("page"))
    done = pages.where(counts_as_translated(F.col("runState"), F.col("skipped"), F.col("any_translation"))).select("docHash", "page")
    left = every.join(done, ["docHash", "page"], "left_anti").groupBy("docHash").agg(F.min("page").alias("page"))
    return totals.select("docHash").join(left, "docHash", "left")


# --- notes ----------------------------------------------------------------------------------------

FACETS = {
    "all": "true", "mine": "author = 'user'", "highlight": "kind = 'highlight'", "ai": "author = 'ai' or kind = 'qa'",
    "pending": "anchorState.status in ('lost', 'pending')",
}


def notes_of(notes: DataFrame, doc_hash: str, kinds: Sequence[str] = (), deleted: bool = False) -> DataFrame:
    out = notes.where(F.col("docHash") == doc_hash)
    out = out.where(F.col("kind").isin(*kinds)) if kinds else out
    return out if deleted else live(out)


def facet_counts(rows: DataFrame, facets: dict[str, str] = FACETS, by: Sequence[str] = ()) -> DataFrame:
    """How many rows each facet holds; a row may be in several."""
    return rows.groupBy(*by).agg(*(F.count_if(F.expr(e)).alias(n) for n, e in facets.items()))


def order_notes(notes: DataFrame) -> DataFrame:
    """Lost ones last, then block order, offset, creation and id."""
    lost = F.col("anchorState.status") == "lost"
    return notes.orderBy("docHash", F.coalesce(lost, F.lit(False)), F.col("block_ord").asc_nulls_last(), F.col("anchor.offset.start").asc_nulls_first(), "createdAt", "id")


def trash(notes: DataFrame) -> DataFrame:
    return notes.where(F.col("deletedAt").isNotNull()).orderBy(F.col("deletedAt").desc(), "id")


def notes_markdown(notes: DataFrame) -> DataFrame:
    """Markdown by document: page 0 first as the paper's notes, then each page; trash dropped."""
    own = live(notes).select("docHash", F.coalesce("page", F.lit(0)).alias("page"), "createdAt", "id", text.text("body").alias("body"))
    pages = own.groupBy("docHash", "page").agg(F.array_sort(F.collect_list(F.struct("createdAt", "id", "body"))).alias("n"))
    head = F.when(F.col("page") == 0, "## Paper notes").otherwise(F.concat(F.lit("## Page "), F.col("page").cast("string")))
    part = F.concat(head, F.lit("\n\n"), F.array_join(F.transform("n", lambda x: F.concat(F.lit("- "), x["body"])), "\n"))
    return pages.select("docHash", "page", part.alias("part")).groupBy("docHash").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "part"))), lambda x: x["part"]), "\n\n").alias("markdown")
    )


def merge_qa(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """Questions by id, the newest wins; those without an id once for each distinct record."""
    both = local.unionByName(incoming, allowMissingColumns=True)
    return newest(both.where("id is not null"), ["id"]).unionByName(both.where("id is null").distinct())


def save_if_absent(items: DataFrame, more: DataFrame, key: Sequence[str] = ("original", "translation")) -> DataFrame:
    return items.unionByName(more.dropDuplicates(list(key)).join(items.select(*key), list(key), "left_anti"), allowMissingColumns=True)


def pin(notes: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """By block: the kind of the highest rank, and the count where there are two or more."""
    rank = F.coalesce(F.create_map(*(x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))))[F.col("kind")], F.lit(-1))
    own = live(notes).groupBy("docHash", "bid").agg(F.max_by("kind", F.struct(rank, F.col("id"))).alias("kind"), F.count("*").alias("n"))
    return own.select("docHash", "bid", "kind", F.when(F.col("n") >= 2, F.col("n")).alias("count"))


def touch_documents(notes: DataFrame) -> DataFrame:
    """Notes that are not in the trash by document; documents whose notes all are have none left."""
    return notes.groupBy("docHash").agg(F.count_if(F.col("deletedAt").isNull()).alias("notesCount"))


def notes_by_place(notes: DataFrame) -> DataFrame:
    """Live notes as ``placed`` or ``lost``, by the state of their anchor."""
    return live(notes).withColumn("list", F.when(F.col("anchorState.status") == "lost", "lost").otherwise("placed"))


def due_items(items: DataFrame, now: int) -> DataFrame:
    """Study items whose next review has come."""
    return items.where(F.col("nextReview") <= now)


def done_union(local: DataFrame, incoming: DataFrame, key: str = "key", docs: str = "doneDocs") -> DataFrame:
    """Sets of completed documents of both sides as one, in order and without repeats."""
    none = F.array().cast(local.schema[docs].dataType)
    other = incoming.select(key, F.col(docs).alias("__more"))
    joined = local.join(other, key, "full_outer")
    return joined.select(key, F.array_sort(F.array_union(F.coalesce(docs, none), F.coalesce("__more", none))).alias(docs))


def import_next(source: DataFrame, cursor: str | None, n: int, key: str = "docHash") -> tuple[DataFrame, DataFrame]:
    """The next ``n`` documents after a cursor, whole, and the cursor to go on from.

    Documents come in order of their key, so a run that broke off goes on at the document after the last one that it finished, and a batch that
    is written again by key changes nothing. An empty batch ends the import.
    """
    left = source if cursor is None else source.where(F.col(key) > cursor)
    batch = left.select(key).distinct().orderBy(key).limit(n)
    return left.join(batch, key, "left_semi"), batch.agg(F.max(key).alias("cursor"))


def bounded_cache(entries: DataFrame, limit: int, now: int | None = None, ttl: int | None = None) -> DataFrame:
    """Of entries (key, at, ...) the last written of each key, not older than ``ttl``, and of those the newest ``limit`` by time, then key."""
    last = entries.groupBy("key").agg(F.max_by(F.struct(*entries.columns), "at").alias("e")).select("e.*")
    if ttl is not None:
        last = last.where(F.col("at") > now - ttl)
    return last.orderBy(F.desc("at"), "key").limit(limit)
