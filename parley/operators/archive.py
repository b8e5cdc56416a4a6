"""The archive: captures in, current conversations and their revisions out, keyset search.

Arrivals carry `seq`, their order; status depends on it. First and last per key are partial
aggregates joined back, so a conversation with a third of the arrivals is never one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.identity import conversation_key, decode_cursor, encode_cursor
from parley.functions.text import storage_segment
from parley.operators import KEY, search

REV = [*KEY, "revision"]
MAX_PAGE = 100


def archive_paths(platform: Column, source_id: Column, revision: Column, has_raw: Column) -> Column:
    """struct<bundle_json, markdown, raw_capture>"""
    base = F.concat_ws("/", *[storage_segment(x) for x in (platform, source_id, revision)])
    return F.struct(F.concat(base, F.lit("/bundle.json")).alias("bundle_json"),
                    F.concat(base, F.lit("/conversation.md")).alias("markdown"),
                    F.when(has_raw, F.concat(base, F.lit("/raw-capture.json"))).alias("raw_capture"))


def ingest(batch: DataFrame, conversations: DataFrame, revisions: DataFrame) -> DataFrame:
    """The batch with `status` (created / updated / duplicate), `conversation_key` and `files`."""
    if "seq" not in batch.columns:
        raise ValueError("a batch needs a seq column: the status depends on the order of arrival")
    c = F.col
    firsts = batch.groupBy(*REV).agg(F.min("seq").alias("seq")).join(revisions.select(*REV), REV, "left_anti")
    known = conversations.select(*KEY, F.lit(True).alias("_known"))
    openers = firsts.groupBy(*KEY).agg(F.min("seq").alias("_opens")).join(known, KEY, "left") \
        .select(*KEY, F.when(c("_known").isNull(), c("_opens")).alias("_opens"))
    marked = firsts.join(openers, KEY).select(
        *REV, "seq", F.when(c("seq") == c("_opens"), "created").otherwise("updated").alias("status"))
    rows = batch.join(marked, [*REV, "seq"], "left")
    raw = c("has_raw") if "has_raw" in batch.columns else F.lit(False)
    return rows.withColumns({
        "status": F.coalesce("status", F.lit("duplicate")),
        "conversation_key": conversation_key(c("platform"), c("source_id")),
        "files": archive_paths(c("platform"), c("source_id"), c("revision"), raw)})


def new_revisions(revisions: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """The revisions that ``revisions`` lacks: of several arrivals of one the first is kept."""
    rest = ["extracted_at", "source_updated_at"]
    first = new.groupBy(*REV).agg(F.min_by(F.struct(*rest), "seq").alias("_row")).select(*REV, "_row.*")
    fresh = first.join(revisions.select(*REV), REV, "left_anti").withColumn("created_at", F.lit(now))
    return fresh.select(*revisions.columns)


def append_revisions(revisions: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """Insert or ignore."""
    return revisions.unionByName(new_revisions(revisions, new, now))


def upsert_conversations(conversations: DataFrame, ingested: DataFrame, now: str) -> DataFrame:
    """The last new revision of each KEY wins every column; created_at is kept."""
    c = F.col
    taken = ["revision", "title", "url", "source_updated_at", "message_count", "files"]
    last = (ingested.where(c("status") != "duplicate").groupBy(*KEY)
            .agg(F.max_by(F.struct(*taken), "seq").alias("_new")))
    rows = conversations.join(last, KEY, "full")
    hit = c("_new").isNotNull()
    new = {"title": c("_new.title"), "url": c("_new.url"), "latest_revision": c("_new.revision"),
           "latest_source_updated_at": c("_new.source_updated_at"), "updated_at": F.lit(now),
           "message_count": c("_new.message_count"), "file_bundle_json": c("_new.files.bundle_json"),
           "file_markdown": c("_new.files.markdown"), "file_raw_capture": c("_new.files.raw_capture")}
    return rows.withColumns({**{n: F.when(hit, x).otherwise(c(n)) for n, x in new.items()},
                             "created_at": F.coalesce("created_at", F.lit(now))}).select(*conversations.columns)


def get_conversation(conversations: DataFrame, platform: str, source_id: str) -> DataFrame:
    return conversations.where((F.col("platform") == platform) & (F.col("source_id") == source_id))


def has_revision(candidates: DataFrame, revisions: DataFrame) -> DataFrame:
    return candidates.join(revisions.select(*REV), REV, "left_semi")


def list_conversations(conversations: DataFrame, platform: str | None = None, q: str | None = None,
                       cursor: str | None = None, limit: int = 20, postings: DataFrame | None = None) -> DataFrame:
    """One page, newest update first. `%` and `_` in ``q`` are wildcards; case folds for ASCII only.

    ``postings``: the archive's trigram index (`parley.operators.search`); the rows are the same without it. The keyset
    predicate carries the bound on updated_at by itself, so file statistics can skip.
    """
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}")
    c = F.col
    rows = conversations
    if platform:
        rows = rows.where(c("platform") == platform)
    if q:
        near = None if postings is None else search.candidates(postings, q)
        rows = (rows if near is None else rows.join(near, KEY, "left_semi")).where(search.matches(q))
    if cursor:
        at = conversations.sparkSession.range(1).select(decode_cursor(F.lit(cursor)).alias("c")).first()["c"]
        if at is not None:
            later = (c("platform") > at["platform"]) | (
                (c("platform") == at["platform"]) & (c("source_id") > at["sourceId"]))
            rows = rows.where(c("updated_at") <= at["updatedAt"]).where((c("updated_at") < at["updatedAt"]) | later)
    return rows.orderBy(c("updated_at").desc(), c("platform"), c("source_id")).limit(limit)


def next_cursor(page: DataFrame, limit: int) -> DataFrame:
    """One row: the cursor after a full page, NULL after a short one. A page has at most 100 rows."""
    # The page's own order, which compares the times as texts: the last row has the least one, then the greatest key.
    key = F.struct("platform", "source_id")
    ends = page.groupBy("updated_at").agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("k"))
    got = ends.agg(F.sum("n").alias("n"), F.min_by(F.struct("updated_at", "k.platform", "k.source_id"), "updated_at").alias("l"))
    return got.select(F.when(F.col("n") == limit, encode_cursor(
        F.col("l.updated_at"), F.col("l.platform"), F.col("l.source_id"))).alias("next_cursor"))


def conversation_details(conversations: DataFrame, revisions: DataFrame, platform: str, source_id: str) -> DataFrame:
    """The record beside each of its revisions, newest first. Rows, not one array, so the history may be long."""
    record = to_record(get_conversation(conversations, platform, source_id))
    return (record.join(revisions.select(*REV, F.col("created_at").alias("revision_created_at")), KEY, "left")
            .orderBy(F.col("revision_created_at").desc(), "revision"))


def to_record(rows: DataFrame) -> DataFrame:
    """Flat rows to nested records with a `files` struct."""
    files = F.struct(F.col("file_bundle_json").alias("bundle_json"), F.col("file_markdown").alias("markdown"),
                     F.col("file_raw_capture").alias("raw_capture"))
    return rows.withColumn("files", files).drop("file_bundle_json", "file_markdown", "file_raw_capture")
