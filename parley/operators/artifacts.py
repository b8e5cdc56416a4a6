"""The artifact table and its reconciliation with the files on disk.

`pos` is the table order (smaller is nearer to the front). Choosing one row per conversation is an
argmax aggregate, which combines before the shuffle; windows serve only for top-n, where Spark
limits each group before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import identity as ids
from parley.functions import text as tx
from parley.functions.times import epoch_ms
from parley.functions.urls import PLATFORMS
from parley.operators import KEY
from parley.operators.conversations import with_titles
from parley.operators.discovery import EVENT_FIELDS, upsert_index, upserted
from parley.session import cut_lineage

REV = [*KEY, "revision"]
DAY_MS = 86_400_000
HISTORY_MODES = ("disabled", "recycle_previous", "archive_then_recycle")


def _live() -> Column:
    return ~F.coalesce(F.col("local_status").isin("deleted", "archived"), F.lit(False))


def _flagged() -> Column:
    return F.coalesce(F.col("is_latest"), F.lit(False))


def _argmax(rows: DataFrame, *rank: Column) -> DataFrame:
    rest = [x for x in rows.columns if x not in KEY]
    best = rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct(*rank)).alias("_row"))
    return best.select(*KEY, "_row.*").select(*rows.columns)


def front_of(table: DataFrame) -> Column:
    """A position before every row of the table: a scalar subquery of the plan, so no job runs while it is made."""
    return F.coalesce(table.agg(F.min("pos")).scalar(), F.lit(0)) - 1


def upsert_artifacts(artifacts: DataFrame, new: DataFrame, front: int | None = None) -> DataFrame:
    """Replace by (KEY, revision); the new rows come first, the last of them foremost."""
    front = front_of(artifacts) if front is None else F.lit(front)
    rest = [x for x in artifacts.columns if x not in REV]
    newest = new.groupBy(*REV).agg(F.max_by(F.struct(*rest), "pos").alias("_row")).select(*REV, "_row.*")
    placed = newest.withColumn("pos", front - F.col("pos")).select(*artifacts.columns)
    return artifacts.join(new.select(*REV), REV, "left_anti").select(*artifacts.columns).unionByName(placed)


def latest_artifact(artifacts: DataFrame) -> DataFrame:
    """One live row per KEY: the first one flagged latest, else the newest export."""
    return _argmax(artifacts.where(_live()), _flagged().alias("f"),
                   F.when(_flagged(), 0).otherwise(epoch_ms(F.col("exported_at"))).alias("t"), -F.col("pos"))


def latest_openable(artifacts: DataFrame) -> DataFrame:
    ready = (_live() & ~F.coalesce(F.col("local_status") == "missing", F.lit(False))
             & (F.col("markdown_download_id").isNotNull() | F.col("markdown_filename").isNotNull()))
    return _argmax(artifacts.where(ready), _flagged().alias("f"), epoch_ms(F.col("exported_at")).alias("t"),
                   -F.col("pos"))


def exact_artifact(artifacts: DataFrame, keys: DataFrame) -> DataFrame:
    return artifacts.where(_live()).join(keys.select(*REV).distinct(), REV, "left_semi")


def skip_persist(candidates: DataFrame, latest: DataFrame, index: DataFrame, policy: bool = True,
                 version: str | None = ids.HASH_VERSION) -> DataFrame:
    """Candidates (KEY, revision, …) with `skip`: their latest export already is this revision."""
    if not policy:
        return candidates.withColumn("skip", F.lit(False))
    have = latest.select(*KEY, F.col("revision").alias("_rev"), F.col("local_status").alias("_status"))
    known = index.select(*KEY, F.col("latest_export_version").alias("_version"))
    same = (F.col("_rev") == F.col("revision")) & ~F.col("_status").eqNullSafe("deleted")
    if version:
        same = same & F.col("_version").eqNullSafe(version)
    return (candidates.join(have, KEY, "left").join(known, KEY, "left")
            .withColumn("skip", F.coalesce(same, F.lit(False))).drop("_rev", "_status", "_version"))


def _newest(rows: DataFrame, n: int) -> DataFrame:
    """The n newest exports per KEY as (KEY, revision, _rank)."""
    order = W.partitionBy(*KEY).orderBy(epoch_ms(F.col("exported_at")).desc_nulls_last(), F.col("pos").asc())
    return (rows.select(*REV, "exported_at", "pos").withColumn("_rank", F.row_number().over(order))
            .where(F.col("_rank") <= max(0, n)).select(*REV, "_rank"))


def mark_latest(artifacts: DataFrame, n: int) -> DataFrame:
    """Keep the newest n per KEY, flag the newest; the others become deleted, deleted stays deleted."""
    rows = artifacts.join(_newest(artifacts, n), REV, "left")
    kept = F.col("_rank").isNotNull()
    status = (F.when(F.col("local_status") == "deleted", "deleted")
              .when(kept, F.coalesce("local_status", F.lit("present"))).otherwise("deleted"))
    return rows.withColumns({"local_status": status, "is_latest": F.coalesce(F.col("_rank") == 1, F.lit(False))}) \
        .select(*artifacts.columns)


def prune_revisions(artifacts: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(next table, pruned rows): like mark_latest, but deleted rows take no rank."""
    standing = ~F.col("local_status").eqNullSafe("deleted")
    rows = artifacts.join(_newest(artifacts.where(standing), n), REV, "left")
    kept = F.col("_rank").isNotNull()
    after = rows.withColumns({
        "local_status": F.when(kept, F.coalesce("local_status", F.lit("present"))).otherwise("deleted"),
        "is_latest": F.coalesce(F.col("_rank") == 1, F.lit(False))}).select(*artifacts.columns)
    return after, rows.where(standing & ~kept).select(*artifacts.columns)


def retire_previous(latest: DataFrame, bundles: DataFrame, mode: str, now: str, export_root: str = "",
                    root: str = "export") -> DataFrame:
    """What happens to the previous export of each bundle (KEY, title, revision): a move / delete manifest.

    Rows: the artifact's new state plus `action`, `from_path`, `to_path`.
    """
    if mode not in HISTORY_MODES:
        mode = "recycle_previous"
    c = F.col
    nxt = bundles.select(*KEY, c("revision").alias("_next"), c("title").alias("_title"))
    rows = latest.join(nxt, KEY).where(c("_next") != c("revision"))

    def folder(name: str) -> Column:
        path = F.replace(c(name), F.lit("/"), F.lit("\\"))
        return F.when(F.instr(path, "\\") > 0, F.regexp_extract(path, r"(?s)^(.*)\\", 1))

    rows = rows.withColumn("from_path", F.coalesce(folder("markdown_filename"), folder("bundle_filename")))
    rows = rows.where(c("from_path").isNotNull())
    if mode != "archive_then_recycle":
        out = rows.withColumns({"local_status": F.lit("deleted"), "action": F.lit("delete"),
                                "to_path": F.lit(None).cast("string"), "archived_at": F.lit(None).cast("string")})
        return out.drop("_next", "_title")
    at = F.instr(F.lower("from_path"), f"\\{root.lower()}\\")
    base = F.when(at > 0, F.substring("from_path", F.lit(1), at - 1)).otherwise(F.lit(export_root))
    target = F.concat_ws("\\", F.regexp_replace(base, r"[\\/]+\z", ""), F.replace(
        tx.archived_revision_prefix(c("platform"), c("_title"), c("source_id"), c("revision"), root),
        F.lit("/"), F.lit("\\")))
    rows = rows.withColumn("to_path", F.regexp_replace(target, r"^\\+", ""))

    def moved(name: str) -> Column:
        return F.concat(c("to_path"), F.lit("\\"), F.regexp_extract(c(name), r"([^/\\]*)\z", 1))

    return rows.withColumns({
        "markdown_filename": moved("markdown_filename"), "bundle_filename": moved("bundle_filename"),
        "local_status": F.lit("archived"), "archived_at": F.lit(now), "is_latest": F.lit(False),
        "action": F.lit("move")}).drop("_next", "_title")


def apply_persist(artifacts: DataFrame, results: DataFrame, mode: str, retired: DataFrame | None = None) -> DataFrame:
    """The table after a batch of exports (one result row per KEY, in the table's columns)."""
    c = F.col
    rows = artifacts.join(results.select(*KEY, c("revision").alias("_new")), KEY, "left")
    touched = c("_new").isNotNull()
    other = touched & (c("revision") != c("_new"))
    keeps = (c("local_status") == "archived") if mode == "archive_then_recycle" else F.lit(False)
    status = F.when(other, F.when(keeps, "archived").otherwise("deleted")).otherwise(c("local_status"))
    changes = {"local_status": status, "is_latest": F.when(touched, ~other).otherwise(c("is_latest"))}
    if retired is not None:
        names = ["local_status", "markdown_filename", "bundle_filename"]
        patch = retired.select(*REV, F.lit(True).alias("_hit"), *[c(n).alias(f"_{n}") for n in names])
        rows = rows.join(patch, REV, "left")
        changes["local_status"] = F.when(c("_hit"), c("_local_status")).otherwise(status)
        for n in names[1:]:
            changes[n] = F.when(c("_hit"), c(f"_{n}")).otherwise(c(n))
    return upsert_artifacts(rows.withColumns(changes).select(*artifacts.columns),
                            results.withColumn("is_latest", F.lit(True)).select(*artifacts.columns))


def prune_archive(files: DataFrame, days: int, now: str) -> DataFrame:
    """Files at least max(1, days) old by modification time."""
    return files.where(epoch_ms(F.lit(now)) - epoch_ms(F.col("mtime")) >= max(1, days) * DAY_MS)


def comparable_path(path: Column) -> Column:
    return F.lower(F.rtrim(F.replace(path, F.lit("/"), F.lit("\\")), F.lit("\\")))


def _listing(files: DataFrame) -> DataFrame:
    return files.select(comparable_path(F.col("path")).alias("_path")).distinct().withColumn("_hit", F.lit(True))


def _with_hit(rows: DataFrame, listing: DataFrame, path: Column, name: str) -> DataFrame:
    """Left join to the listing. Rows without a path get a key of their own, so they do not pile up in one task."""
    own = F.concat(F.lit("\u0000"), F.xxhash64(*[F.col(x) for x in rows.columns if x in REV]).cast("string"))
    keyed = rows.withColumn("_key", F.coalesce(tx.blank_to_null(comparable_path(path)), own))
    hits = listing.withColumnsRenamed({"_path": "_key", "_hit": name})
    return keyed.join(hits, "_key", "left").drop("_key").withColumn(name, F.coalesce(name, F.lit(False)))


def verify_presence(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """Live artifacts checked against the listing: `present`, `local_status` and `is_latest` follow.

    `was_latest` keeps the flag from before the check; archived and deleted rows pass unchanged.
    """
    c = F.col
    listing = _listing(files)
    rows = _with_hit(artifacts, listing, c("markdown_filename"), "_md")
    rows = _with_hit(rows, listing, c("bundle_filename"), "_bundle")
    check = _presence(c("_md"), c("_bundle"))
    rows = rows.withColumns({"present": check["present"], "was_latest": _flagged(), "_status": check["status"]})
    return rows.withColumns({
        "local_status": c("_status"),
        "is_latest": F.when(c("present") == F.lit(False), False).otherwise(c("is_latest"))}).drop("_md", "_bundle", "_status")


def verify_targets(candidates: DataFrame, files: DataFrame, root: str | None, markdown: bool = True,
                   bundle: bool = True) -> DataFrame:
    """Candidates (…, markdown_path, bundle_path relative to ``root``) with `present`; no root counts as present."""
    if not root:
        return candidates.withColumn("present", F.lit(True))
    base = root.rstrip("\\/") + "\\"
    rows, listing, present = candidates, _listing(files), F.lit(True)
    for wanted, name, hit in ((markdown, "markdown_path", "_md"), (bundle, "bundle_path", "_bundle")):
        if wanted:
            rows = _with_hit(rows, listing, F.concat(F.lit(base), F.col(name)), hit)
            present = present & F.col(hit)
    return rows.withColumn("present", present).drop("_md", "_bundle")


def _event_from_index(index: DataFrame) -> DataFrame:
    return index.select(*KEY, "url", "title", F.col("latest_source_updated_at").alias("source_updated_at"),
                        F.col("latest_source_updated_label").alias("source_updated_label"),
                        F.col("latest_discovery_fingerprint").alias("revision_fingerprint"))


def missing_latest(verified: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, requeue events): a missing artifact that was the latest sends its conversation back to pending."""
    gone = verified.where(~F.col("present")).select(*KEY, "revision", "was_latest")
    hits = (gone.join(index.select(*KEY, "latest_export_revision"), KEY)
            .where(F.col("was_latest") | (F.col("latest_export_revision") == F.col("revision")))
            .select(*KEY).distinct().withColumn("_pending", F.lit(True)))
    after = index.join(hits, KEY, "left").withColumn(
        "export_state", F.when(F.col("_pending"), "pending").otherwise(F.col("export_state"))).select(*index.columns)
    return after, _event_from_index(index.join(hits, KEY, "left_semi"))


def mark_export_pending(index: DataFrame, keys: DataFrame) -> DataFrame:
    hit = keys.select(*KEY).distinct().withColumn("_hit", F.lit(True))
    return index.join(hit, KEY, "left").withColumn(
        "export_state", F.when(F.col("_hit"), "pending").otherwise(F.col("export_state"))).select(*index.columns)


RESULT_FIELDS = ("title", "prompt", "url", "source_updated_at", "revision", "export_state", "export_version")


def _settled_index(rows: DataFrame, columns: list[str], now: Column) -> DataFrame:
    """Index rows after the export results beside them (`_title`, `_prompt`, …; `_hit` marks a row with one)."""
    c = F.col
    rows = with_titles(rows, "title", "_title", "_prompt")
    hit, done = c("_hit"), c("_export_state") == "exported"

    def when_hit(value: Column, name: str) -> Column:
        return F.when(hit, value).otherwise(c(name))

    return rows.withColumns({
        "title": when_hit(c("final_title"), "title"), "url": when_hit(c("_url"), "url"),
        "latest_source_updated_at": F.coalesce("_source_updated_at", "latest_source_updated_at"),
        "latest_export_revision": F.when(done, c("_revision")).otherwise(c("latest_export_revision")),
        "latest_export_version": F.when(done, F.coalesce("_export_version", "latest_export_version"))
        .otherwise(c("latest_export_version")),
        "export_state": when_hit(c("_export_state"), "export_state"),
        "last_seen_at": when_hit(now, "last_seen_at")}).select(*columns)


def mark_export_result(index: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """``results``: one row per KEY with title, prompt, url, source_updated_at, revision, export_state, export_version."""
    new = results.select(*KEY, *[F.col(x).alias(f"_{x}") for x in RESULT_FIELDS], F.lit(True).alias("_hit"))
    return _settled_index(index.join(new, KEY, "left"), index.columns, F.lit(now))


def record_manual_export(index: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """Manual and forced exports: the index entry is upserted with the revision as its fingerprint, then settled."""
    c = F.col
    events = with_titles(results).select(*KEY, "url", c("final_title").alias("title"), "source_updated_at",
                            F.lit(None).cast("string").alias("source_updated_label"),
                            c("revision").alias("revision_fingerprint"))
    return mark_export_result(upsert_index(index, events, "complete", now), results, now)


def _on_disk(disk: DataFrame, platforms: Sequence[str]) -> DataFrame:
    """Bundle files with the path of their document and their `final_title`."""
    rows = with_titles(disk.where(F.col("platform").isin(*platforms))).drop("used_fallback", "unresolved")
    return rows.withColumn("markdown_filename", F.regexp_replace("file_path", r"(?i)\.bundle\.json\z", ".md"))


def _wanted(rows: DataFrame, paths: dict[str, str], file_path: Column) -> DataFrame:
    """(REV, tag, file_path, _path): the paths that rows wait for, blank ones apart."""
    each = F.explode(F.array(*[F.struct(F.lit(tag).alias("tag"), F.col(name).alias("path")) for tag, name in paths.items()]))
    return (rows.select(*REV, file_path.alias("file_path"), each.alias("w"))
            .select(*REV, "w.tag", "file_path", tx.blank_to_null(comparable_path(F.col("w.path"))).alias("_path"))
            .where("_path is not null"))


def revisions_on_disk(artifacts: DataFrame, disk: DataFrame, files: DataFrame) -> DataFrame:
    """One row a revision of the artifact table, of the bundle files on disk, or of both.

    All paths waited for meet the listing in one join; then artifacts, bundle files and the paths found are one tagged
    union with one grouping. Columns: REV, `art` and `file` (structs of the two tables' columns, the last file in path
    order), `has_markdown`, `has_bundle` (of the artifact), `file_present` (the last file's document is there), `lacks` (some
    file's is not), and `title`, `at`, `label`: the last that is not NULL with its file's path.
    """
    c = F.col
    wanted = _wanted(artifacts, {"md": "markdown_filename", "bundle": "bundle_filename"}, F.lit(None).cast("string")).unionByName(
        _wanted(disk, {"file": "markdown_filename"}, c("file_path")))
    found = wanted.join(_listing(files).select("_path"), "_path", "left_semi").select(*REV, "tag", "file_path")
    own = [x for x in artifacts.columns if x not in REV]
    held = [x for x in disk.columns if x not in REV]
    kinds = {"art": artifacts.select(F.struct(*own)).schema[0].dataType, "file": disk.select(F.struct(*held)).schema[0].dataType}
    none = {"tag": F.lit(None).cast("string"), "file_path": F.lit(None).cast("string"), **{
        n: F.lit(None).cast(kind) for n, kind in kinds.items()}}

    def tagged(rows: DataFrame, **given: Column) -> DataFrame:
        return rows.select(*REV, *[given.get(n, none[n]).alias(n) for n in none])

    rows = (tagged(artifacts, art=F.struct(*own)).unionByName(tagged(disk, file=F.struct(*held)))
            .unionByName(tagged(found, tag=c("tag"), file_path=c("file_path"))))
    path = c("file.file_path")

    def last(value: Column) -> Column:
        return F.max(F.when(value.isNotNull(), F.struct(path.alias("path"), value.alias("value"))))

    # Hardly a revision has several rows of a kind, so nothing is gained by combining wide rows before the shuffle, which
    # would sort them once more.
    return rows.repartition(*REV).groupBy(*REV).agg(
        F.max_by("art", F.when(c("art").isNotNull(), -c("art.pos"))).alias("art"),
        F.max_by("file", F.when(c("file").isNotNull(), path)).alias("file"),
        F.coalesce(F.bool_or(c("tag") == "md"), F.lit(False)).alias("has_markdown"),
        F.coalesce(F.bool_or(c("tag") == "bundle"), F.lit(False)).alias("has_bundle"),
        F.max(path).eqNullSafe(F.max(F.when(c("tag") == "file", c("file_path")))).alias("file_present"),
        (F.count("file") > F.count_if(c("tag") == "file")).alias("lacks"),
        last(c("file.final_title")).alias("title"), last(c("file.source_updated_at")).alias("at"),
        last(c("file.source_updated_label")).alias("label"))


def _presence(has_markdown: Column, has_bundle: Column) -> dict[str, Column]:
    """`present` (NULL for rows that are not live) and the status after the check, of the columns of an artifact."""
    c = F.col
    needs_md = (F.coalesce("markdown_filename", F.lit("")) != "") | c("markdown_download_id").isNotNull()
    needs_bundle = (F.coalesce("bundle_filename", F.lit("")) != "") | c("bundle_download_id").isNotNull()
    present = F.when(_live(), (needs_md | needs_bundle) & (~needs_md | has_markdown) & (~needs_bundle | has_bundle))
    there = F.when(c("local_status") == "skipped_existing", "skipped_existing").otherwise("present")
    return {"present": present, "status": F.when(present.isNull(), c("local_status")).when(present, there).otherwise("missing")}


def _imported(table: DataFrame, columns: list[str]) -> DataFrame:
    """Artifact rows (with `imported`) of `revisions_on_disk`, after the check: a file on disk replaces the entry."""
    c = F.col
    of_file = c("file").isNotNull()
    none = F.lit(None).cast("bigint")
    new = {"markdown_download_id": none, "bundle_download_id": none, "markdown_filename": c("file.markdown_filename"),
           "bundle_filename": c("file.file_path"), "exported_at": c("file.extracted_at"),
           "local_status": F.when(c("file_present"), "present").otherwise("missing"), "is_latest": F.lit(True)}
    old = {**{n: c(f"art.{n}") for n in columns if n not in REV}, "local_status": c("status"),
           "is_latest": F.when(c("present") == F.lit(False), False).otherwise(c("art.is_latest"))}
    made = {n: F.when(of_file, new[n]).otherwise(old[n]) if n in new else old[n] for n in old}
    made["pos"] = F.coalesce("art.pos", -F.abs(F.xxhash64(*REV)) - 1)
    return table.select(*REV, *[x.alias(n) for n, x in made.items()], c("art").isNull().alias("imported"))


LAST_FIELDS = ("url", "title", "prompt", "extracted_at", "source_updated_at", "export_version")


def _by_key(table: DataFrame) -> DataFrame:
    """One row a conversation with files on disk: its last file, and its event with each field's last value."""
    c = F.col
    rows = table.where("file is not null").groupBy(*KEY).agg(
        F.max_by(F.struct(F.struct(*[f"file.{n}" for n in LAST_FIELDS]).alias("file"), "revision", c("file_present").alias("md_present")),
                 c("file.file_path")).alias("last"),
        *[F.max(n).alias(n) for n in ("title", "at", "label")])
    fingerprint = ids.discovery_fingerprint(c("platform"), c("source_id"), c("last.file.source_updated_at"))
    return rows.select(
        *KEY, "last.md_present", c("last.revision").alias("revision"), c("last.file").alias("file"), c("last.file.url").alias("url"),
        c("title.value").alias("title"), c("at.value").alias("source_updated_at"), c("label.value").alias("source_updated_label"),
        fingerprint.alias("revision_fingerprint"))


def _index_after(index: DataFrame, by_key: DataFrame) -> DataFrame:
    """The index after the files on disk: their events and their export results in one join."""
    c = F.col
    given = by_key.select(
        *KEY, *[c(f).alias(f"e_{f}") for f in EVENT_FIELDS], F.lit(True).alias("e_hit"), c("file.extracted_at").alias("_now"),
        c("file.title").alias("_title"), c("file.prompt").alias("_prompt"), c("file.url").alias("_url"),
        c("file.source_updated_at").alias("_source_updated_at"), c("revision").alias("_revision"),
        F.when(c("md_present"), "exported").otherwise("pending").alias("_export_state"),
        c("file.export_version").alias("_export_version"), F.lit(True).alias("_hit"))
    rows = upserted(index.join(given, KEY, "full"), index.columns, True, c("_now"))
    return _settled_index(rows, index.columns, F.coalesce("_now", "last_seen_at"))


def _event_rows(by_key: DataFrame) -> DataFrame:
    return by_key.where("not md_present").select(*KEY, *EVENT_FIELDS)


def import_bundles(disk: DataFrame, artifacts: DataFrame, index: DataFrame, files: DataFrame,
                   platforms: Sequence[str] = PLATFORMS) -> dict[str, DataFrame]:
    """Artifacts and index entries for the bundle files on disk; the artifact table has been checked before.

    ``disk``: KEY, revision, url, title, prompt, extracted_at, source_updated_at, source_updated_label,
    export_version, file_path. Several files of one conversation apply in path order.
    """
    rows = revisions_on_disk(artifacts, _on_disk(disk, platforms), files)
    rows = rows.withColumns({"present": F.lit(None).cast("boolean"), "status": F.col("art.local_status")})
    by_key = _by_key(rows)
    return {"artifacts": _imported(rows, artifacts.columns), "index": _index_after(index, by_key), "requeue": _event_rows(by_key),
            "found": by_key.where("md_present").select(*KEY), "missing": rows.where("lacks").select(*REV)}


def recompute_latest(artifacts: DataFrame, platforms: Sequence[str] = PLATFORMS) -> DataFrame:
    """Flag the newest live export per KEY (no date counts as the oldest; the first row wins ties).

    Rows with `imported` set have no place of their own: they come after the others of their time, by revision.
    """
    scope = F.col("platform").isin(*platforms)
    new = F.coalesce("imported", F.lit(False)) if "imported" in artifacts.columns else F.lit(False)
    rank = F.struct((-F.coalesce(epoch_ms(F.col("exported_at")), F.lit(0))).alias("t"), new.alias("new"),
                    F.when(~new, F.col("pos")).alias("pos"), F.col("revision"))
    best = artifacts.where(scope & _live()).groupBy(*KEY).agg(F.min_by("revision", rank).alias("_best"))
    flag = F.coalesce(F.col("_best") == F.col("revision"), F.lit(False))
    return artifacts.join(best, KEY, "left").withColumn(
        "is_latest", F.when(scope, flag).otherwise(F.col("is_latest"))).select(*artifacts.columns)


def final_requeue(requeue: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Requeue events whose conversation has no latest artifact that is still there."""
    held = artifacts.where(_flagged() & ~F.col("local_status").eqNullSafe("missing")).select(*KEY)
    return requeue.join(held, KEY, "left_anti")


def reconcile(artifacts: DataFrame, index: DataFrame, disk: DataFrame, files: DataFrame,
              platforms: Sequence[str] = PLATFORMS) -> dict[str, DataFrame]:
    """artifacts, index, requeue and a one-row summary (verified, missing, imported).

    Everything follows from one written table with a row a revision: one shuffle by path and one by revision make it. Nothing else
    is written, and what is not asked for does not run.
    """
    c = F.col
    scope = c("platform").isin(*platforms)
    inside = artifacts.where(scope)
    rows = revisions_on_disk(inside, _on_disk(disk, platforms), files)
    fields = [x for x in artifacts.columns if x not in REV]
    # The check reads an artifact's own columns; they stand beside the structs while it is made.
    judged = rows.select("*", *[c(f"art.{n}").alias(n) for n in fields])
    check = _presence(c("has_markdown"), c("has_bundle"))
    checked = cut_lineage(judged.select(*rows.columns, F.when(c("art").isNotNull(), check["present"]).alias("present"),
                                        check["status"].alias("status"), _flagged().alias("was_latest")))
    by_key = _by_key(checked)
    pending, requeue = missing_latest(checked.where("present is not null"), index)
    table = _imported(checked, artifacts.columns)
    whole = table.unionByName(artifacts.where(~scope).withColumn("imported", F.lit(False)).select(*table.columns))
    latest = recompute_latest(whole, platforms)
    # A bundle on disk decides for its conversation, after the check of the table.
    events = requeue.join(by_key.select(*KEY), KEY, "left_anti").unionByName(_event_rows(by_key).select(*requeue.columns))
    gone = (c("present") == F.lit(False)) | c("lacks")
    summary = checked.agg(F.count("present").alias("verified"), F.count_if(gone).alias("missing"),
                          F.count_if(c("art").isNull()).alias("imported"))
    return {"artifacts": latest.select(*artifacts.columns), "index": _index_after(pending, by_key),
            "requeue": final_requeue(events, latest), "summary": summary}


def clear_platform(tables: dict[str, DataFrame], platform: str, desired_running: bool) -> dict[str, DataFrame]:
    """Every table without the platform's rows; its service row is reset instead."""
    out = {}
    for name, table in tables.items():
        if name != "services":
            out[name] = table.where(F.col("platform") != platform)
            continue
        mine = F.col("platform") == platform
        reset = {"desired_running": F.lit(desired_running), "active_workers": F.lit(0), "active_discovery_tabs": F.lit(0),
                 "status": F.lit("starting" if desired_running else "paused"),
                 **{n: F.lit(None).cast("string") for n in (
                     "last_discovery_at", "last_export_at", "next_planned_run_at", "last_error")}}
        out[name] = table.withColumns({n: F.when(mine, value).otherwise(F.col(n))
                                       for n, value in reset.items() if n in table.columns})
    return out


def sync_due(last_completed_at: str | None, queue: DataFrame, now: str, workers: DataFrame | None = None) -> DataFrame:
    """One row: `interval_due` (seven days, or no date), `idle` (nothing pending, processing or leased), `due`."""
    last = epoch_ms(F.lit(last_completed_at).cast("string"))
    interval = F.coalesce(epoch_ms(F.lit(now)) - last >= 7 * DAY_MS, F.lit(True))
    busy = queue.agg(F.count_if(F.col("status").isin("pending", "processing")).alias("busy"))
    if workers is not None:
        busy = busy.unionByName(workers.agg(F.count(F.lit(1)).alias("busy"))).agg(F.sum("busy").alias("busy"))
    idle = F.col("busy") == 0
    return busy.select(interval.alias("interval_due"), idle.alias("idle"), (interval & idle).alias("due"))
