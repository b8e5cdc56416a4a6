"""Bundle, document, raw-capture and log files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley import schemas
from parley.functions import text as tx
from parley.functions.identity import HASH_VERSION, bundle_revision
from parley.functions.urls import PLATFORMS
from parley.operators import KEY, analytics, settled
from parley.operators.archive import archive_paths
from parley.operators.payloads import _first_present, parse_discovery, v_array, v_get

c = F.col


def bundle_rows(raw: DataFrame) -> DataFrame:
    """Bundles in table names, message fields included."""
    rows = raw.withColumnsRenamed(schemas.BUNDLE_NAMES)
    return rows.withColumn("messages", F.transform("messages", lambda m: F.struct(
        m["id"].alias("id"), m["role"].alias("role"), m["markdown"].alias("markdown"), m["createdAt"].alias("created_at"))))


def bundle_files(bundles: DataFrame) -> DataFrame:
    """Bundles in the names of the JSON files."""
    rows = bundles.withColumnsRenamed({v: k for k, v in schemas.BUNDLE_NAMES.items()})
    return rows.withColumn("messages", F.transform("messages", lambda m: F.struct(
        m["id"].alias("id"), m["role"].alias("role"), m["markdown"].alias("markdown"), m["created_at"].alias("createdAt"))))


def read_bundles(spark: SparkSession, root: str, platforms: Sequence[str] = PLATFORMS, glob: str = "*.bundle.json",
                 multi_line: bool = True) -> DataFrame:
    """Bundle files below ``root`` with `file_path`. Files that are no bundle, or of another platform, are skipped."""
    raw = (spark.read.schema(schemas.BUNDLE).option("multiLine", multi_line).option("recursiveFileLookup", True)
           .option("pathGlobFilter", glob).json(root).withColumn("file_path", F.col("_metadata.file_path")))
    whole = c("sourceId").isNotNull() & c("url").isNotNull() & c("messages").isNotNull()
    return bundle_rows(raw.where(c("platform").isin(*platforms) & whole))


def bundles_of(rows: DataFrame, platforms: Sequence[str] = PLATFORMS) -> DataFrame:
    """Bundles of (path, content) rows, as `write_bundle_json` and `export_selected` write them, with `file_path`."""
    raw = rows.select(c("path").alias("file_path"), F.from_json("content", schemas.BUNDLE).alias("b")).select("b.*", "file_path")
    whole = c("sourceId").isNotNull() & c("url").isNotNull() & c("messages").isNotNull()
    return bundle_rows(raw.where(c("platform").isin(*platforms) & whole))


def disk_bundles(bundles: DataFrame) -> DataFrame:
    """Rows of `read_bundles` or `bundles_of` as the ``disk`` table of `artifacts.import_bundles` and `reconcile`.

    A stored `meta.revision` counts, else the revision is computed from the bundle; the versions are the stored ones; the
    prompt is the first text of the user.
    """
    meta = c("meta")
    computed = bundle_revision(c("platform"), c("source_id"), c("url"), c("title"), c("source_updated_at"), c("messages"))
    asked = F.filter("messages", lambda m: (m["role"] == "user") & (tx.js_trim(m["markdown"]) != ""))
    return bundles.select(
        *KEY, "file_path", F.coalesce(tx.meta_string(meta, "revision"), computed).alias("revision"), "url", "title",
        F.get(asked, 0)["markdown"].alias("prompt"), "extracted_at", "source_updated_at",
        tx.meta_string(meta, "sourceUpdatedLabel").alias("source_updated_label"),
        F.coalesce(tx.meta_string(meta, "exportCompatibilityVersion"), tx.meta_string(meta, "exportSchemaVersion"))
        .alias("export_version"))


def pretty_json() -> Column:
    """The text of a bundle file, from the columns of `bundle_files`."""
    return F.to_json(F.struct(*[c(n) for n in ("platform", "sourceId", "url", "title", "extractedAt", "sourceUpdatedAt",
                                               "participants", "messages")],
                              F.from_json("meta", "map<string,variant>").alias("meta")), {"pretty": "true"})


def write_bundle_json(bundles: DataFrame, root: str, mode: str = "append") -> None:
    """One row (path, content) per revision; `content` is the file's text. ``bundles`` carries `revision`."""
    paths = archive_paths(c("platform"), c("source_id"), c("revision"), F.lit(False))
    rows = bundle_files(bundles.withColumn("path", paths["bundle_json"]))
    rows.select("platform", "path", pretty_json().alias("content")).write.mode(mode).partitionBy("platform").parquet(f"{root}/bundles")


def write_markdown(documents: DataFrame, root: str, mode: str = "append") -> None:
    """(path, part, markdown) of rendered documents; parts of one document sort by `part`. Carries `revision`."""
    paths = archive_paths(c("platform"), c("source_id"), c("revision"), F.lit(False))
    documents.select("platform", paths["markdown"].alias("path"), "part", "parts", "markdown") \
        .write.mode(mode).partitionBy("platform").parquet(f"{root}/documents")


def write_raw_capture(bundles: DataFrame, root: str, mode: str = "append") -> None:
    """(path, content) of the raw payloads, only where there is one. Carries `revision` and `raw_capture`."""
    paths = archive_paths(c("platform"), c("source_id"), c("revision"), F.lit(True))
    bundles.where(c("raw_capture").isNotNull()).select(
        "platform", paths["raw_capture"].alias("path"), c("raw_capture").alias("content")) \
        .write.mode(mode).partitionBy("platform").parquet(f"{root}/raw")


def export_log_snapshot(logs: DataFrame, root: str, exported_at: str, exporter_version: str, retain: int = 400,
                        version: str = HASH_VERSION) -> None:
    """One JSON document of the retained logs; retention bounds it, as it bounds the log table itself."""
    kept = analytics.retain_logs(logs, retain)
    order = F.array_sort(F.collect_list(F.struct(F.struct(*logs.columns).alias("log"), c("timestamp").alias("at"))),
                         lambda a, b: F.when(a["at"] > b["at"], -1).when(a["at"] < b["at"], 1).otherwise(0))
    kept.agg(F.lit(exported_at).alias("exportedAt"), F.lit(exporter_version).alias("exporterVersion"),
             F.lit(version).alias("exportCompatibilityVersion"), F.count(F.lit(1)).alias("logCount"),
             F.transform(order, lambda r: r["log"]).alias("logs")).write.mode("overwrite").json(root)


def export_paths(bundles: DataFrame, flat: bool, root: str = "export") -> DataFrame:
    """Bundles (final title) with markdown_path, bundle_path and asset_prefix."""
    base = tx.artifact_base_name(c("title"), c("source_id"))
    prefix = F.lit("") if flat else F.concat(tx.archive_prefix(c("platform"), c("title"), c("source_id"), root), F.lit("/"))
    return bundles.withColumns({
        "markdown_path": F.concat(prefix, base, F.lit(".md")), "bundle_path": F.concat(prefix, base, F.lit(".bundle.json")),
        "asset_prefix": F.concat(prefix, F.concat(base, F.lit(".assets")) if flat else F.lit("assets"))})


def export_selected(bundles: DataFrame, documents: DataFrame, root: str, markdown: bool = True, bundle_json: bool = True,
                    flat: bool = False, mode: str = "append") -> DataFrame:
    """Write the chosen formats below ``root``; returns the paths. Choosing none is an error."""
    if not (markdown or bundle_json):
        raise ValueError("at least one export format must be selected")
    rows = export_paths(bundles, flat)
    if markdown:
        documents.join(rows.select(*KEY, c("markdown_path").alias("path")), KEY).select(
            "platform", "path", "part", "parts", "markdown").write.mode(mode).partitionBy("platform").parquet(f"{root}/documents")
    if bundle_json:
        files = bundle_files(rows.withColumn("path", c("bundle_path")))
        files.select("platform", "path", pretty_json().alias("content")) \
            .write.mode(mode).partitionBy("platform").parquet(f"{root}/bundles")
    return rows.select(*KEY, "markdown_path", "bundle_path", "asset_prefix")


def history_pages(pages: DataFrame, platform: str) -> tuple[DataFrame, DataFrame]:
    """(events, page facts) of landed list pages (page, payload).

    Page facts: `has_more`, `next_cursor`, and `ends`: reading stops here (no cursor, or one seen on an earlier page).
    """
    v = F.try_parse_json("payload")
    if platform == "deepseek":
        sessions = v_array(v, "$.data.biz_data.chat_sessions")
        last = F.get(sessions, F.size(sessions) - 1)
        cursor = _first_present(last, "$.updated_at").cast("string")
        more = F.coalesce(F.try_variant_get(v, "$.data.biz_data.has_more", "boolean"), F.lit(False))
    else:
        cursor = tx.blank_to_null(v_get(v, "$[1]").try_cast("string"))
        more = cursor.isNotNull()
    facts = pages.select("page", more.alias("has_more"), cursor.alias("next_cursor"))
    first = facts.groupBy("next_cursor").agg(F.min("page").alias("_first"))
    facts = facts.join(first, "next_cursor", "left").select(
        "page", "has_more", "next_cursor", (c("next_cursor").isNull() | ~c("has_more") | (c("_first") < c("page"))).alias("ends"))
    # Later pages are read only up to the first one that ends the walk.
    stop = facts.where("ends").agg(F.min("page")).scalar()
    return parse_discovery(pages.where(c("page") <= F.coalesce(stop, c("page"))), platform), facts


def read_history_pages(spark: SparkSession, root: str, platform: str) -> tuple[DataFrame, DataFrame]:
    """Landed list pages, one JSON text per file; the file name orders them."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(root)
    pages = raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).cast("bigint").alias("page"),
                       c("value").alias("payload"))
    return history_pages(pages, platform)


DATETIME = r"^\d{4}-\d\d-\d\dT\d\d:\d\d(?::\d\d(?:\.\d+)?)?Z\z"


def read_ingest(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects) of request bodies (seq, body). Rejects name the first rule that fails."""
    rows = settled(bodies, "r", F.from_json("body", schemas.INGEST)).withColumn("b", c("r.bundle"))
    b = c("b")

    def blank(x: Column) -> Column:
        return F.coalesce(x, F.lit("")) == ""

    def undated(x: Column) -> Column:
        return x.isNotNull() & ~x.rlike(DATETIME)

    rules = {
        "bundle": b.isNull(),
        "bundle.platform": ~F.coalesce(b["platform"].isin(*PLATFORMS), F.lit(False)),
        "bundle.sourceId": blank(b["sourceId"]),
        "bundle.url": ~F.coalesce(b["url"].rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:[^\s]+\z"), F.lit(False)),
        "bundle.title": b["title"] == "",
        "bundle.extractedAt": b["extractedAt"].isNull() | undated(b["extractedAt"]),
        "bundle.sourceUpdatedAt": undated(b["sourceUpdatedAt"]),
        "bundle.participants": F.coalesce(F.size(b["participants"]) < 1, F.lit(True)) | F.exists(
            b["participants"], lambda p: blank(p["id"]) | blank(p["name"]) | ~F.coalesce(
                p["role"].isin("user", "assistant", "system"), F.lit(False))),
        "bundle.messages": b["messages"].isNull() | F.exists(
            b["messages"], lambda m: blank(m["id"]) | blank(m["role"]) | m["markdown"].isNull() | undated(m["createdAt"])),
        "bundle.meta": b["meta"].isNotNull() & ~b["meta"].startswith("{"),
        "rawCapture": c("r.rawCapture").isNotNull() & ~c("r.rawCapture").startswith("{"),
        "client": blank(c("r.client.extensionVersion")) | blank(c("r.client.browser")),
    }
    reason = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules.items()])
    judged = rows.withColumn("reason", reason)
    valid = judged.where(c("reason").isNull()).select("seq", "b.*", c("r.rawCapture").alias("raw_capture"))
    return bundle_rows(valid), judged.where(c("reason").isNotNull()).select("seq", "body", "reason")
