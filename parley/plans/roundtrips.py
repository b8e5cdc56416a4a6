"""Files written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parley.operators import KEY
from parley.plans import duck as d
from parley.plans.catalog import query
from parley.plans.views import NOW
from parley.session import checkpoint_dir
from parley.sources import files

c = F.col


def _folder(v) -> str:
    return f"{checkpoint_dir(v.spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _stored(v):
    """Bundles with their messages, a revision, and a raw payload for every second one."""
    message = F.struct("id", "role", "markdown", F.lit(None).cast("string").alias("created_at"))
    listed = v.messages_v.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", message.alias("m")))).alias("l"))
    revision = F.concat(F.lit("r-"), "source_id")
    return v.bundles_v.join(listed, KEY).select(
        *KEY, "url", "title", "extracted_at", "source_updated_at", revision.alias("revision"),
        F.lit(None).cast("array<struct<id:string,role:string,name:string>>").alias("participants"),
        F.transform("l", lambda x: x["m"]).alias("messages"), F.to_json(F.struct(revision.alias("revision"))).alias("meta"),
        F.when(c("model").isNotNull(), F.to_json(F.struct("url"))).alias("raw_capture"))


_READ = """
    SELECT b.platform, b.source_id, b.url, b.title, b.extracted_at, b.source_updated_at, 'r-' || b.source_id AS revision,
           m.id, m.role, m.markdown FROM {bundles_v} AS b JOIN {messages_v} AS m ON b.platform = m.platform AND b.source_id = m.source_id"""


def _messages_of(bundles):
    revisions = files.disk_bundles(bundles).select(*KEY, "revision")
    return bundles.join(revisions, KEY).select(
        *KEY, "url", "title", "extracted_at", "source_updated_at", "revision", F.explode("messages").alias("m")).select(
        *KEY, "url", "title", "extracted_at", "source_updated_at", "revision", "m.id", "m.role", "m.markdown")


@query("read_bundles", _READ, heavy=True)
def read_bundles(v):
    """JSON bundle files, one bundle a line, through the file reader; files of other platforms lie beside them."""
    root, rows = _folder(v), _stored(v)
    files.bundle_files(rows).select("platform", "sourceId", "url", "title", "extractedAt", "sourceUpdatedAt", "participants",
                                    "messages", "meta").write.json(f"{root}/a/b")
    files.bundle_files(rows.withColumn("platform", F.lit("icq"))).select("platform", "sourceId", "url", "messages").write.json(f"{root}/c")
    return _messages_of(files.read_bundles(v.spark, root, glob="*.json", multi_line=False))


@query("write_bundle_json", _READ, heavy=True)
def write_bundle_json(v):
    root = _folder(v)
    files.write_bundle_json(_stored(v), root)
    return _messages_of(files.bundles_of(v.spark.read.parquet(f"{root}/bundles")))


@query("write_markdown", """
    SELECT platform, platform || '/' || source_id || '/r-' || source_id || '/conversation.md' AS path, CAST(pos AS INT) AS part, id || markdown AS markdown
    FROM {messages_v}""", heavy=True)
def write_markdown(v):
    """Documents in parts: here every message is a part."""
    root = _folder(v)
    parts = v.messages_v.select(*KEY, F.concat(F.lit("r-"), "source_id").alias("revision"), c("pos").cast("int").alias("part"),
                                F.lit(1).alias("parts"), F.concat("id", "markdown").alias("markdown"))
    files.write_markdown(parts, root)
    return v.spark.read.parquet(f"{root}/documents").select("platform", "path", "part", "markdown")


@query("write_raw_capture", """
    SELECT platform, platform || '/' || source_id || '/r-' || source_id || '/raw-capture.json' AS path, '{{"url":"' || url || '"}}' AS content
    FROM {bundles_v} WHERE model IS NOT NULL""")
def write_raw_capture(v):
    root = _folder(v)
    files.write_raw_capture(_stored(v), root)
    return v.spark.read.parquet(f"{root}/raw").select("platform", "path", "content")


@query("export_log_snapshot", f"""
    SELECT '{NOW}' AS exported_at, id, level, message, rk - 1 AS place FROM (SELECT *, row_number() OVER (ORDER BY timestamp DESC, id DESC) AS rk
      FROM {{logs_v}}) AS x WHERE rk <= 400""")
def export_log_snapshot(v):
    """The snapshot's logs in its order; logs of one time in any."""
    root = _folder(v)
    files.export_log_snapshot(v.logs_v, root, NOW, "1.0")
    back = v.spark.read.json(root)
    rows = back.select("exportedAt", F.posexplode("logs").alias("place", "log"))
    return rows.select(c("exportedAt").alias("exported_at"), "log.id", "log.level", "log.message", c("place").cast("bigint").alias("place"))


_BASE = (f"coalesce(nullif({d.segment(f'''left({d.gsub('coalesce(nullif(trim(title), chr(0)), source_id)', d.WS + '+', chr(39) + ' ' + chr(39))}, 80)''')}, ''), "
         f"{d.segment('source_id')})")


@query("export_selected", f"""
    SELECT p.platform, p.path, count(*) AS messages FROM (SELECT b.platform, b.source_id,
      'export/' || {d.segment('b.platform')} || '/' || {d.folder('b.title', 'b.source_id')} || '/' || {_BASE.replace('title', 'b.title').replace('source_id', 'b.source_id')}
      || '.bundle.json' AS path FROM {{bundles_v}} AS b) AS p JOIN {{messages_v}} AS m ON m.platform = p.platform AND m.source_id = p.source_id
    GROUP BY ALL""", heavy=True)
def export_selected(v):
    """Chosen bundles to files of their own names and back."""
    root, rows = _folder(v), _stored(v)
    parts = rows.select(*KEY, F.lit(0).alias("part"), F.lit(1).alias("parts"), c("url").alias("markdown"))
    files.export_selected(rows, parts, root)
    back = files.bundles_of(v.spark.read.parquet(f"{root}/bundles"))
    return back.select("platform", c("file_path").alias("path"), F.size("messages").cast("bigint").alias("messages"))
