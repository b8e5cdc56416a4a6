"""The whole way of a capture: revision, title, document, archive tables, first page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import KEY, archive, conversations, rendering
from parley.plans.views import NOW, Views


def archive_first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    c = F.col
    bundles = (v.bundles_v.join(conversations.revise(v.bundles_v, v.messages_v), KEY)
               .join(conversations.participants(v.bundles_v, v.messages_v), KEY)
               .withColumn("meta", F.to_json(F.struct("model"))))
    titled = conversations.resolve_titles(bundles, v.messages_v)
    documents = rendering.serialize_conversations(titled, v.messages_v)
    counts = documents.where("part = 0").select(*KEY, "message_count", "estimated_tokens")
    batch = (titled.join(counts, KEY).withColumn("seq", F.unix_millis(c("extracted_at").try_cast("timestamp")))
             .withColumn("has_raw", F.lit(False)))
    empty = spark.createDataFrame([], "platform string, source_id string, title string, url string, latest_revision string, "
                                  "latest_source_updated_at string, created_at string, updated_at string, message_count bigint, "
                                  "file_bundle_json string, file_markdown string, file_raw_capture string")
    done = archive.ingest(batch, empty, spark.createDataFrame([], "platform string, source_id string, revision string"))
    return archive.to_record(archive.list_conversations(archive.upsert_conversations(empty, done, NOW)))
