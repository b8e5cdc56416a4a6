"""Markdown documents from the messages table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import identity as ids
from parley.functions import text as tx
from parley.functions.markdown import code_blocks as blocks_of
from parley.functions.markdown import message_body
from parley.functions.times import format_message_timestamp
from parley.operators import KEY, settled
from parley.operators.ordered import ROWS_PER_PART, ordered_texts

EMPTY = "_(empty conversation)_"


def code_blocks(messages: DataFrame) -> DataFrame:
    """(KEY, pos, block_no, block): every fenced block."""
    return messages.select(*KEY, "pos", F.posexplode(blocks_of(F.col("markdown"))).alias("block_no", "block"))


def render_messages(messages: DataFrame, fmt: str = "full", preset: str = "complete", timestamps: bool = True,
                    zone: str = "UTC", **overrides: bool) -> DataFrame:
    """(KEY, pos, section); messages the format leaves empty are gone. Row-local: no shuffle.

    A `participant_names` column (map of role to name) is used for other roles when present.
    """
    c = F.col
    names = c("participant_names") if "participant_names" in messages.columns else None
    body = message_body(c("role"), c("markdown"), fmt, preset, **overrides)
    time = F.concat(F.lit("> "), format_message_timestamp(tx.blank_to_null(c("created_at")), zone))
    parts = [F.concat(F.lit("## "), tx.role_label(c("role"), names)), *([time] if timestamps else []), c("body")]
    return (settled(messages, "body", body).where(c("body").isNotNull())
            .select(*KEY, "pos", F.concat_ws("\n\n", *parts).alias("section")))


def frontmatter(count: Column, fmt: str, render_version: str, tool: str) -> Column:
    """The metadata block of a bundle row joined with its `revision` and `participants`."""
    c = F.col
    names = F.filter(F.transform(c("participants"), lambda p: tx.js_trim(p["name"])), lambda n: n != "")
    meta = _meta()
    line = F.concat
    fields = [
        F.lit("---"), F.lit(f"{tool}: v2"),
        line(F.lit("export_compatibility_version: "), tx.yaml_quote(F.lit(render_version))),
        line(F.lit("exporter_version: "), tx.yaml_quote(meta["exporter_version"])),
        line(F.lit("platform: "), c("platform")),
        line(F.lit("source_host: "), tx.yaml_quote(meta["source_host"])),
        line(F.lit("conversation_id: "), c("source_id")),
        line(F.lit("title: "), tx.yaml_quote(c("title"))),
        line(F.lit("assistant: "), tx.yaml_quote(_assistant())),
        line(F.lit("model: "), tx.yaml_quote(meta["model"])),
        line(F.lit("participants: "), tx.yaml_quote(F.array_join(names, ", "))),
        line(F.lit("tools: "), tx.yaml_quote(F.array_join(meta["tools"], ", "))),
        line(F.lit("source_url: "), tx.yaml_quote(c("url"))),
        line(F.lit("source_updated_at: "), tx.yaml_quote(c("source_updated_at"))),
        line(F.lit("source_updated_label: "), tx.yaml_quote(meta["source_updated_label"])),
        line(F.lit("exported_at: "), tx.yaml_quote(c("extracted_at"))),
        line(F.lit("message_count: "), count.cast("string")),
        line(F.lit("revision: "), c("revision")),
        F.lit(f"format: {fmt}"), F.lit("---"),
    ]
    return F.concat_ws("\n", *fields)


def conversation_header(count: Column, tokens: Column, render_version: str) -> Column:
    c, meta = F.col, _meta()

    def tagged(label: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"{label}: "), value))

    title = F.coalesce(tx.blank_to_null(tx.js_trim(c("title"))), c("source_id"))
    identity = F.concat_ws(" | ", tagged("Source", c("platform")), tagged("Conversation ID", c("source_id")),
                           tagged("Assistant", _assistant()), tagged("Host", meta["source_host"]))
    summary = F.concat_ws(" | ", F.concat(F.lit("Messages: "), count.cast("string")),
                          F.concat(F.lit("Tokens: "), tx.format_token_count(tokens)),
                          tagged("Model", meta["model"]), tagged("URL", c("url")))
    timeline = F.concat_ws(" | ", F.concat(F.lit("Exported: "), c("extracted_at")),
                           tagged("Updated", c("source_updated_at")),
                           tagged("Updated Label", meta["source_updated_label"]),
                           F.concat(F.lit("Revision: "), c("revision")), F.lit(f"Compatibility: {render_version}"))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title),
                       *[F.concat(F.lit("> "), x) for x in (identity, summary, timeline)])


def _meta() -> dict[str, Column]:
    meta = F.col("meta")
    fields = {"source_host": "sourceHost", "model": "model", "source_updated_label": "sourceUpdatedLabel",
              "exporter_version": "exporterVersion"}
    return {**{k: tx.meta_string(meta, v) for k, v in fields.items()}, "tools": tx.meta_strings(meta, "tools")}


def _assistant() -> Column:
    return F.get(F.filter("participants", lambda p: p["role"] == "assistant"), 0)["name"]


def serialize_conversations(bundles: DataFrame, messages: DataFrame, fmt: str = "full", preset: str = "complete",
                            timestamps: bool = True, include_frontmatter: bool = True, include_header: bool = True,
                            render_version: str = ids.RENDER_VERSION, tool: str = "archive",
                            rows_per_part: int = ROWS_PER_PART, zone: str = "UTC", **overrides: bool) -> DataFrame:
    """(KEY, part, parts, markdown, message_count, estimated_tokens).

    ``bundles`` carries `revision`, `participants` and `meta` (JSON text). A document is the texts of its rows in `part`
    order, one for each stretch of ``rows_per_part`` positions that has a section, so no row holds more than that. The
    two counts are those of the whole document and stand in its first row; they are NULL in the others.
    """
    sections = render_messages(messages, fmt, preset, timestamps, zone, **overrides).withColumn(
        "at", F.floor(F.col("pos") / rows_per_part))
    texts = sections.groupBy(*KEY, "at").agg(
        F.array_join(ordered_texts(F.col("pos"), F.col("section")), "\n\n").alias("body"))
    # One small row a part: the counts of the whole document, and the part's place in it.
    sizes = sections.groupBy(*KEY, "at").agg(
        F.count(F.lit(1)).alias("part_n"), F.sum(F.length(tx.collapse(F.col("section")))).alias("part_chars"))
    document = W.partitionBy(*KEY)
    facts = sizes.select(*KEY, "at", (F.row_number().over(document.orderBy("at")) - 1).alias("part"),
                         F.count(F.lit(1)).over(document).cast("int").alias("parts"),
                         F.sum("part_n").over(document).alias("n"), F.sum("part_chars").over(document).alias("chars"))
    rows = bundles.join(facts, KEY, "left").join(texts, [*KEY, "at"], "left").withColumns(
        {"part": F.coalesce("part", F.lit(0)), "parts": F.coalesce("parts", F.lit(1))})
    count = F.coalesce("n", F.lit(0))
    body = F.coalesce("body", F.lit(EMPTY))
    # Sections begin and end in ink, so the collapsed body is the collapsed sections plus one blank between each two.
    chars = F.coalesce(F.col("chars") + F.col("n") - 1, F.lit(len(EMPTY)))
    tokens = F.ceil(chars / F.lit(4))
    head = [frontmatter(count, fmt, render_version, tool)] if include_frontmatter else []
    head += [conversation_header(count, tokens, render_version)] if include_header else []
    top = F.concat_ws("\n\n", *head) if head else F.lit("")
    rows = rows.withColumn("top", top)
    lead = F.when((F.col("part") == 0) & (F.col("top") != ""), F.concat("top", F.lit("\n\n"))).otherwise("")
    tail = F.when(F.col("part") == F.col("parts") - 1, "\n").otherwise("\n\n")
    top_chars = F.length(tx.collapse(F.col("top")))
    total = chars + F.when(top_chars > 0, top_chars + 1).otherwise(0)
    return rows.select(
        *KEY, "part", "parts", F.concat(lead, body, tail).alias("markdown"),
        F.when(F.col("part") == 0, count).alias("message_count"),
        F.when(F.col("part") == 0, F.ceil(total / F.lit(4)).cast("bigint")).alias("estimated_tokens"))
