"""Embedded and linked files of conversations.

Links are exploded without their texts, matched on keys, and come back to a message as that
message's own small map; the bodies are rewritten row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import identity as ids
from parley.functions.markdown import CLOSE, OPEN
from parley.functions.text import (
    SPACE, blank_to_null, extension_from_mime, js_trim, mime_from_filename, path_segment,
)
from parley.operators import KEY
from parley.operators.conversations import resolve_titles
from parley.operators.ordered import index_in_order, ordered_texts
from parley.session import cut_lineage

c = F.col
IMAGE = rf'!\[([^\]]*)\]\(((?:(?!{SPACE})[^)])+(?:{SPACE}+"[^"]*")?)\)'
LINK = rf"> \[attachment\]{SPACE}+\[([^\]]+)\]\(([^)]+)\)"
RESOURCE = rf"(?m)> \[attachment\]{SPACE}+([^\n\r]+?):{SPACE}+((?:(?!{SPACE}).)+){SPACE}*$"
PLAIN = rf"(?m)> \[attachment\]{SPACE}+([^\n\r]+?)(?:{SPACE}+\(([^)]+)\))?{SPACE}*$"
DATA_URI = r"(?is)^data:(image/[a-z0-9.+-]+);base64,(.+)\z"
ROWS_PER_BUCKET = 10_000
#: Entries of a list that one group holds.
LISTED = 10_000


def image_target(raw: Column) -> Column:
    trimmed = js_trim(raw)
    return js_trim(F.when(F.instr(trimmed, ' "') > 0, F.substring_index(trimmed, ' "', 1)).otherwise(trimmed))


def _zip(md: Column, pattern: str) -> Column:
    return F.arrays_zip(*[F.regexp_extract_all(md, F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "label"), (2, "raw"))])


def _join_path(*parts: Column) -> Column:
    inked = F.filter(F.array(*[js_trim(p) for p in parts]), lambda p: p != "")
    return F.regexp_replace(F.array_join(inked, "/"), "/{2,}", "/")


def _candidates(messages: DataFrame) -> DataFrame:
    """(KEY, pos, phase, n, label, target, mime): links that become assets, in the order they are met."""
    images = F.transform(_zip(c("markdown"), IMAGE), lambda z, i: F.struct(
        F.lit(0).alias("phase"), i.alias("n"), z["label"].alias("label"), image_target(z["raw"]).alias("target")))
    files = F.transform(_zip(c("markdown"), LINK), lambda z, i: F.struct(
        F.lit(1).alias("phase"), i.alias("n"), z["label"].alias("label"), z["raw"].alias("target")))
    rows = messages.select(*KEY, "pos", F.explode(F.concat(images, files)).alias("l")).select(*KEY, "pos", "l.*")
    remote = c("target").rlike("(?i)^https?://")
    data = blank_to_null(F.regexp_extract("target", DATA_URI, 1))
    mime = F.when(c("phase") == 1, F.when(remote & ~c("target").rlike(r"(?i)^https://drive\.google\.com/"), "application/octet-stream")) \
        .otherwise(F.coalesce(data, F.when(remote, mime_from_filename(c("label")))))
    return rows.withColumn("mime", mime).where(c("mime").isNotNull())


def embedded_assets(messages: DataFrame, path_prefix: str = "assets") -> DataFrame:
    """One asset per distinct target of a conversation, numbered in first-seen order.

    (KEY, asset_no, target_hash, path, mime_type, source_url, content_base64); images are `NN-alt.ext`,
    linked files keep their title. Targets are grouped by digest: a data URI can be megabytes.
    """
    rows = _candidates(messages).withColumn("target_hash", F.sha2("target", 256))
    first = rows.groupBy(*KEY, "target_hash").agg(
        F.min_by(F.struct("pos", "phase", "n", "label", "target", "mime"), F.struct("pos", "phase", "n")).alias("_row"))
    first = first.select(*KEY, "target_hash", "_row.*")
    numbered = index_in_order(first, KEY, ["pos", "phase", "n"], F.floor(c("pos") / ROWS_PER_BUCKET), "asset_no")
    alt = path_segment(F.regexp_replace(js_trim(c("label")), r"(?i)\.[a-z0-9]+\z", ""))
    number = F.lpad(c("asset_no").cast("string"), F.greatest(F.lit(2), F.length(c("asset_no").cast("string"))), F.lit("0"))
    image = F.concat(number, F.lit("-"), F.coalesce(blank_to_null(alt), F.concat(F.lit("image-"), c("asset_no").cast("string"))),
                     F.lit("."), extension_from_mime(c("mime")))
    last = F.substring_index(F.element_at(F.split("target", "/"), -1), "?", 1)
    file = F.coalesce(blank_to_null(path_segment(c("label"))), blank_to_null(path_segment(last)), F.lit("attachment"))
    content = blank_to_null(F.regexp_extract("target", DATA_URI, 2))
    return numbered.select(
        *KEY, "asset_no", "target_hash", _join_path(F.lit(path_prefix), F.when(c("phase") == 0, image).otherwise(file)).alias("path"),
        c("mime").alias("mime_type"), F.when(content.isNull(), c("target")).alias("source_url"), content.alias("content_base64"))


def _with_map(messages: DataFrame, links: DataFrame, mapping: DataFrame) -> DataFrame:
    """Messages with `_map`: digest to replacement, of the links this message holds.

    ``links``: KEY, pos, target_hash. ``mapping``: KEY, target_hash, to.
    """
    own = (links.distinct().join(mapping.select(*KEY, "target_hash", "to"), [*KEY, "target_hash"])
           .groupBy(*KEY, "pos").agg(F.map_from_entries(F.collect_list(F.struct("target_hash", "to"))).alias("_map")))
    return messages.join(own, [*KEY, "pos"], "left")


def _rewrite(md: Column, pattern: str, target: Column | None, render) -> Column:
    """Pieces that match ``pattern`` become ``render(piece, replacement)`` where the map knows their target."""
    pieces = F.split(F.regexp_replace(md, pattern, OPEN + "$0" + CLOSE), f"[{OPEN}{CLOSE}]")

    def one(piece: Column) -> Column:
        to = F.try_element_at(c("_map"), F.sha2(target(piece), 256))
        return F.coalesce(render(piece, to), piece)

    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, one(p)).otherwise(p)), "")


def rewrite_asset_links(messages: DataFrame, assets: DataFrame) -> DataFrame:
    """Messages whose image and attachment targets point at the assets."""
    links = _candidates(messages).select(*KEY, "pos", F.sha2("target", 256).alias("target_hash"))
    rows = _with_map(messages, links, assets.withColumn("to", c("path")))

    def image(p: Column, to: Column) -> Column:
        return F.concat(F.lit("!["), F.regexp_extract(p, IMAGE, 1), F.lit("]("), to, F.lit(")"))

    def file(p: Column, to: Column) -> Column:
        kept = F.regexp_extract(p, LINK, 2).rlike(r"(?i)^https://drive\.google\.com/|^(?!https?://)")
        return F.when(~kept, F.concat(F.lit("> [attachment] ["), F.regexp_extract(p, LINK, 1), F.lit("]("), to, F.lit(")")))

    step = _rewrite(c("markdown"), IMAGE, lambda p: image_target(F.regexp_extract(p, IMAGE, 2)), image)
    rows = rows.withColumn("_step", F.when(c("_map").isNull(), c("markdown")).otherwise(step))
    step = _rewrite(c("_step"), LINK, lambda p: F.regexp_extract(p, LINK, 2), file)
    return rows.withColumn("markdown", F.when(c("_map").isNull(), c("markdown")).otherwise(step)).select(*messages.columns)


def restore_failed_assets(messages: DataFrame, assets: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, assets): links to failed assets (KEY, path, source_url) lead to their source again; their rows go."""
    known = failed.where(c("source_url").isNotNull())
    # Two files of one title share a path; the later one's source is taken.
    order = c("asset_no") if "asset_no" in failed.columns else c("source_url")
    mapping = known.groupBy(*KEY, F.sha2("path", 256).alias("target_hash")).agg(F.max_by("source_url", order).alias("to"))
    target = r"\]\(([^)]*)\)"
    links = messages.select(*KEY, "pos", F.explode(F.regexp_extract_all("markdown", F.lit(target), F.lit(1))).alias("t")).select(
        *KEY, "pos", F.sha2("t", 256).alias("target_hash"))
    rows = _with_map(messages, links, mapping)
    step = _rewrite(c("markdown"), target, lambda p: F.regexp_extract(p, target, 1),
                    lambda p, to: F.concat(F.lit("]("), to, F.lit(")")))
    restored = rows.withColumn("markdown", F.when(c("_map").isNull(), c("markdown")).otherwise(step)).select(*messages.columns)
    gone = known.select(*KEY, "path").distinct()
    return restored, assets.join(gone, [*KEY, "path"], "left_anti").select(*assets.columns)


ATTACHMENT_COLUMNS = ["message_id", "kind", "title", "mime_type", "source_url", "resource_id"]


def stored_attachments(bundles: DataFrame) -> DataFrame:
    """(KEY, n, message_id, kind, …): the `linkedAttachments` that bundles carry in their meta, in their order."""
    kind = ("array<struct<messageId: string, kind: string, title: string, mimeType: string, sourceUrl: string, "
            "resourceId: string>>")
    listed = F.try_variant_get(F.try_parse_json("meta"), "$.linkedAttachments", kind)
    return bundles.select(*KEY, F.posexplode(listed).alias("n", "a")).where(c("a").isNotNull()).select(
        *KEY, "n", c("a.messageId").alias("message_id"), "a.kind", "a.title", c("a.mimeType").alias("mime_type"),
        c("a.sourceUrl").alias("source_url"), c("a.resourceId").alias("resource_id"))


def linked_attachments(messages: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(KEY, seq, message_id, kind, title, mime_type, source_url, resource_id): attachment lines of all messages.

    Equal ones of a message count once. ``existing`` rows (`stored_attachments`) come before them; of those with one
    message, kind, url, resource and title the last wins, at the first's place. ``seq`` is a (pos, n) pair to sort by.
    """
    none = F.lit(None).cast("string")

    def shaped(pattern: str, kind: str, second: str) -> Column:
        def one(z: Column) -> Column:
            extra = blank_to_null(js_trim(z["raw"]))
            fields = {n: extra if n == second else none for n in ("mime_type", "source_url", "resource_id")}
            return F.struct(F.lit(kind).alias("kind"), blank_to_null(js_trim(z["label"])).alias("title"),
                            *[x.alias(n) for n, x in fields.items()])
        return F.transform(_zip(c("markdown"), pattern), one)

    plain = F.filter(shaped(PLAIN, "document", "mime_type"), lambda a: a["title"].isNotNull()
                     & ~a["title"].contains("](") & ~a["title"].contains(": "))
    found = F.concat(shaped(LINK, "document", "source_url"), shaped(RESOURCE, "resource", "resource_id"), plain)
    rows = messages.select(*KEY, "pos", c("id").alias("message_id"), F.posexplode(found).alias("n", "a")).select(
        *KEY, F.struct(c("pos").cast("bigint").alias("pos"), "n").alias("seq"), "message_id", "a.*")
    rows = rows.groupBy(*KEY, *ATTACHMENT_COLUMNS).agg(F.min("seq").alias("seq")).select(*KEY, "seq", *ATTACHMENT_COLUMNS)
    if existing is None:
        return rows
    same = ["message_id", "kind", *[F.coalesce(n, F.lit("")).alias(f"_{n}") for n in ("source_url", "resource_id", "title")]]
    kept = existing.groupBy(*KEY, *same).agg(F.max_by(F.struct(*ATTACHMENT_COLUMNS), "n").alias("a"), F.min("n").alias("n"))
    # Stored ones have no position: they come before the first message.
    before = F.struct(F.lit(None).cast("bigint").alias("pos"), "n").alias("seq")
    return kept.select(*KEY, before, "a.*").unionByName(rows)


def prepare_bundles(bundles: DataFrame, messages: DataFrame, exporter_version: str, preferred: DataFrame | None = None,
                    path_prefix: str = "assets", version: str = ids.HASH_VERSION) -> dict[str, DataFrame]:
    """bundles (final title, enriched meta), messages (asset paths), embedded_assets, linked_attachments.

    ``bundles`` carries `revision` and `meta`; attachments that the meta lists already are kept. Its lists are made in
    stretches of `LISTED` entries, so that no group holds more: the meta has the first stretch, which is all but for
    very long conversations, and `lists` (KEY, name, part, parts, items) has every stretch as JSON text.
    """
    # Each feeds several results, and the link patterns are dear: written once and read back.
    assets = cut_lineage(embedded_assets(messages, path_prefix))
    rewritten = cut_lineage(rewrite_asset_links(messages, assets))
    attachments = cut_lineage(linked_attachments(rewritten, stored_attachments(bundles)))
    titled = resolve_titles(bundles, rewritten, preferred)

    def listed(table: DataFrame, body: Column, name: str) -> DataFrame:
        """Stretches of a list; ``no`` numbers its entries from 1."""
        rows = table.withColumn("part", F.floor((c("no") - 1) / LISTED))
        made = rows.groupBy(*KEY, "part").agg(F.array_join(ordered_texts(c("no"), F.to_json(body)), ",").alias("items"))
        count = table.groupBy(*KEY).agg(F.ceil(F.count(F.lit(1)) / LISTED).alias("parts"))
        return made.join(count, KEY).select(*KEY, F.lit(name).alias("name"), "part", "parts",
                                            F.concat(F.lit("["), "items", F.lit("]")).alias("items"))

    asset = F.struct(c("path"), c("mime_type").alias("mimeType"), c("source_url").alias("sourceUrl"))
    link = F.struct(c("message_id").alias("messageId"), "kind", "title", c("mime_type").alias("mimeType"),
                    c("source_url").alias("sourceUrl"), c("resource_id").alias("resourceId"))
    numbered = index_in_order(attachments, KEY, ["seq"], F.coalesce(F.floor(c("seq.pos") / ROWS_PER_BUCKET), F.lit(-1)), "no")
    stretches = {"_assets": listed(assets.withColumn("no", c("asset_no")), asset, "embeddedAssets"),
                 "_links": listed(numbered, link, "linkedAttachments")}
    rows = titled
    for name, table in stretches.items():
        rows = rows.join(table.where("part = 0").select(*KEY, c("items").alias(name)), KEY, "left")
    label = [c("source_updated_label")] if "source_updated_label" in bundles.columns else []
    added = {
        "sourceUpdatedLabel": F.coalesce(*label, F.get_json_object("meta", "$.sourceUpdatedLabel")),
        "exporterVersion": F.lit(exporter_version), "exportCompatibilityVersion": F.lit(version),
        "exportSchemaVersion": F.lit(version), "revision": c("revision")}
    lists = {n: F.parse_json(F.coalesce(x, F.lit("[]"))) for n, x in (("embeddedAssets", "_assets"), ("linkedAttachments", "_links"))}
    fresh = F.map_from_entries(F.filter(F.array(*[
        F.struct(F.lit(n).alias("key"), x.alias("value"))
        for n, x in added.items()]), lambda m: m["value"].isNotNull()))
    fresh = F.transform_values(fresh, lambda _, x: x.cast("variant"))
    own = F.coalesce(F.try_variant_get(F.try_parse_json("meta"), "$", "map<string,variant>"),
                     F.create_map().cast("map<string,variant>"))
    own = F.map_filter(own, lambda k, _: ~k.isin(*added, *lists))
    listing = F.create_map(*[x for n, v in lists.items() for x in (F.lit(n), v)])
    meta = F.to_json(F.map_concat(own, fresh, listing))
    return {"bundles": rows.withColumn("meta", meta).drop("_assets", "_links"), "messages": rewritten,
            "embedded_assets": assets, "linked_attachments": attachments,
            "lists": stretches["_assets"].unionByName(stretches["_links"])}
