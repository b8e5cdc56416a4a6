"""Keys, fingerprints, revisions and cursors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The version that enters every hash, and the one shown in rendered documents.
HASH_VERSION = "2026-04-15.2"
RENDER_VERSION = "2026-04-18.1"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def discovery_fingerprint(platform: Column, source_id: Column, updated_at: Column,
                          version: str = HASH_VERSION) -> Column:
    return F.sha2(F.concat_ws("::", F.lit(version), platform, source_id, _text(updated_at)), 256)


def message_line(id_: Column, role: Column, markdown: Column) -> Column:
    return F.concat(id_, F.lit(":"), role, F.lit(":"), markdown)


def revision_header(platform: Column, source_id: Column, url: Column, title: Column, updated_at: Column,
                    version: str = HASH_VERSION) -> Column:
    """Everything that is hashed before the message lines, with its trailing separator."""
    return F.concat_ws("::", F.lit(version), platform, source_id, url, _text(title), _text(updated_at), F.lit(""))


def bundle_revision(platform: Column, source_id: Column, url: Column, title: Column, updated_at: Column,
                    messages: Column, version: str = HASH_VERSION) -> Column:
    """Revision of a nested bundle row (messages in array order): no shuffle."""
    lines = F.transform(messages, lambda m: message_line(m["id"], m["role"], m["markdown"]))
    return F.sha2(F.concat(
        revision_header(platform, source_id, url, title, updated_at, version), F.array_join(lines, "\n")), 256)


def queue_key(platform: Column, source_id: Column, fingerprint: Column) -> Column:
    return F.concat_ws(":", platform, source_id, fingerprint)


def conversation_key(platform: Column, source_id: Column) -> Column:
    return F.concat_ws(":", platform, source_id)


def artifact_key(platform: Column, source_id: Column, revision: Column) -> Column:
    return F.to_json(F.array(platform, source_id, revision))


def encode_cursor(updated_at: Column, platform: Column, source_id: Column) -> Column:
    body = F.to_json(F.struct(updated_at.alias("updatedAt"), platform.alias("platform"),
                              source_id.alias("sourceId")))
    return F.rtrim(F.translate(F.base64(F.encode(body, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def decode_cursor(cursor: Column) -> Column:
    """struct<updatedAt, platform, sourceId>, NULL when the text is no cursor."""
    plain = F.translate(cursor, "-_", "+/")
    missing = ((F.lit(4) - F.length(plain) % 4) % 4).cast("int")
    raw = F.try_to_binary(F.concat(plain, F.repeat(F.lit("="), missing)), F.lit("base64"))
    body = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    parsed = F.from_json(body, "updatedAt string, platform string, sourceId string")
    return F.when(parsed["updatedAt"].isNotNull(), parsed)
