"""Facts about whole conversations, read off the messages table with partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import identity as ids
from parley.functions import text as tx
from parley.functions.text import IMAGE, js_trim
from parley.operators import KEY
from parley.operators.ordered import running_sha256

# Display name of the assistant on each platform.
ASSISTANT_NAMES = {"chatgpt": "ChatGPT", "deepseek": "DeepSeek", "gemini": "Gemini", "aistudio": "Google AI Studio"}
ROLE_NAMES = {"user": "User", "system": "System"}
# The texts of the notice a page without readable turns gets.
NOTICE = ("AI Studio conversation content was not fully accessible from the current DOM snapshot.",
          "Run settings metadata was exported for this prompt.")


def revise(bundles: DataFrame, messages: DataFrame, version: str = ids.HASH_VERSION) -> DataFrame:
    """Revision hash of every bundle from the messages table: (KEY, revision).

    A digest over the lines in order, which one task runs for each conversation in constant memory, whatever its size.
    """
    c = F.col
    head = bundles.select(*KEY, F.struct(F.lit(-1).cast("bigint").alias("pos"), F.lit(0).alias("more")).alias("ord"),
                          ids.revision_header(c("platform"), c("source_id"), c("url"), c("title"), c("source_updated_at"),
                                              version).alias("text"))
    at = F.struct(c("pos").cast("bigint").alias("pos"), F.lit(1).alias("more"))
    lines = messages.join(bundles.select(*KEY), KEY, "left_semi").select(
        *KEY, at.alias("ord"), ids.message_line(c("id"), c("role"), c("markdown")).alias("text")).where(c("text").isNotNull())
    return running_sha256(head.unionByName(lines), separator="\n")


def assistant_name(platform: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ASSISTANT_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, platform), F.lit("Assistant"))


def participants(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """(KEY, participants): one entry per role in first-seen order; the assistant alone when none speaks."""
    first = [F.min(F.when(F.col("role") == r, F.col("pos"))).alias(r) for r in ("user", "assistant", "system")]
    seen = conversations.select(*KEY).join(messages.groupBy(*KEY).agg(*first), KEY, "left")

    def entry(role: str) -> Column:
        name = assistant_name(F.col("platform")) if role == "assistant" else F.lit(ROLE_NAMES[role])
        return F.when(F.col(role).isNotNull(), F.struct(
            F.col(role).alias("at"), F.lit(role).alias("id"), F.lit(role).alias("role"), name.alias("name")))

    found = F.array_sort(F.array_compact(F.array(entry("user"), entry("assistant"), entry("system"))))
    shaped = F.transform(found, lambda p: F.struct(p["id"].alias("id"), p["role"].alias("role"), p["name"].alias("name")))
    alone = F.array(F.struct(F.lit("assistant").alias("id"), F.lit("assistant").alias("role"),
                             assistant_name(F.col("platform")).alias("name")))
    return seen.select(*KEY, F.when(F.size(shaped) > 0, shaped).otherwise(alone).alias("participants"))


def last_activity(messages: DataFrame, role: str | None = None) -> DataFrame:
    """(KEY, last_at): time of the last message; with ``role`` the last one of that role that has a time."""
    when = F.lit(True)
    if role is not None:
        when = (F.col("role") == role) & F.col("created_at").isNotNull()
    return messages.groupBy(*KEY).agg(
        F.max_by(F.when(when, F.col("created_at")), F.when(when, F.col("pos"))).alias("last_at"))


def reject_empty(conversations: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejects): a conversation without a usable message is a reject."""
    usable = messages.where(js_trim(F.col("markdown")) != "").select(*KEY)
    kept = conversations.join(usable, KEY, "left_semi")
    rejects = conversations.join(usable, KEY, "left_anti").withColumn("reason", F.lit("no usable messages"))
    return kept, rejects


def first_prompts(messages: DataFrame) -> DataFrame:
    """(KEY, prompt): body of the first user message."""
    return messages.where(F.col("role") == "user").groupBy(*KEY).agg(F.min_by("markdown", "pos").alias("prompt"))


def with_titles(rows: DataFrame, preferred: str | None = None, title: str = "title", prompt: str = "prompt") -> DataFrame:
    """Rows with `final_title`, `used_fallback` and `unresolved` from their title, prompt and preferred-title columns.

    The three candidates are columns of their own first, so each is computed once.
    """
    c = F.col
    better = tx.normalize_title(c(preferred), c("source_id")) if preferred else F.lit(None).cast("string")
    rows = rows.withColumns({"_own": tx.normalize_title(c(title), c("source_id")), "_better": better,
                             "_fallback": tx.prompt_title(c(prompt), c("source_id"))})
    wins = c("_better").isNotNull() & F.coalesce(c("_own").isNull() | (c("_own") == c("_fallback")), F.lit(False))
    return rows.withColumns({
        "final_title": F.when(wins, c("_better")).otherwise(F.coalesce("_own", "_fallback", "source_id")),
        "used_fallback": ~wins & c("_own").isNull() & c("_fallback").isNotNull(),
        "unresolved": ~wins & c("_own").isNull() & c("_fallback").isNull()}).drop("_own", "_better", "_fallback")


def resolve_titles(bundles: DataFrame, messages: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """Bundles with their final title. ``preferred``: (KEY, preferred_title)."""
    rows = bundles.join(first_prompts(messages), KEY, "left")
    if preferred is not None:
        rows = rows.join(preferred.select(*KEY, "preferred_title"), KEY, "left")
    made = with_titles(rows, "preferred_title" if preferred is not None else None)
    return made.withColumn("title", F.col("final_title")).select(*bundles.columns, "used_fallback", "unresolved")


def preferred_titles(bundles: DataFrame, messages: DataFrame, index: DataFrame, queue: DataFrame) -> DataFrame:
    """(KEY, preferred_title): newest usable queue title, unless it only repeats the prompt and the index knows better."""
    queued = queue.withColumn("usable", tx.normalize_title(F.col("title"), F.col("source_id")))
    queued = queued.where(F.col("usable").isNotNull()).groupBy(*KEY).agg(
        F.max_by("usable", F.struct(F.col("updated_at"), -F.col("pos"))).alias("queue_title"))
    indexed = index.select(*KEY, tx.normalize_title(F.col("title"), F.col("source_id")).alias("index_title"))
    rows = (bundles.select(*KEY).join(first_prompts(messages), KEY, "left")
            .join(queued, KEY, "left").join(indexed, KEY, "left"))
    repeats = F.col("queue_title") == tx.prompt_title(F.col("prompt"), F.col("source_id"))
    return rows.select(*KEY, F.when(repeats, F.coalesce("index_title", "queue_title"))
                       .otherwise(F.coalesce("queue_title", "index_title")).alias("preferred_title"))


def title_only(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations whose single message is a user message that repeats the title."""
    one = messages.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.first("role").alias("role"),
                                     F.first("markdown").alias("markdown")).where("n = 1 AND role = 'user'")
    rows = conversations.join(one, KEY)
    title = js_trim(F.coalesce(F.col("title"), F.lit("")))
    return rows.where((title != "") & (js_trim(F.col("markdown")) == title)).select(*conversations.columns)


def prompt_title_backfill(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages with a leading user message made from the title where no user speaks; a notice where nothing is."""
    c = F.col
    facts = messages.groupBy(*KEY).agg(
        F.min("pos").alias("first"), F.bool_or(c("role") == "user").alias("asked"))
    rows = conversations.select(*KEY, "title").join(facts, KEY, "left")
    titled = tx.blank_to_null(c("title")).isNotNull()
    made = {"created_at": F.lit(None).cast("string")}
    prompt = rows.where(titled & ~F.coalesce("asked", F.lit(False))).select(
        *KEY, (F.coalesce("first", F.lit(0)) - 1).alias("pos"),
        F.concat("source_id", F.lit("-prompt-title")).alias("id"), F.lit("user").alias("role"),
        c("title").alias("markdown")).withColumns(made)
    notice = rows.where(~titled & c("first").isNull()).select(
        *KEY, F.lit(0).cast("bigint").alias("pos"), F.concat("source_id", F.lit("-fallback")).alias("id"),
        F.lit("assistant").alias("role"), F.lit("\n\n".join(NOTICE)).alias("markdown")).withColumns(made)
    return messages.unionByName(prompt).unionByName(notice)


def images_in(md: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(md, F.lit(IMAGE), F.lit(0)))


def merge_images(api: DataFrame, dom: DataFrame) -> DataFrame:
    """API messages with the page's images they lack in front; `merged_images` counts them."""
    seen = dom.select(*KEY, "id", F.col("markdown").alias("dom_markdown"))
    rows = api.join(seen, [*KEY, "id"], "left")
    extra = F.coalesce(F.array_except(images_in(F.col("dom_markdown")), images_in(F.col("markdown"))),
                       F.array().cast("array<string>"))
    merged = js_trim(F.concat(F.array_join(extra, "\n\n"), F.lit("\n\n"), F.col("markdown")))
    return rows.withColumns({
        "markdown": F.when(F.size(extra) > 0, merged).otherwise(F.col("markdown")),
        "merged_images": F.size(extra).cast("bigint")}).drop("dom_markdown")


def merge_timestamps_by_position(dom: DataFrame, api: DataFrame) -> DataFrame:
    """Page messages take over, with the API's times at the same position, where only the page shows images."""
    api_has = api.groupBy(*KEY).agg(F.bool_or(F.size(images_in(F.col("markdown"))) > 0).alias("api_images"))
    dom_has = dom.groupBy(*KEY).agg(F.bool_or(F.size(images_in(F.col("markdown"))) > 0).alias("dom_images"))
    takes = (api_has.join(dom_has, KEY, "inner").where("dom_images AND NOT api_images").select(*KEY))
    times = api.select(*KEY, "pos", F.col("created_at").alias("api_at"))
    from_page = (dom.join(takes, KEY, "left_semi").join(times, [*KEY, "pos"], "left")
                 .withColumn("created_at", F.coalesce("created_at", "api_at")).drop("api_at"))
    return api.join(takes, KEY, "left_anti").unionByName(from_page)


def longest_capture(captures: DataFrame) -> DataFrame:
    """One row per (KEY, id): the longest text, the earliest capture among equals; `pos` is that capture's order."""
    best = F.max_by(F.struct(*[c for c in captures.columns if c not in (*KEY, "id")]),
                    F.struct(F.length("markdown"), -F.col("capture_seq")))
    return captures.groupBy(*KEY, "id").agg(best.alias("_row")).select(*KEY, "id", "_row.*")
