"""Cases with known results."""

import pytest
from pyspark.sql import functions as F

from parley.functions import identity as ids
from parley.functions import markdown as md
from parley.functions import text as tx
from parley.functions import times as tm
from parley.functions import urls as ur
from parley.operators import KEY, analytics, archive, artifacts, conversations, discovery, queue, rendering

c, lit = F.col, F.lit
NOW = "2026-04-03T12:00:00.000Z"


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_hashes(spark):
    messages = F.array(*[F.struct(lit(i).alias("id"), lit(r).alias("role"), lit(m).alias("markdown"))
                         for i, r, m in (("m1", "user", "Hello"), ("m2", "assistant", "Hi"))])
    assert one(spark, ids.bundle_revision(lit("chatgpt"), lit("conv-1"), lit("https://chatgpt.com/c/conv-1"), lit("Test conversation"),
                                          lit("2026-03-18T08:00:00.000Z"), messages)) == (
        "8f4e038b02ad8b052a7d2806271f82f7007ef7514cf8df271c5f9c3eded79a88")
    assert one(spark, ids.discovery_fingerprint(lit("chatgpt"), lit("conv-1"), lit(None).cast("string"))) == (
        "7ccd6797a4a2861d635a766cb3dc6e263cdc372f78c2a79445eb6c6b1e408ab2")


TITLE = "platform string, source_id string, title string, url string"
MSG = "platform string, source_id string, pos bigint, id string, role string, markdown string, created_at string"


def resolved(spark, title, prompt, preferred):
    b = spark.createDataFrame([("gemini", "abc", title, "u")], TITLE)
    m = spark.createDataFrame([("gemini", "abc", 0, "m", "user", prompt, None)], MSG)
    p = spark.createDataFrame([("gemini", "abc", preferred)], "platform string, source_id string, preferred_title string")
    r = conversations.resolve_titles(b, m, p).first()
    return r.title, r.used_fallback, r.unresolved


def test_titles(spark):
    long = "Please explain in detail how the Red River delta was studied in the late period"
    assert resolved(spark, long[:48], long, "明末越南红河三角洲研究") == ("明末越南红河三角洲研究", False, False)
    assert resolved(spark, "A real title", long, "Another") == ("A real title", False, False)
    assert resolved(spark, "Gemini", long, None) == (long[:48].strip(), True, False)
    assert resolved(spark, "Gemini", "deadbeef01", "New chat") == ("abc", False, True)
    assert one(spark, tx.normalize_title(lit("Untitled draft"))) is None
    assert one(spark, tx.normalize_title(lit(" A  b "))) == "A b"
    assert one(spark, tx.is_opaque_id(lit("12345678-90ab-cdef")))


def test_preferred_titles(spark):
    b = spark.createDataFrame([("gemini", "abc", None, "u")], TITLE)
    m = spark.createDataFrame([("gemini", "abc", 0, "m", "user", "My prompt", None)], MSG)
    index = b.withColumn("title", lit("Index title"))
    q = "platform string, source_id string, pos bigint, title string, updated_at string"
    repeats = spark.createDataFrame([("gemini", "abc", 1, "My prompt", NOW)], q)
    differs = spark.createDataFrame([("gemini", "abc", 1, "Queue title", NOW), ("gemini", "abc", 2, "New chat", "2027")], q)
    assert conversations.preferred_titles(b, m, index, repeats).first().preferred_title == "Index title"
    assert conversations.preferred_titles(b, m, index, differs).first().preferred_title == "Queue title"


@pytest.mark.parametrize("text,want", [
    ("> [thinking]\n> weigh the kelp\n> dry it\n\nTwo baskets",
     "<details>\n<summary>Thinking</summary>\n\nweigh the kelp\ndry it\n\n</details>\nTwo baskets"),
    ("a\r\n> [Thinking]\n\n> x\n>\n>\n>\n> y\n", "a\n<details>\n<summary>Thinking</summary>\n\nx\n\ny\n\n</details>"),
    ("> [thinking]", "<details>\n<summary>Thinking</summary>\n\n</details>"),
    ("> [thinking] label\n\nz", "> [thinking] label\n\nz"),
])
def test_thinking_details(spark, text, want):
    assert one(spark, md.thinking_to_details(lit(text))) == want


@pytest.mark.parametrize("text,want", [
    ("a\n> [thinking]\n> x\n\n> [attachment] [s](u)\n\nFinal\n> q", "a\nFinal\n> q"),
    ("> [thinking] label\n\nz", "> [thinking] label\n\nz"), ("a\n> [thinking]\n> x", "a"), ("> [thinking]\n> x\nb", "b"),
])
def test_strip_thinking(spark, text, want):
    assert one(spark, md.strip_thinking(lit(text))) == want


def test_block_rules_hold_for_long_blocks(spark):
    text = "a\n> [thinking]\n" + "> x\n" * 200_000 + "b"
    assert one(spark, F.length(md.strip_thinking(lit(text)))) == 3
    assert one(spark, F.length(md.thinking_to_details(lit(text)))) > 400_000


def test_markdown_rules(spark):
    bare = "地图在https://charts.test/v2/bay/index.html这里"
    assert one(spark, md.wrap_bare_urls(lit(bare))) == "地图在<https://charts.test/v2/bay/index.html>这里"
    kept = "[a](https://a.b/上) <https://c.d> see https://e.f (https://g.h)"
    assert one(spark, md.wrap_bare_urls(lit(kept))) == kept
    assert one(spark, md.wrap_bare_urls(lit("xhttps://a.b/http://c d"))) == "x<https://a.b/http://c> d"
    code = "t\n```ts\n// comment only\n\nconst a = 1;\n* x\n```\n\n\n\nend  \n"
    assert one(spark, md.compact_code(lit(code))) == "t\n```ts\nconst a = 1;\n```\n\nend"
    assert one(spark, md.compact_code(lit("a\n```py\n# only\n```\nb"))) == "a\n\nb"
    assert one(spark, md.safe_fence(lit("a ~~~~ b"), "text")) == "~~~~~text\na ~~~~ b\n~~~~~"
    mixed = "> [thinking]\n> t\n\ntext ![i](https://a/b.png)\n> [attachment] [f](https://a/f)\n```\ncode\n```"
    assert "[thinking]" not in one(spark, md.apply_preset(lit(mixed), "standard")) and "b.png" in one(spark, md.apply_preset(lit(mixed), "standard"))
    share = one(spark, md.apply_preset(lit(mixed), "share"))
    assert "b.png" not in share and "[attachment]" not in share and "code" in share
    assert "b.png" in one(spark, md.apply_preset(lit(mixed), "share", images=True))
    page = "edit\n**Plan** go on\nThoughts\n**A** **A**\nModel 12:30\nx  y"
    assert one(spark, md.normalize_prompt_text(lit(page), dom=True)) == "**Plan**\n\ngo on\n\n**A**\n\nx y"


def test_serialized_document(spark):
    b = spark.createDataFrame([("chatgpt", "kelp-8", "Tide tables", "https://host.test/c/kelp-8", "rev77", "2031-07-15T06:30:00.000Z", None, '{"model":"lamp"}',
                                [("user", "user", "User"), ("assistant", "assistant", "ChatGPT")])],
                              TITLE + ", revision string, extracted_at string, source_updated_at string, meta string, "
                              "participants array<struct<id:string,role:string,name:string>>")
    m = spark.createDataFrame([("chatgpt", "kelp-8", 0, "q", "user", "ebb or flow", "some day"), ("chatgpt", "kelp-8", 1, "r", "assistant", "ebb\n```sh\ntide\n```", None)], MSG)
    row = rendering.serialize_conversations(b, m).first()
    for part in ("conversation_id: kelp-8", "# Tide tables", 'assistant: "ChatGPT"', "> Source: chatgpt", "Revision: rev77", "## User\n\n> some day\n\nebb or flow",
                 "## Assistant", 'source_updated_at: ""', "message_count: 2"):
        assert part in row.markdown
    assert row.message_count == 2 and row.estimated_tokens == one(spark, tx.estimate_tokens(lit(row.markdown)))
    code = rendering.serialize_conversations(b, m, "code-only").first()
    assert code.message_count == 1 and "ebb or flow" not in code.markdown
    nothing = rendering.serialize_conversations(b, m.limit(0)).first()
    assert nothing.markdown.endswith("_(empty conversation)_\n") and nothing.message_count == 0


def test_urls_and_times(spark):
    gem = [one(spark, ur.source_id_from_url(lit(f"https://gemini.google.com{p}"), "gemini")) for p in ("/app/heron7", "/app", "/app/mystuff")]
    assert gem == ["heron7", None, None]
    assert one(spark, ur.source_id_from_url(lit("https://aistudio.google.com/prompts/new_chat"), "aistudio")) is None
    assert one(spark, ur.canonical_url(lit("HTTPS://A.b/ü x?q=a b&archive_worker=1&&z#f"))) == "https://a.b/%C3%BC%20x?q=a+b&z=#f"
    assert one(spark, ur.is_private_host(lit("fd00::1"))) and not one(spark, ur.is_private_host(lit("fd-shop.example")))
    assert one(spark, tm.normalize_timestamp(lit("1900000000.625"), "deepseek_list", True)) == "2030-03-17T17:46:40.625Z"
    assert one(spark, tm.relative_label_to_ts(lit("7 hours ago"), lit(NOW))) == "2026-04-03T05:00:00.000Z"
    assert one(spark, tm.relative_label_to_ts(lit("Yesterday"), lit(NOW))) == "2026-04-02T12:00:00.000Z"
    assert one(spark, tm.format_message_timestamp(lit("2031-07-15T06:30:00Z"), "America/St_Johns")) == "2031-07-15 04:00:00 (UTC-02:30)"
    assert [one(spark, tx.format_token_count(lit(n))) for n in (7, 3000, 3250, 3950, 12340)] == ["~7", "~3.0K", "~3.3K", "~4.0K", "~12.3K"]


def test_union_by_priority(spark):
    cols = "platform string, source_id string, title string, seq bigint"
    buf, side, api = (spark.createDataFrame(r, cols) for r in (
        [("d", "0", "b0", 0)], [("d", "1", "s1", 0)], [("d", "1", "a1", 0), ("d", "2", "a2", 1)]))
    got = [(r.source_id, r.title, r.source) for r in discovery.union_by_priority(buf, side, api).orderBy("first_seq").collect()]
    assert got == [("0", "b0", "merged"), ("1", "a1", "merged"), ("2", "a2", "merged")]
    assert discovery.union_by_priority(buf, side, api, buffered_only=True).first().source == "buffered"
    assert discovery.union_by_priority(buf.limit(0), side, api.limit(0)).first().source == "sidebar"


def test_discovery_due(spark):
    s = spark.createDataFrame([("gemini", None, "2026-04-03T11:54:00.000Z", 790), ("x", None, None, 0)],
                              "platform string, last_discovery_at string, last_export_at string, discovered int")
    got = {r.platform: (r.due, r.stale) for r in discovery.discovery_due(s, NOW).collect()}
    assert got == {"gemini": (False, False), "x": (True, True)}


QUEUE = ("pos bigint, key string, platform string, source_id string, url string, title string, source_updated_at string, source_updated_label string, "
         "revision_fingerprint string, kind string, priority string, worker_id string, status string, attempts int, last_error string, "
         "error_code string, discovered_at string, updated_at string")
EVENT = "seq bigint, platform string, source_id string, url string, title string, source_updated_at string, source_updated_label string, revision_fingerprint string"


def q_row(pos, fp, status, at=None, **more):
    row = dict(pos=pos, key=f"p:s:{fp}", platform="p", source_id="s", url="u", title="t", source_updated_at=at, source_updated_label=None,
               revision_fingerprint=fp, kind="export", priority="backfill", worker_id="w", status=status, attempts=2, last_error="e", error_code=None,
               discovered_at=NOW, updated_at=NOW)
    return tuple({**row, **more}.values())


@pytest.mark.parametrize("merge", [queue.merge_queue, queue.fold_queue])
def test_queue_merges(spark, merge):
    def run(rows, event, **options):
        q, e = spark.createDataFrame(rows, QUEUE), spark.createDataFrame([event], EVENT)
        return [(r.key, r.status, r.priority, r.last_error, r.source_updated_at) for r in merge(q, e, "2027", **options).orderBy("pos").collect()]
    same = (0, "p", "s", "u2", None, "2026", None, "f1")
    assert run([q_row(0, "f1", "pending", "2026")], same) == [("p:s:f1", "pending", "backfill", "e", "2026")]
    assert run([q_row(0, "f1", "completed", "2026")], same, force=True, priority="retry") == [("p:s:f1", "pending", "retry", None, "2026")]
    assert run([q_row(0, "f1", "failed", "2026")], same) == [("p:s:f1", "pending", "realtime", None, "2026")]
    new = (0, "p", "s", "u2", None, "2026", None, "f2")
    assert [x[:2] for x in run([q_row(0, "f1", "completed", "2025")], new)] == [("p:s:f2", "pending"), ("p:s:f1", "completed")]
    assert run([q_row(0, "f1", "processing")], new) == [("p:s:f2", "processing", "backfill", "e", "2026")]
    timeless = (0, "p", "s", "u2", "T", None, "2 days ago", "f9")
    assert run([q_row(0, "f1", "pending", "2025")], timeless) == [("p:s:f1", "pending", "backfill", "e", "2025")]


ARTIFACT = ("platform string, source_id string, revision string, pos bigint, markdown_download_id bigint, bundle_download_id bigint, markdown_filename string, "
            "bundle_filename string, exported_at string, local_status string, is_latest boolean")


def test_artifact_retention(spark):
    rows = [("p", "s", f"rev-{i}", -i, None, None, "m", None, f"2026-01-01T00:0{i}:00.000Z", "present", False) for i in (1, 2, 3)]
    a = spark.createDataFrame(rows, ARTIFACT)
    assert artifacts.latest_artifact(a).first().revision == "rev-3"
    after, pruned = artifacts.prune_revisions(a, 1)
    assert sorted(r.revision for r in pruned.collect()) == ["rev-1", "rev-2"]
    assert [(r.revision, r.local_status, r.is_latest) for r in after.orderBy("revision").collect()] == [
        ("rev-1", "deleted", False), ("rev-2", "deleted", False), ("rev-3", "present", True)]
    assert artifacts.mark_latest(a, 2).where("local_status = 'present'").count() == 2
    assert artifacts.latest_openable(after).first().revision == "rev-3"


def test_queue_views_and_logs(spark):
    logs = spark.createDataFrame([
        ("log-1", "2026-01-01T00:00:01.000Z", "info", "background.queue", "start", None, "tr", "deepseek", "conv-1", None, None),
        ("log-2", "2026-01-01T00:00:02.000Z", "error", "content.chatgpt", "failed here", "c.x", None, None, None, None, "{}"),
        ("log-3", "2026-01-01T00:00:03.000Z", "info", "x", "m", None, None, None, None, None, '{"sourceId":"conv-1"}'),
        ("log-4", "2026-01-01T00:00:04.000Z", "info", "y", "m", None, None, None, "conv-1", None, None)],
        "id string, timestamp string, level string, scope string, message string, code string, trace_id string, platform string, "
        "source_id string, worker_id string, details string")
    assert [r.id for r in analytics.related_logs(logs, logs.where("id = 'log-1'")).collect()] == ["log-1", "log-3", "log-4"]
    assert [r.id for r in analytics.related_logs(logs, logs.where("id = 'log-2'")).collect()] == ["log-2"]
    assert [r.id for r in analytics.filter_logs(logs, ["info", "error"], platform="chatgpt", search="FAILED").collect()] == ["log-2"]
    assert [r.value for r in analytics.log_facets(logs).where("facet = 'code'").collect()] == ["all", "c.x"]
    q = spark.createDataFrame([q_row(0, "a", "pending", source_id="conv-1", title="File 10"), q_row(1, "b", "pending", source_id="conv-2", title="file 9")], QUEUE)
    index = spark.createDataFrame([("p", "conv-1", None, None, "6 hours ago", NOW), ("p", "conv-2", None, None, "2 hours ago", NOW)],
                                  "platform string, source_id string, title string, latest_source_updated_at string, latest_source_updated_label string, last_seen_at string")
    def order(key, way):
        return [r.source_id for r in analytics.sort_queue(q, index, q, key, way, lit(NOW)).collect()]
    assert order("website_time", "desc") == ["conv-2", "conv-1"]
    assert order("title", "asc") == ["conv-2", "conv-1"]
    assert analytics.page(q, [("pos", True)], 9, 1).first().pos == 1


def test_sync_due_and_paging(spark):
    busy = spark.createDataFrame([("pending",)], "status string")
    calm = busy.withColumn("status", lit("completed"))
    def due(last, q):
        r = artifacts.sync_due(last, q, NOW).first()
        return r.interval_due, r.due
    assert due(None, calm) == (True, True) and due("2026-04-01T00:00:00.000Z", calm) == (False, False) and due(None, busy) == (True, False)
    with pytest.raises(ValueError):
        archive.list_conversations(calm, limit=101)
    with pytest.raises(ValueError):
        archive.ingest(calm, calm, calm)
    assert KEY == ["platform", "source_id"]
