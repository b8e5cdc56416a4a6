import json
import os

import pytest
from pyspark.sql import functions as F

from parley import schemas
from parley.adapters import default_registry
from parley.operators import KEY, assets, pages, payloads, rendering
from parley.sources import files

PAGE = """
<html><head><title>Reading list | DeepSeek</title><style>x</style></head><body><main>
<li class="row"><a href="/app/wren-4">Nest <b>box</b> plans</a><em>5 hours ago</em></li>
<li class="row"><a href="/app/tern-8?archive_worker=1">Oak &amp; pine</a><em>Last week</em></li>
<a href="/app">New chat</a>
<div data-testid="conversation-turn-1"><div data-message-author-role="user" id="u1"><p>Hello <strong>you</strong><br>there</p>
<button>Copy</button></div></div>
<div data-testid="conversation-turn-2" ><div data-message-author-role="assistant"><h2>Plan</h2><ul><li>one</li><li>two <a href="http://x">x</a></li></ul>
<ol><li>a</li><li>b</li></ol><pre><code class="language-py hljs">x = 1
y = 2
</code></pre><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table>
<span class="katex"><span class="katex-mathml"><annotation encoding="application/x-tex">e^x</annotation></span><span aria-hidden="true">ex</span></span>
<div class="katex-display"><span class="katex"><annotation encoding="application/x-tex">\\sum</annotation></span></div>
<blockquote><p>said</p></blockquote><time datetime="2026-01-01T00:00:00Z"></time></div></div>
<div data-role="human" id="t3">last</div>
<ms-chat-turn id="t4"><p>Shown</p><ms-thought-chunk><p>First I</p><p>then I</p></ms-thought-chunk></ms-chat-turn>
</main></body></html>"""


def page_df(spark, *htmls):
    return spark.createDataFrame([(i, "https://gemini.google.com/x", h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string")


def test_links_titles_chrome(spark):
    df = page_df(spark, PAGE)
    got = pages.page_links(df, r"/app/([^/?#]+)").orderBy("seq").collect()
    assert [(r.source_id, r.url, r.title, r.source_updated_label) for r in got] == [
        ("wren-4", "https://gemini.google.com/app/wren-4", "Nest box plans", "5 hours ago"),
        ("tern-8", "https://gemini.google.com/app/tern-8", "Oak & pine", "Last week")]
    assert pages.page_title(df, "DeepSeek").first().title == "Reading list"
    asked = page_df(spark, '<title>Google Gemini</title><div class="query-text gds-body-l">You said\n Why is it so? </div>')
    assert pages.page_title(asked, "Google Gemini").first().title == "Why is it so?"
    clean = df.select(pages.strip_page_chrome(F.col("html")).alias("h")).first().h
    assert "Copy" not in clean and "<style" not in clean and "Hello" in clean


def test_title_of_the_open_entry_and_entities(spark):
    html = ('<title>Google Gemini</title><aside><a href="/app/heron-2" aria-current="page">Wading &eacute;lan &#x2603; &amp;lt; &hellip;</a></aside>'
            '<div class="query-text gds-body-l">A heron?</div>')
    assert pages.page_title(page_df(spark, html), "Google Gemini").first().title == "Wading élan ☃ &lt; …"
    links = pages.page_links(page_df(spark, html), r"/app/([^/?#]+)").first()
    assert links.title == "Wading élan ☃ &lt; …"


def test_entities_of_blocks_end_with_a_semicolon(spark):
    html = '<h1>Salt &amp; ash&amp</h1><h2>&ltb&gt &notit; &#x2603; &#9731 &copy2</h2><p><a href="/x?a=1&lt=2&amp;b">go</a> &<xmp>&amp</xmp></p>'
    got = [r.markdown for r in pages.pages_to_blocks(page_df(spark, html)).orderBy("pos").collect()]
    assert got == ["# Salt & ash&amp", "## &ltb&gt &notit; ☃ &#9731 &copy2", "[go](/x?a=1&lt=2&b) &&amp"]


STUDIO = ('<div data-test-id="model-name">Lamp 3</div><aside><div class="settings-item"><div class="t">System instructions</div><div>Be '
          'brief.</div></div><div class="settings-item"><div class="t">Temperature</div><div>0.4</div></div><div class="settings-tool">'
          '<div class="item-description-title">Star maps</div></div></aside><ms-chat-turn id="t-1"><div class="chat-turn-container user">'
          '<textarea>Where is Vega?</textarea></div></ms-chat-turn><ms-chat-turn id="t-2"><div class="chat-turn-container model">'
          '<ms-thought-chunk><div class="thought-collapsed-text-container">Thoughts</div><p>Summer sky.</p></ms-thought-chunk>'
          '<ms-text-chunk><p>High in the east.</p></ms-text-chunk></div></ms-chat-turn>')


def test_studio_pages(spark):
    df = page_df(spark, STUDIO)
    meta = json.loads(pages.page_settings(df).first().meta)
    assert meta["temperature"] == "Temperature 0.4" and meta["systemInstructions"] == "System instructions Be brief."
    assert meta["tools"] == ["Star maps"] and meta["model"] == "Lamp 3"
    turns = pages.blocks_to_turns(pages.pages_to_blocks(df)).orderBy("turn").collect()
    assert [(t.id, t.role, t.markdown) for t in turns] == [
        ("t-1", "user", "Where is Vega?"), ("t-2", "assistant", "> [thinking]\n> Summer sky.\n\nHigh in the east.")]


def test_open_end_tags_in_controls_hide_nothing(spark):
    html = ("<p>one</p><select><option>A<option>B</select><p>two</p><div><button><p>Press<span>x</button><p>three</p></div>"
            "<div><button>never closed</div><p>four</p>")
    got = [r.markdown for r in pages.pages_to_blocks(page_df(spark, html)).orderBy("pos").collect()]
    assert got == ["one", "two", "three", "four"]


def test_blocks_and_turns(spark):
    blocks = pages.pages_to_blocks(page_df(spark, PAGE))
    turns = pages.blocks_to_turns(blocks).orderBy("turn").collect()
    assert [(t.id, t.role) for t in turns] == [("conversation-turn-1", "user"), ("conversation-turn-2", "assistant"), ("t3", "user"),
                                             ("t4", "assistant")]
    assert turns[3].markdown == "> [thinking]\n> First I\n>\n> then I\n\nShown"
    assert turns[0].markdown == "Hello **you**  \nthere"
    assert turns[1].created_at == "2026-01-01T00:00:00Z"
    assert turns[1].markdown == ("## Plan\n\n-   one\n\n-   two [x](http://x)\n\n1.  a\n\n2.  b\n\n```py\nx = 1\ny = 2\n```\n\n"
                                 "| k | v |\n| --- | --- |\n| 1 | 2 |\n\n$e^x$\n\n$$\n\\sum\n$$\n\n> said")


def test_block_helpers_and_settings(spark):
    rows = [("p", 1, "a"), ("p", 2, " "), ("p", 3, "a "), ("p", 4, "b"), ("p", 5, "a")]
    df = spark.createDataFrame(rows, "g string, pos int, markdown string")
    assert [r.pos for r in pages.drop_adjacent_duplicates(df, ["g"]).orderBy("pos").collect()] == [1, 4, 5]
    assert [r.pos for r in pages.distinct_blocks(df, ["g"]).orderBy("pos").collect()] == [1, 4]
    cards = spark.createDataFrame([("p", 1, "a.pdf", "1 MB"), ("p", 2, "a.pdf", "1 MB"), ("p", 3, "note", None), ("p", 4, "b.PNG", None)],
                                  "g string, pos int, name string, meta string")
    assert [r.markdown for r in pages.attachment_cards(cards, ["g"]).orderBy("pos").collect()] == [
        "> [attachment] a.pdf (1 MB)", "> [attachment] b.PNG"]
    html = ('<span data-test-id="model-name"> gemini-3 </span><div class="settings-item"><h3>Temperature</h3><b>0.7</b></div>'
            '<div class="settings-item"><h3>Thinking level</h3><i>high</i></div><div class="settings-tool x"><span '
            'class="item-description-title">Search</span></div>')
    meta = json.loads(pages.page_settings(page_df(spark, html)).first().meta)
    assert meta["model"] == "gemini-3" and meta["temperature"] == "Temperature 0.7" and meta["tools"] == ["Search"]


MD = ('![dia.png](https://h/d.png "t") and ![](data:image/png;base64,AAAA)\n> [attachment] [My doc](https://f/x.pdf?y)\n'
      "> [attachment] [Drive](https://drive.google.com/open?id=1)\n> [attachment] notes: drv-9\n> [attachment] plain.txt (text/plain)")


def messages(spark):
    rows = [("chatgpt", "c", 0, "m0", "user", "![rel](img/x.png) " + MD, None), ("chatgpt", "c", 1, "m1", "assistant",
                                                                              "again ![dia](https://h/d.png) ![z](https://h/z.jpg)", None)]
    return spark.createDataFrame(rows, "platform string, source_id string, pos bigint, id string, role string, markdown string, created_at string")


def test_assets_rewrite_restore(spark):
    m = messages(spark)
    made = assets.embedded_assets(m)
    got = [(r.asset_no, r.path, r.mime_type, r.source_url, r.content_base64) for r in made.orderBy("asset_no").collect()]
    assert got == [(1, "assets/01-dia.png", "image/png", "https://h/d.png", None),
                   (2, "assets/02-image-2.png", "image/png", None, "AAAA"),
                   (3, "assets/My doc", "application/octet-stream", "https://f/x.pdf?y", None),
                   (4, "assets/04-z.png", "image/png", "https://h/z.jpg", None)]
    out = assets.rewrite_asset_links(m, made).orderBy("pos").collect()
    assert out[0].markdown.startswith("![rel](img/x.png) ![dia.png](assets/01-dia.png) and ![](assets/02-image-2.png)\n"
                                      "> [attachment] [My doc](assets/My doc)\n> [attachment] [Drive](https://drive")
    assert out[1].markdown == "again ![dia](assets/01-dia.png) ![z](assets/04-z.png)"
    failed = made.where("asset_no = 4").select(*KEY, "path", "source_url")
    back, left = assets.restore_failed_assets(assets.rewrite_asset_links(m, made), made, failed)
    assert back.orderBy("pos").collect()[1].markdown == "again ![dia](assets/01-dia.png) ![z](https://h/z.jpg)"
    assert left.count() == 3
    twins = m.limit(1).withColumn("markdown", F.lit("> [attachment] [a](https://f/1)\n> [attachment] [a](https://f/2)"))
    pair = assets.embedded_assets(twins)
    back, left = assets.restore_failed_assets(assets.rewrite_asset_links(twins, pair), pair, pair)
    assert back.first().markdown == "> [attachment] [a](https://f/2)\n> [attachment] [a](https://f/2)" and left.count() == 0


def test_linked_attachments_and_prepare(spark):
    m = messages(spark)
    links = [(r.kind, r.title, r.mime_type, r.source_url, r.resource_id) for r in assets.linked_attachments(m).orderBy("seq").collect()]
    assert links == [("document", "My doc", None, "https://f/x.pdf?y", None),
                     ("document", "Drive", None, "https://drive.google.com/open?id=1", None),
                     ("resource", "notes", None, None, "drv-9"), ("document", "plain.txt", "text/plain", None, None)]
    b = spark.createDataFrame([("chatgpt", "c", "https://u", "ChatGPT", "rev", '{"model":"m","revision":"old"}', "2026-01-01T00:00:00.000Z")],
                              "platform string, source_id string, url string, title string, revision string, meta string, extracted_at string")
    out = assets.prepare_bundles(b, m, "1.0")
    row = out["bundles"].first()
    meta = json.loads(row.meta)
    assert meta["revision"] == "rev" and meta["model"] == "m" and meta["exporterVersion"] == "1.0"
    assert [a["path"] for a in meta["embeddedAssets"]] == ["assets/01-dia.png", "assets/02-image-2.png", "assets/My doc", "assets/04-z.png"]
    assert len(meta["linkedAttachments"]) == 4 and row.title == row.title.strip() and row.used_fallback


BUNDLE = {"platform": "chatgpt", "sourceId": "owl-31", "url": "https://chatgpt.com/c/owl-31", "title": "Night birds",
          "extractedAt": "2031-02-03T04:05:06.000Z", "sourceUpdatedAt": "2031-02-02T22:00:00.000Z",
          "participants": [{"id": "user", "role": "user", "name": "User"}],
          "messages": [{"id": "q-1", "role": "user", "markdown": "Who calls?"}, {"id": "a-1", "role": "assistant", "markdown": "An owl."}],
          "meta": {"model": "m"}}


def test_bundle_files_round_trip(spark, tmp_path):
    for name, body in {"a/x.bundle.json": json.dumps(BUNDLE, indent=2), "b/y.bundle.json": "{not json", "b/z.bundle.json": '{"platform":"chatgpt"}',
                       "b/w.bundle.json": json.dumps({**BUNDLE, "platform": "other"}), "b/plain.json": json.dumps(BUNDLE)}.items():
        path = tmp_path / "in" / name
        os.makedirs(path.parent, exist_ok=True)
        path.write_text(body)
    got = files.read_bundles(spark, str(tmp_path / "in"))
    row = got.first()
    assert got.count() == 1 and row.source_id == "owl-31" and row.file_path.endswith("x.bundle.json") and len(row.messages) == 2
    assert files.read_bundles(spark, str(tmp_path / "in"), platforms=["gemini"]).count() == 0
    made = got.withColumn("revision", F.lit("r1"))
    files.write_bundle_json(made, str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out" / "bundles")).first()
    assert out.path == "chatgpt/owl-31/r1/bundle.json" and json.loads(out.content) == BUNDLE
    files.write_raw_capture(made.withColumn("raw_capture", F.lit(None).cast("string")).unionByName(
        made.withColumn("raw_capture", F.lit("{}"))), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "raw")).count() == 1
    m = payloads.explode_messages(got)
    docs = rendering.serialize_conversations(made, m)
    files.write_markdown(docs.join(made.select(*KEY, "revision"), KEY), str(tmp_path / "out"))
    assert "## Assistant" in spark.read.parquet(str(tmp_path / "out" / "documents")).first().markdown
    paths = files.export_selected(made, docs, str(tmp_path / "sel"), flat=True).first()
    assert (paths.markdown_path, paths.asset_prefix) == ("Night birds.md", "Night birds.assets")
    with pytest.raises(ValueError):
        files.export_selected(made, docs, str(tmp_path / "sel"), markdown=False, bundle_json=False)
    assert files.export_paths(made, False).first().bundle_path == "export/chatgpt/Night birds__owl31/Night birds.bundle.json"


def test_read_ingest_rejects(spark):
    client = {"extensionVersion": "0.1.0", "browser": "edge"}
    bodies = [{"bundle": BUNDLE, "client": client}, {"bundle": {**BUNDLE, "platform": "x"}, "client": client},
              {"bundle": {**BUNDLE, "participants": []}, "client": client}, {"bundle": {**BUNDLE, "extractedAt": "today"}, "client": client},
              {"bundle": {**BUNDLE, "title": ""}, "client": client}, {"bundle": BUNDLE, "client": {"browser": "edge"}}]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(9, "nope")], "seq bigint, body string")
    valid, rejects = files.read_ingest(df)
    assert [r.seq for r in valid.collect()] == [0]
    assert [r.reason for r in rejects.orderBy("seq").collect()] == [
        "bundle.platform", "bundle.participants", "bundle.extractedAt", "bundle.title", "client", "bundle"]


def test_history_and_logs(spark, tmp_path):
    def page(ids, more, at):
        return json.dumps({"data": {"biz_data": {"has_more": more, "chat_sessions": [
            {"id": i, "title": i, "updated_at": at} for i in ids]}}})
    os.makedirs(tmp_path / "h")
    for n, body in enumerate([page(["a", "b"], True, 1740334294.343), page(["c"], True, 1740334200.5), page(["d"], True, 1740334200.5),
                              page(["e"], False, 1.5)]):
        (tmp_path / "h" / f"page-{n}.json").write_text(body)
    events, facts = files.read_history_pages(spark, str(tmp_path / "h"), "deepseek")
    assert [r.source_id for r in events.orderBy("page", "seq").collect()] == ["a", "b", "c", "d"]
    assert facts.where("page = 0").first().next_cursor == "1740334294.343"
    logs = spark.createDataFrame([(f"l{i}", f"2026-01-01T00:00:{i:02d}.000Z", "info", "s", "m", None, None, None, None, None, None) for i in range(3)], schemas.LOGS)
    files.export_log_snapshot(logs, str(tmp_path / "log"), "2026-01-02T00:00:00.000Z", "1")
    snap = spark.read.json(str(tmp_path / "log")).first()
    assert snap.logCount == 3 and [x.id for x in snap.logs] == ["l2", "l1", "l0"]


def test_adapters(spark):
    rows = [("a", "https://chatgpt.com/c/a", '{"title":"T","current_node":"n","mapping":{"n":{"id":"n","message":{"id":"m","author":{"role":"user"},'
             '"content":{"parts":["hi"]}}}}}'), ("b", "https://chat.deepseek.com/a/chat/s/b", '{"data":{"biz_data":{"chat_messages":[{"message_id":1,"role":"USER","content":"yo"}]}}}'),
            ("c", "https://elsewhere/", "{}")]
    df = spark.createDataFrame(rows, "source_id string, url string, payload string").withColumn("title", F.lit(None).cast("string"))
    got = default_registry().parse(df.withColumn("platform", F.lit("")))
    assert sorted((r.platform, r.source_id, r.messages[0].markdown) for r in got.collect()) == [("chatgpt", "a", "hi"), ("deepseek", "b", "yo")]
