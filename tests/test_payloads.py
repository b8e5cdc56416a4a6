"""Payload and list parsers on invented payloads; expected times are computed, not written down."""

import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from parley.operators import payloads as pl

ASKED = "2031-07-15T06:00:00.000Z"
SHAPE = "platform string, source_id string, url string, title string, payload string, extracted_at string"


def iso(seconds, millis=0):
    at = datetime.fromtimestamp(seconds, timezone.utc)
    return f"{at:%Y-%m-%dT%H:%M:%S}.{millis:03d}Z"


def text_of(payload):
    return payload if isinstance(payload, str) else json.dumps(payload, ensure_ascii=False)


def parse(spark, parser, payload, url="https://host.test/app/kite-77", title="Given title"):
    return parser(spark.createDataFrame([("p", "kite-77", url, title, text_of(payload), ASKED)], SHAPE)).first()


def node(name, parent, role=None, parts=None, **more):
    message = None if role is None else {"author": {"role": role}, "content": {"parts": parts}, **more}
    return name, {"id": name, "parent": parent, "message": message}


def test_tree_payloads_follow_the_current_branch(spark):
    mapping = dict([
        node("root", None),
        node("ask", "root", "user", ["  Which way to the harbour? "], id="ask-id", create_time=1900000100.25),
        node("dropped", "ask", "assistant", ["an answer nobody kept"], id="d"),
        node("lookup", "ask", "tool", ["map tiles"], id="t"),
        node("reply", "lookup", "assistant", ["Downhill.", {"text": "Then left."}, " ", 31, {"z": [0], "k": "v"}],
             create_time=iso(1900000160, 500)),
    ])
    got = parse(spark, pl.parse_chatgpt, {"title": "Harbour", "current_node": "reply", "mapping": mapping})
    assert [(m.id, m.role, m.created_at) for m in got.messages] == [
        ("ask-id", "user", iso(1900000100, 250)), ("reply", "assistant", iso(1900000160, 500))]
    assert got.messages[0].markdown == "Which way to the harbour?"
    assert got.messages[1].markdown == 'Downhill.\n\nThen left.\n\n{"z":[0],"k":"v"}'
    assert got.source_updated_at == iso(1900000160, 500) and got.title == "Harbour"
    assert json.loads(got.meta)["rawNodeCount"] == len(mapping)


def test_tree_payloads_with_a_cycle_or_no_nodes(spark):
    ring = dict([node("p", "q", "user", ["up"], id="P"), node("q", "p", "assistant", ["down"], id="Q")])
    assert [m.id for m in parse(spark, pl.parse_chatgpt, {"current_node": "p", "mapping": ring}).messages] == ["Q", "P"]
    assert parse(spark, pl.parse_chatgpt, {"current_node": "gone", "mapping": {}}).messages == []


def test_fragment_payloads(spark):
    second = {"message_id": 12, "role": "ASSISTANT", "inserted_at": 1900000300.75, "fragments": [
        {"type": "THINK", "content": "compare tides\nthen wind"}, {"type": "TEXT", "content": "Sail at noon"}]}
    first = {"message_id": 11, "role": "USER", "inserted_at": 1900000240.0, "fragments": [{"type": "REQUEST", "content": "When to sail?"}]}
    third = {"message_id": 13, "role": "USER", "inserted_at": "some day",
             "content": "Voir https://files.test/carte.pdf et https://files.test/baie.png",
             "files": [{"file_name": "log.txt", "file_size": 3072}, {"file_name": "lost", "status": "FAILED"},
                       {"file_name": "tides.pdf", "download_url": "https://dl.test/tides.pdf"}]}
    other = {"message_id": 14, "role": "tool", "content": "skipped"}
    got = parse(spark, pl.parse_deepseek, {"data": {"biz_data": {
        "chat_session": {"title": "Sailing"}, "chat_messages": [second, first, third, other]}}})
    assert [(m.id, m.created_at) for m in got.messages] == [
        ("11", iso(1900000240)), ("12", iso(1900000300, 750)), ("13", "some day")]
    assert got.title == "Sailing" and got.messages[0].markdown == "When to sail?"
    assert got.messages[1].markdown == "> [thinking]\n> compare tides\n> then wind\n\nSail at noon"
    assert got.messages[2].markdown.split("\n\n") == [
        "> [attachment] log.txt (3.00KB)", "> [attachment] [tides.pdf](https://dl.test/tides.pdf)", third["content"],
        "![baie.png](https://files.test/baie.png)", "> [attachment] [carte.pdf](https://files.test/carte.pdf)"]


def envelope(turns):
    inner = json.dumps([turns, None, None, []], ensure_ascii=False)
    return ")]}'\n\n7\n" + json.dumps([["wrb.fr", "hNvQHb", inner, None]], ensure_ascii=False)


def picture(name):
    return [None, 1, f"{name}.jpg", f"https://lh3.googleusercontent.com/gg/{name}", None, f"key-{name}", None, None, 6]


def rpc_turn(asked, answer, at=None, pictures=None):
    question = [asked] if pictures is None else [asked, None, None, None, [[None, None, None, pictures]]]
    return [None, None, [question], [[answer]], at]


def test_rpc_turns_carry_thoughts_ids_and_times(spark):
    def answer(n):
        return [f"out-{n}", [f"reply {n}"]] + [None] * 35 + [[[f"*idea {n}*"]]]
    got = parse(spark, pl.parse_gemini, envelope([rpc_turn(f"Frage {n}", answer(n), [1900001000 + n, 40_000_000 * n]) for n in (1, 2)]))
    assert [(m.id, m.markdown) for m in got.messages] == [
        ("user-1", "Frage 1"), ("out-1", "> [thinking]\n> *idea 1*\n\nreply 1"),
        ("user-2", "Frage 2"), ("out-2", "> [thinking]\n> *idea 2*\n\nreply 2")]
    assert got.title == "Given title" and got.source_updated_at == iso(1900001002, 80)


def test_rpc_turns_are_sorted_and_lose_inherited_pictures(spark):
    turns = [rpc_turn("later", ["Y", ["Y"]], [1900002050, 0], [picture("reef"), picture("buoy")]),
             rpc_turn("earlier", ["X", ["X"]], [1900002000, 0], [picture("reef")]), [None, None, [["no date"]], None]]
    got = parse(spark, pl.parse_gemini, envelope(turns))
    assert [m.id for m in got.messages] == ["user-1", "user-2", "X", "user-3", "Y"]
    assert got.messages[1].markdown == "![reef.jpg](https://lh3.googleusercontent.com/gg/reef)\n\nearlier"
    assert got.messages[3].markdown == "![buoy.jpg](https://lh3.googleusercontent.com/gg/buoy)\n\nlater"
    assert got.source_updated_at == iso(1900002050)


def test_rpc_interactive_blocks_become_links(spark):
    said = 'Look:\n\n```json\n{"miniApp":{"spec":"s","id":"im_tide42"}}\n```\n\nDone.'
    got = parse(spark, pl.parse_gemini, envelope([rpc_turn("q", ["r", [said]], [1900003000, 0])]), url="https://host.test/t")
    assert got.messages[1].markdown == "Look:\n\n> [interactive] [Open Gemini visualization demo (im_tide42)](https://host.test/t)\n\nDone."


def role_turn(text, role, **slots):
    row = [text] + [None] * 7 + [role] + [None] * 20
    for name, value in slots.items():
        row[int(name[1:])] = value
    return row


def prompt(*turns, changed=("1900004000", 250_000_000)):
    about = ["Lighthouse", None, None, None, [list(changed)]] + [None] * 5 + [[["promptType", "PLAIN"], ["hasImages", "true"]]]
    return [["prompts/beam", None, None, [1, None, "models/lamp"], about, {"nested": list(turns)}]]


def test_prompt_turns_thoughts_and_files(spark):
    got = parse(spark, pl.parse_aistudio, prompt(
        role_turn("How bright?", "user", _18=[1900003900, 7_000_000]), role_turn("**Watts**\n\nAdd up.", "model", _25=-1),
        role_turn("Very.", "model"), role_turn(None, "user", _3=["file-9"], _23=["image/png", "c2VhIHNlYQ=="]),
        role_turn("read", "user", _12=["text/plain", "Zm9nIH5+fiBob3Ju"])))
    meta = json.loads(got.meta)
    assert (got.title, meta["model"], meta["promptType"], meta["hasImages"]) == ("Lighthouse", "models/lamp", "PLAIN", True)
    assert got.source_updated_at == iso(1900004000, 250) and got.messages[0].created_at == iso(1900003900, 7)
    assert [m.id for m in got.messages] == ["user-1", "assistant-2", "assistant-3", "user-4", "user-5"]
    assert got.messages[1].markdown == "> [thinking]\n> **Watts**\n>\n> Add up."
    assert got.messages[3].markdown == ("![user-4.png](data:image/png;base64,c2VhIHNlYQ==)\n\n> [attachment] [Google Drive resource "
                                        "file-9](https://drive.google.com/open?id=file-9)")
    assert got.messages[4].markdown == "> [attachment] text/plain\n\n~~~~text\nfog ~~~ horn\n~~~~\n\nread"
    assert meta["linkedAttachments"][0]["resourceId"] == "file-9"


def test_two_pictures_of_one_header_are_two(spark):
    header = "iVBORw0KGgoAAAANSUhEUgAAAAEAAAAB"
    assert len(header) == 32
    got = parse(spark, pl.parse_aistudio, prompt(role_turn(
        "both", "user", _12=["image/png", header + "QUFB"], _23=["image/png", header + "QkJC"])))
    assert got.messages[0].markdown.count("data:image/png") == 2


def test_one_bad_row_does_not_fail_the_others(spark):
    deep = "[" * 100_000 + "]" * 100_000
    huge = json.dumps(prompt(role_turn("x", "user", _18=[1900003900, 0]))).replace("1900003900, 0", "1900003900, 1e999")
    rows = spark.createDataFrame([("p", str(i), "u", "t", body, ASKED) for i, body in enumerate(
        [deep, huge, "not json", json.dumps(prompt(role_turn("fine", "user")))])], SHAPE)
    got = {r.source_id: r.messages for r in pl.parse_aistudio(rows).collect()}
    assert [m.markdown for m in got["3"]] == ["fine"] and len(got) == 4


def events(spark, platform, payload):
    rows = spark.createDataFrame([(1, text_of(payload))], "page int, payload string")
    return [(r.source_id, r.url, r.title, r.source_updated_at)
            for r in pl.parse_discovery(rows, platform).orderBy("seq").collect()]


def listed(*rows):
    inner = "[null,\"more\",[" + ",".join(f'["c_{i}","{t}",null,null,null,[{s},{n}],null]' for i, t, s, n in rows) + "]]"
    return ")]}'\n\n9\n" + json.dumps([["wrb.fr", "MaZiqc", inner]], ensure_ascii=False)


def test_prompt_lists(spark):
    assert events(spark, "aistudio", [[
        ["prompts/keel", None, None, None, ["Keel repair", None, None, None, [["1900005000", 125_000_000]]]],
        ["prompts/new_chat", None, None, None, ["empty"]]], "next"]) == [
        ("keel", "https://aistudio.google.com/prompts/keel", "Keel repair", iso(1900005000, 125))]


def test_batched_lists(spark):
    assert events(spark, "gemini", listed(("aa11", "Mast \\u0042", 1900006000, 500_000_000), ("bb22", "Segel", 1900006100, 0))) == [
        ("aa11", "https://gemini.google.com/app/aa11", "Mast B", iso(1900006000, 500)),
        ("bb22", "https://gemini.google.com/app/bb22", "Segel", iso(1900006100))]


def test_batched_lists_with_very_long_titles(spark):
    title = "sea " * 25_000
    got = events(spark, "gemini", listed(("cc33", title, 1900006200, 0)))
    assert [(i, t) for i, _, t, _ in got] == [("cc33", title.strip())]


def test_plain_lists(spark):
    assert events(spark, "chatgpt", {"items": [
        {"id": "oar", "title": "Oars", "update_time": 1900007000.5}, {"title": "no id"},
        {"conversation_id": "rope", "url": "https://elsewhere.test/rope", "update_time": None, "updated_at": "2031-01-02T03:04:05Z"}]}) == [
        ("oar", "https://chatgpt.com/c/oar", "Oars", iso(1900007000, 500)),
        ("rope", "https://elsewhere.test/rope", None, "2031-01-02T03:04:05.000Z")]
    assert events(spark, "deepseek", {"data": {"biz_data": {
        "chat_session": {"id": "net", "title": "Before"}, "chat_messages": [{"inserted_at": "1900008000.5"}],
        "chat_sessions": [{"id": "hook", "title": "", "updated_at": 1900008100.25}, {"id": "net", "title": "After"}]}}}) == [
        ("hook", "https://chat.deepseek.com/a/chat/s/hook", None, iso(1900008100, 250)),
        ("net", "https://chat.deepseek.com/a/chat/s/net", "After", None)]


def test_split_and_explode(spark):
    kept, rejects = pl.split(pl.parse_chatgpt(spark.createDataFrame([("chatgpt", "a", "u", "T", "{}", ASKED)], SHAPE)))
    assert kept.count() == 0 and rejects.first().reason == "no usable messages"
    assert pl.explode_messages(kept).select(F.count("id")).first()[0] == 0
