"""Laws and brute-force twins on the driver's smallest tables and on skewed data."""

import hashlib
import random

from pyspark.sql import functions as F

from parley import schemas
from parley.functions import identity as ids
from parley.operators import KEY, archive, artifacts, branches, conversations, discovery, ordered, payloads, queue, rendering
from parley.plans import load_all
from parley.plans.catalog import QUERIES
from parley.plans.views import NOW, Views

load_all()

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_documents_of_any_size_have_one_shape(spark):
    v = Views(spark, SF)
    b = v.bundles_v.withColumns({"revision": F.lit("r"), "meta": F.lit("{}")}).join(
        conversations.participants(v.bundles_v, v.messages_v), KEY)
    whole = {(r.platform, r.source_id): r for r in rendering.serialize_conversations(b, v.messages_v).collect()}
    parts = rendering.serialize_conversations(b, v.messages_v, rows_per_part=2).collect()
    assert any(r.parts > 1 for r in parts)
    for key, want in whole.items():
        got = sorted((r for r in parts if (r.platform, r.source_id) == key), key=lambda r: r.part)
        assert "".join(r.markdown for r in got) == want.markdown
        assert [r.part for r in got] == list(range(len(got))) and {r.parts for r in got} == {len(got)}
        assert [(r.message_count, r.estimated_tokens) for r in got] == [
            (want.message_count, want.estimated_tokens)] + [(None, None)] * (len(got) - 1)


def test_a_very_long_conversation_is_rendered_and_hashed_whole(spark):
    n = 100_000
    messages = spark.range(n).select(F.lit("gemini").alias("platform"), F.lit("long").alias("source_id"), F.col("id").alias("pos"),
                                     F.concat(F.lit("m"), "id").alias("id"), F.lit("user").alias("role"),
                                     F.concat(F.lit("text "), "id").alias("markdown"), F.lit("").alias("created_at"))
    bundle = spark.createDataFrame([("gemini", "long", "u", "T", None, "2024-01-01T00:00:00.000Z")],
                                   "platform string, source_id string, url string, title string, source_updated_at string, extracted_at string")
    header = bundle.select(ids.revision_header(*[F.col(c) for c in ("platform", "source_id", "url", "title", "source_updated_at")],
                                               ids.HASH_VERSION)).first()[0]
    lines = [r[0] for r in messages.orderBy("pos").select(ids.message_line(F.col("id"), F.col("role"), F.col("markdown"))).collect()]
    want = hashlib.sha256((header + "\n".join(lines)).encode()).hexdigest()
    assert conversations.revise(bundle, messages).first().revision == want
    rich = bundle.withColumns({"revision": F.lit("r"), "meta": F.lit("{}")}).join(conversations.participants(bundle, messages), KEY)
    docs = rendering.serialize_conversations(rich, messages).orderBy("part").collect()
    assert len(docs) == 10 and docs[0].message_count == n and sum(r.message_count or 0 for r in docs) == n
    assert "".join(r.markdown for r in docs).count("text ") == n


def test_index_in_order(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i) for i in range(500)], "k string, pos int")
    out = ordered.index_in_order(df, ["k"], ["pos"], F.floor(F.col("pos") / 7), "n").collect()
    for k in "ab":
        assert [r.n for r in sorted((r for r in out if r.k == k), key=lambda r: r.pos)] == list(range(1, 1 + sum(r.k == k for r in out)))


def test_ingest_split_equals_whole_and_is_idempotent(spark):
    v = Views(spark, SF)
    none = spark.createDataFrame([], schemas.CONVERSATIONS), spark.createDataFrame([], schemas.REVISIONS)
    whole = archive.ingest(v.ingest_v, *none).select("seq", "status")
    con, rev = none
    out = None
    for part in (v.ingest_v.where("seq < 400"), v.ingest_v.where("seq >= 400")):
        done = archive.ingest(part, con, rev)
        out = done.select("seq", "status") if out is None else out.unionByName(done.select("seq", "status"))
        con, rev = archive.upsert_conversations(con, done, NOW), archive.append_revisions(rev, part, NOW)
    assert rows(out) == rows(whole)
    again = archive.ingest(v.ingest_v, con, rev)
    assert {r.status for r in again.select("status").distinct().collect()} == {"duplicate"}
    assert rows(archive.upsert_conversations(con, again, "later")) == rows(con)


def test_discovery_twice_enqueues_nothing_once_exported(spark):
    v = Views(spark, SF)
    first = discovery.dedupe_then_apply(v.index_v, v.discovery_v, NOW)["index"]
    done = first.withColumns({"export_state": F.lit("exported"), "latest_export_version": F.lit("2026-04-15.2")})
    assert discovery.dedupe_then_apply(done, v.discovery_v, NOW)["queueable"].count() == 0


def test_cursor_walk_returns_every_row_once(spark):
    v = Views(spark, SF)
    seen, cursor = [], None
    while True:
        page = archive.list_conversations(v.archive_v, cursor=cursor, limit=4)
        seen += [(r.platform, r.source_id) for r in page.collect()]
        cursor = archive.next_cursor(page, 4).first().next_cursor
        if cursor is None:
            break
    assert len(seen) == len(set(seen)) == v.archive_v.count()


def test_imported_files_of_one_time_are_told_apart_by_revision(spark):
    v = Views(spark, SF)
    disk = v.disk_v.where("revision like 'disk-%'").withColumns({
        "source_id": F.lit("one"), "platform": F.lit("gemini"), "extracted_at": F.lit("1996-01-02T00:00:00.000Z")})
    known = v.artifacts_v.limit(1).withColumns({
        "source_id": F.lit("two"), "platform": F.lit("gemini"), "local_status": F.lit("present"), "pos": F.lit(-5).cast("bigint"),
        "exported_at": F.lit("1996-01-02T00:00:00.000Z")})
    both = disk.limit(1).withColumns({"source_id": F.lit("two"), "revision": F.lit("a")})
    out = artifacts.reconcile(known, v.artifact_index_v, disk.unionByName(both), v.files_v)["artifacts"].where("is_latest")
    assert {r.source_id: r.revision for r in out.collect()} == {
        "one": disk.agg(F.min("revision")).first()[0], "two": known.first().revision}


def test_reconciliation_writes_one_table_and_makes_titles_once(spark, monkeypatch):
    v, written = Views(spark, SF), []
    monkeypatch.setattr(artifacts, "cut_lineage", lambda df: written.append(df) or df)
    artifacts.reconcile(v.artifacts_v, v.artifact_index_v, v.disk_v, v.files_v)
    assert len(written) == 1
    titled = artifacts._on_disk(v.disk_v, artifacts.PLATFORMS)._jdf.queryExecution().optimizedPlan().toString()
    assert titled.count("attachment|thinking") == 1


def test_rows_of_one_worker_are_spread_and_others_stay(spark):
    v = Views(spark, SF)
    held = v.queue_v.withColumns({"platform": F.lit("gemini"), "worker_id": F.lit("worker-1"), "status": F.lit("processing")})
    lease = v.leases_v.limit(1).withColumns({"platform": F.lit("gemini"), "worker_id": F.lit("worker-1")})
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, x in changed.items():
            spark.conf.set(k, x)
        for worker, want in (("worker-1", "processing"), ("gone", "pending")):
            got = queue.recover_orphans(held.withColumn("worker_id", F.lit(worker)), lease, "2024-06-01T00:00:00.000Z")
            got = got.select("status", F.spark_partition_id().alias("at")).distinct().collect()
            assert {r.status for r in got} == {want} and (worker == "gone" or len(got) > 2)
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


def test_costly_rows_of_one_read_split_are_dealt_over_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    table = Views(spark, SF, heavy=True, shares=3 * cores).events
    assert table.rdd.getNumPartitions() == 3 * cores * spark.read.parquet(f"{SF}/events.parquet").rdd.getNumPartitions()
    for name in ("collect_nested", "parse_discovery"):
        assert QUERIES[name](spark, SF).rdd.getNumPartitions() > cores


def test_a_list_payload_is_parsed_once(spark):
    rows = spark.createDataFrame([(1, '{"data":{"list":[{"id":"a"}]}}')], "page long, payload string")
    for platform in ("chatgpt", "deepseek", "aistudio"):
        plan = payloads.parse_discovery(rows, platform)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson") == 1


def test_mark_latest_bounds_live_rows(spark):
    v = Views(spark, SF)
    live = artifacts.mark_latest(v.artifacts_v, 2).where("local_status <> 'deleted'").groupBy(*KEY).count()
    assert live.where("count > 2").count() == 0


def brute_fold(items, events, force):
    items = [dict(i) for i in sorted(items, key=lambda r: r["pos"])]
    for e in sorted(events, key=lambda r: r["seq"]):
        key = f"{e['platform']}:{e['source_id']}:{e['revision_fingerprint']}"
        hit = next((i for i in items if i["key"] == key), None)
        if hit is None:
            own = [i for i in items if (i["platform"], i["source_id"]) == (e["platform"], e["source_id"])]
            if own and own[0]["status"] != "completed" and (not own[0]["source_updated_at"] or not e["source_updated_at"]):
                hit = own[0]
                if e["source_updated_at"] and not hit["source_updated_at"]:
                    hit["revision_fingerprint"], hit["key"] = e["revision_fingerprint"], key
        if hit is None:
            items.insert(0, {**{k: None for k in items[0]}, **{k: e[k] for k in e if k != "seq"}, "key": key, "status": "pending", "attempts": 0,
                             "kind": "export", "priority": "backfill", "discovered_at": NOW, "updated_at": NOW, "pos": None})
            continue
        for f in ("url", "title", "source_updated_at", "source_updated_label"):
            hit[f] = e[f] if e[f] is not None else hit[f]
        hit["updated_at"] = NOW
        if hit["status"] in ("failed", "cancelled", "skipped") or (force and hit["status"] != "processing"):
            hit.update(status="pending", priority="backfill", worker_id=None, last_error=None)
    return items


def test_fold_queue_equals_brute_force(spark):
    rng = random.Random(7)
    def fp(at):
        return f"t{at}" if at else "none"
    items = []
    for pos in range(60):
        at = rng.choice([None, "2024", "2025"])
        s, f = f"s{rng.randrange(6)}", fp(at) + rng.choice(["", "x"])
        items.append(dict(pos=pos, key=f"p:{s}:{f}{pos}", platform="p", source_id=s, url="u", title=rng.choice([None, "q"]), source_updated_at=at,
                          source_updated_label=None, revision_fingerprint=f"{f}{pos}", kind="export", priority="realtime", worker_id="w",
                          status=rng.choice(list(queue.STATUSES)), attempts=1, last_error="e", error_code=None, skip_reason=None, result_revision=None,
                          discovered_at="2024", updated_at="2024"))
    events = []
    for seq in range(400):
        at = rng.choice([None, None, "2024", "2025", "2026"])
        # A third of the events belong to one conversation.
        s = "s0" if rng.random() < 0.35 else f"s{rng.randrange(9)}"
        events.append(dict(seq=seq, platform="p", source_id=s, url=f"u{seq}", title=rng.choice([None, f"e{seq}"]), source_updated_at=at,
                           source_updated_label=None, revision_fingerprint=fp(at)))
    for force in (False, True):
        names = [x.split(" ")[0] for x in schemas.QUEUE.split(", ")]
        q = spark.createDataFrame([tuple(i[n] for n in names) for i in items], schemas.QUEUE)
        e = spark.createDataFrame([tuple(x.values()) for x in events],
                                  "seq bigint, platform string, source_id string, url string, title string, source_updated_at string, source_updated_label string, revision_fingerprint string")
        got = queue.fold_queue(q, e, NOW, priority="backfill", force=force).orderBy("pos").collect()
        want = brute_fold(items, events, force)
        keep = [n for n in names if n != "pos"]
        assert [tuple(r[n] for n in keep) for r in got] == [tuple(w[n] for n in keep) for w in want]


def test_active_branch_long_chain_cycle_and_side_branches(spark):
    chain = [("c", i, i - 1 if i else None) for i in range(300)] + [("c", 1000 + i, i) for i in range(0, 300, 5)]
    loop = [("l", 1, 3), ("l", 2, 1), ("l", 3, 2)]
    nodes = spark.createDataFrame(chain + loop, "conv string, node bigint, parent bigint")
    heads = spark.createDataFrame([("c", 299), ("l", 3), ("ghost", 5)], "conv string, node bigint")
    got = {}
    for r in branches.active_branch(nodes, heads).collect():
        got.setdefault(r.conv, {})[r.pos] = r.node
    assert got["c"] == {i: i for i in range(300)}
    assert got["l"] == {0: 1, 1: 2, 2: 3} and got["ghost"] == {0: 5}


def test_images_rule_is_idempotent_and_quality_buckets_agree(spark):
    from parley.functions.markdown import strip_images
    v = Views(spark, SF)
    once = v.messages_v.withColumn("markdown", strip_images(F.col("markdown")))
    assert rows(once.withColumn("markdown", strip_images(F.col("markdown")))) == rows(once)
    assert rows(discovery.discovery_quality(v.sweeps_v, "day")) == rows(discovery.discovery_quality(v.sweeps_v, "year"))


# ---- search index and pages -------------------------------------------------------------------------------------

def test_searches_by_grams_equal_scans_and_read_less(spark, tmp_path):
    from parley.operators import archive, search
    rows = [("p", f"id-{i}", f"Titel über {i * 7919 % 1000} {'xyzzy' if i % 500 == 3 else 'plain'} 100%_\\ done", f"2030-01-{i % 28 + 1:02d}")
            for i in range(4000)] + [("p", "nul", None, "2030-01-01"), ("p", "", "", "2030-01-02")]
    table = spark.createDataFrame(rows, "platform string, source_id string, title string, updated_at string")
    root = str(tmp_path / "grams")
    spark.conf.set("parquet.block.size", "16384")
    spark.conf.set("parquet.page.size", "1024")
    try:
        search.write_postings(table.where("source_id < 'id-2'"), root)
        search.write_postings(table.where("source_id >= 'id-2'"), root)
    finally:
        spark.conf.unset("parquet.block.size")
        spark.conf.unset("parquet.page.size")
    index = spark.read.parquet(root)
    for q in ("xyzzy", "XYZZY 100", "zzy%do_e", "ÜBER 7", "über 7", "%_\\", "a", "", "%%", "nul", "no such text"):
        plain = archive.list_conversations(table, q=q, limit=100).collect()
        assert archive.list_conversations(table, q=q, limit=100, postings=index).collect() == plain, q
    hits = index.where(F.col("gram").isin(*search.search_grams("xyzzy")))
    hits.collect()
    read = _rows_scanned(hits)
    assert 0 < read < index.count() / 4


def _rows_scanned(df):
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


def test_pages_equal_a_sorted_table(spark):
    from parley.operators import analytics
    rows = [(i, None if i % 7 == 0 else f"w{i % 5}", (i * 37) % 11) for i in range(1003)]
    table = spark.createDataFrame(rows, "id int, worker string, n int")
    order = [("worker", True), ("n", False), ("id", True)]
    whole = table.orderBy(F.col("worker").asc(), F.col("n").desc(), "id").collect()
    for number, start in ((1, 0), (0, 0), (2, 90), (7, 540), (12, 990), (99, 990)):
        assert analytics.page(table, order, number, 90).collect() == whole[start:start + 90]
    assert analytics.page(table.limit(0), order, 3, 10).collect() == []
    same = spark.createDataFrame([(i, "w", 1) for i in range(300)], "id int, worker string, n int")
    assert [r.id for r in analytics.page(same, order, 3, 100).collect()] == list(range(200, 300))


def test_file_lists_come_whole_in_stretches(spark, monkeypatch):
    import json

    from parley.operators import assets
    monkeypatch.setattr(assets, "LISTED", 7)
    body = "\n".join(f"> [attachment] [file {i}](https://files.test/{i}.pdf)" for i in range(20))
    stored = {"linkedAttachments": [{"messageId": "m", "kind": "resource", "title": f"r{i}", "resourceId": str(i)} for i in range(4)]}
    bundles = spark.createDataFrame([("p", "a", "u", "T", "r", json.dumps(stored)), ("p", "b", "u", "T", "r", "{}")],
                                    "platform string, source_id string, url string, title string, revision string, meta string")
    messages = spark.createDataFrame([("p", "a", 0, "m", "user", body), ("p", "b", 0, "m", "user", "plain")],
                                     "platform string, source_id string, pos long, id string, role string, markdown string")
    out = assets.prepare_bundles(bundles, messages, "1.0")
    got = {}
    for r in out["lists"].orderBy("name", "part").collect():
        assert r.source_id == "a" and len(json.loads(r.items)) <= 7
        got.setdefault((r.name, r.parts), []).extend(json.loads(r.items))
    assert [a["sourceUrl"] for a in got["embeddedAssets", 3]] == [f"https://files.test/{i}.pdf" for i in range(20)]
    assert [a["title"] for a in got["linkedAttachments", 4]] == [f"r{i}" for i in range(4)] + [f"file {i}" for i in range(20)]
    metas = {r.source_id: json.loads(r.meta) for r in out["bundles"].collect()}
    assert len(metas["a"]["embeddedAssets"]) == 7 and metas["b"]["embeddedAssets"] == []
