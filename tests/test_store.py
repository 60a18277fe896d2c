"""The session store: replays, splits into batches, enrichment, forks, upgrades."""

import json

from colloquy.streaming import store

COLUMNS = [f.split()[0] for f in store.MESSAGE.split(", ")]


def message(role, text, **more):
    return tuple((dict.fromkeys(COLUMNS) | {"role": role, "text": text} | more)[c] for c in COLUMNS)


def result(key, pair, at, messages, **more):
    base = {"session_key": key, "pair_id": pair, "source_id": "proxy", "created_via": "proxy", "created_at": at, "provider": "openai", "tool_family": "api", "title_hint": None, "messages": messages} | more
    return tuple(base[c] for c in "session_key pair_id source_id created_via created_at provider tool_family title_hint messages".split())


PICTURE = json.dumps({"attachments": [{"type": "image_url", "url": "https://x/1.png"}]})
RESULTS = [
    result("a", "p1", 1.0, [message("user", "go on"), message("assistant", "Sure, here is more of it.", parent_uuid="u1")], provider="unknown", created_via="browser_extension_network"),
    result("a", "p2", 2.0, [message("user", "go on"), message("assistant", "Sure, here is more of it.", model_name="m-1", parent_uuid="u1"), message("user", "go on"), message("assistant", "And the end.", ts=2.5)], title_hint="T" * 300),
    result("a", "p3", 3.0, [message("assistant", "Another answer altogether.", parent_uuid="u1")]),
    result("a", "p4", 4.0, [message("user", "report.pdf\nPDF\ngo on", content_json=PICTURE)]),
    result("b", "p5", 1.5, [message("user", "{'content_type': 'text', 'parts': ['Hello there']}"), message("user", "Hello there")], title_hint='{"a"'),
    result("b", "p6", 2.5, [message("user", "Hello there, [Image]"), message("user", "Hello there", token_estimate=7)], title_hint="Greeting"),
    result(None, "p7", 1.0, [message("user", None)]),
    result("", "p8", 1.0, []),
]


def folded(spark, tmp_path, name, batches):
    source, folder = f"{tmp_path}/{name}-in", f"file://{tmp_path}/{name}"
    for number, batch in enumerate(batches):
        spark.createDataFrame(batch, store.RESULT).coalesce(1).write.mode("append").parquet(source)
        store.run_available(spark.readStream.schema(store.RESULT).parquet(source), folder)
    sessions, messages = store.stored(spark, folder)
    return sorted(map(tuple, sessions.collect())), sorted(map(tuple, messages.collect())), sessions, messages


def test_batches_and_replays_equal_one_batch(spark, tmp_path):
    one = folded(spark, tmp_path, "one", [RESULTS])
    two = folded(spark, tmp_path, "two", [RESULTS[:2] + RESULTS[4:5], RESULTS[2:4] + RESULTS[5:], RESULTS[:2] + RESULTS[4:]])
    assert one[:2] == two[:2]
    sessions = {r.session_key: r for r in one[2].collect()}
    assert len(one[0]) == 4 and (sessions["a"].provider, sessions["a"].created_via, sessions["a"].title_hint) == ("openai", "proxy", "T" * 200)
    assert (sessions["a"].message_count, sessions["a"].started_at, sessions["a"].ended_at, sessions["b"].title_hint) == (5, 1.0, 3.0, "Greeting")
    rows = {(r.session_id, r.branch_id == store.MAIN, r.turn_index): r for r in one[3].where("text is not null").collect()}
    a, b = sessions["a"].id, sessions["b"].id
    main = [rows[a, True, i] for i in range(4)]
    assert [r.role for r in main] == ["user", "assistant", "user", "assistant"] and main[1].model_name == "m-1" and main[3].ts == 2.5
    assert main[0].text == "go on" and "1.png" in main[0].content_json and main[2].content_json is None
    fork = rows[a, False, 0]
    assert fork.text == "Another answer altogether." and fork.branch_parent_id == main[1].id
    assert [rows[b, True, i].text for i in range(3)] == ["Hello there", "Hello there", "Hello there, [Image]"] or rows[b, True, 0].token_estimate == 7
    store.compact(spark, f"file://{tmp_path}/one", f"file://{tmp_path}/small")
    assert sorted(map(tuple, store.stored(spark, f"file://{tmp_path}/small")[1].collect())) == one[1]


def test_a_batch_run_again_replaces_its_changes(spark, tmp_path):
    folder = f"file://{tmp_path}/again"
    change = spark.createDataFrame([("session", "s", 1, "k", *[None] * 5, 1.0, 1.0, 0, *[None] * 11)], store.CHANGE)
    for _ in range(2):
        store.merge_into(folder)(change, 7)
    assert spark.read.parquet(f"{folder}/changes").count() == 1 and store.stored(spark, folder)[0].count() == 1


def test_texts():
    assert store.unwrapped("{'parts': ['a', {'content_type': 'image_asset_pointer'}, {'text': 'b'}, {}, '']}") == "a [Image] b"
    assert store.unwrapped("{'parts': broken") == "{'parts': broken" and store.unwrapped(None) == ""
    assert store.bare_text("[Image]\n\n[file: x.pdf]\nquestion") == "question" and store.bare_text("[image]") == "[image]"
    assert store.bare_text("a.pdf\nPDF\nask") == "ask" and store.bare_text("a.pdf\n" + "x" * 40) == "x" * 40 and store.bare_text("a.unknown\nb") == "a.unknown\nb"
    assert store.dedup_key("user", "x" * 300) == "user:" + "x" * 200
