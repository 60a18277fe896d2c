"""Flat attributes of spans and the messages they stand for."""

import random

from pyspark.sql import functions as F

from colloquy.operators import attributes

COLUMNS = f"pair_id string, turn_index int, ts double, role string, content_text string, parts array<{attributes.PART}>"


def test_round_trip(spark):
    rng = random.Random(3)
    kinds = [("image_url", None, "https://x/1", None), ("text", "a.b.0", None, None), ("file", None, None, '{"a": 1}')]
    rows = []
    for pair in range(12):
        for turn in range(rng.randrange(1, 25)):
            rows.append((f"p{pair}", turn, float(turn), rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["text", "llm.input_messages.0.message.role", "", None]), [rng.choice(kinds) for _ in range(rng.randrange(13))]))
    found = attributes.messages_of(attributes.spans(spark.createDataFrame(rows, COLUMNS).repartition(5)))
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.pair_id, r.turn_index)):
        got.setdefault(r.pair_id, []).append((r.role, r.content_text, [tuple(p) for p in r.parts]))
    want = {}
    for output in (False, True):
        for r in sorted(rows, key=lambda r: (r[0], r[1])):
            if (r[3] == "assistant") == output:
                want.setdefault(r[0], []).append((r[3], r[4], r[5]))
    assert got == want


def test_paths_of_any_order_and_kind(spark):
    side = "llm.output_messages"
    given = {f"{side}.10.message.role": "assistant", f"{side}.2.message.content": "two", f"{side}.2.message.contents.11.message_content.type": "image", f"{side}.2.message.contents.3.message_content.text": "no type", f"{side}.x.message.role": "no", "llm.model_name": "m", f"{side}.2.other": "no"}
    rows = spark.createDataFrame([("a", 1.0, given), ("b", 1.0, {}), ("c", 1.0, None), ("a", 1.0, given)], "pair_id string, start_time double, attributes map<string,string>")
    got = [(r.pair_id, r.turn_index, r.role, r.content_text, [tuple(p) for p in r.parts]) for r in attributes.messages_of(rows).orderBy("turn_index").collect()]
    one = [("a", 0, None, "two", [("unknown", None, None, ""), ("image_url", None, "", None)]), ("a", 1, "assistant", None, [])]
    assert sorted(got, key=str) == sorted(one * 2, key=str)
    assert attributes.spans(spark.createDataFrame([], COLUMNS)).count() == 0
