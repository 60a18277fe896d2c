"""Proximity matches against brute force, however documents and test items are dealt."""

from collections import Counter

import numpy as np

from colloquy.llm import decontaminate


def brute(docs, items, window=10, slop=20):
    counts = Counter(w for _, t in items for w in t.split())
    out = {}
    for d, text in docs:
        places = {}
        for i, w in enumerate(text.split()):
            places.setdefault(w, []).append(i)
        out[d] = set()
        for item, t in items:
            words = t.split()
            for i in range(max(1, len(words) - window + 1)):
                rare = sorted(words[i : i + window], key=counts.__getitem__)[:3]
                if any(all(any(abs(q - p) <= slop for q in places.get(w, [])) for w in rare[1:]) for p in places.get(rare[0], [])):
                    out[d].add(str(item))
    return out


def test_proximity(spark):
    rng = np.random.default_rng(2)
    items = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, n) % 400)) for i, n in enumerate([3, 1, 2, 14, 25, 12, 30, 11])]
    docs = []
    for i in range(120):
        words = [f"w{x}" for x in rng.zipf(1.3, 60) % 400]
        passage = items[i % len(items)][1].split()
        passage[int(rng.integers(len(passage)))] = f"other{i}"
        docs.append((i, " ".join([*words[:30], *passage, *words[30:]])))
    want = brute(docs, items)
    assert any(want.values()) and not all(len(x) == len(items) for x in want.values())
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    for parts, block in ((1, 1 << 20), (40, 1 << 20), (3, 150)):
        got = decontaminate.contamination(table.repartition(parts), bench, block_bytes=block).collect()
        assert {r.doc_id: set(r.near_items) for r in got} == want
