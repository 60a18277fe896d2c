"""What a task of the positional index holds does not grow with the number of shards or of test windows."""

import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from colloquy.llm import common, decontaminate

KIND = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_a_shard_is_a_row_group(spark):
    docs = spark.range(0, 12, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("some words here "), 100_000), F.lit("one two three")).alias("text"))
    items = spark.createDataFrame([(1, "one two three"), (2, "words here some"), (3, "not in there")], "item_id long, text string")
    folder, before = Path(common.shared_folder(spark).removeprefix("file://")), spark.conf.get(KIND, None)
    for block in (decontaminate.BLOCK_BYTES, 15):
        known = set(folder.glob("positional-index-*/*.parquet"))
        got = decontaminate.contamination(docs, items, block_bytes=block).select("doc_id", "n_words", "n_hit", F.array_sort("items").alias("items")).collect()
        assert sorted(tuple(r) for r in got) == [(i, 300_003, 300_000, ["1", "2"]) for i in range(12)]
        files = [pq.ParquetFile(p) for p in set(folder.glob("positional-index-*/*.parquet")) - known]
        assert sum(f.metadata.num_rows for f in files) == 6 and all(f.num_row_groups == f.metadata.num_rows for f in files)
        # The writer would hold what its statistics refer to, whole rows, until the file ends.
        assert not any(c.statistics and c.statistics.has_min_max for f in files for g in range(f.num_row_groups) for c in map(f.metadata.row_group(g).column, range(f.metadata.num_columns)))
        assert spark.conf.get(KIND, None) == before


def test_arrow_batches(spark):
    texts = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("a word "), 5_000).alias("text"))
    size_of = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    with common.arrow_batches(spark, "1m"):
        sizes = [r.n for r in texts.mapInArrow(size_of, "n long").collect()]
    assert len(sizes) >= 10 and max(sizes) < 2 << 20
    spark.conf.set(KIND, "4m")
    try:
        with common.arrow_batches(spark, "1m"):
            pass
        assert spark.conf.get(KIND) == "4m"
    finally:
        spark.conf.unset(KIND)


def test_places_in_steps():
    """Windows of common words: 5 million places in one shard, and lists longer than a step."""
    rng = np.random.default_rng(4)
    text = b" ".join(b"w%d" % x for x in rng.integers(0, 40, 60_000))
    test = decontaminate.make_windows([(str(i), b" ".join(b"w%d" % x for x in rng.integers(0, 40, 4))) for i in range(3_500)], 10)
    bounds, *lists = decontaminate.shard([text, None, text[:1000]])
    own = decontaminate.postings(test, *lists)
    tracemalloc.start()
    got = decontaminate.intersect(test, int(bounds[-1]), *own, 2, bounds)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20
    few = np.random.default_rng(1).choice(len(test.windows), 20, replace=False)
    words = text.split()
    for w in few:
        item = [k for k, v in sorted(test.vocabulary.items(), key=lambda x: x[1])]
        key = [item[t] for t in test.windows[w, :4]]
        want = [i for i in range(len(words) - 3) if words[i : i + 4] == key]
        assert sorted(x for x in got[1][got[0] == w] if x < bounds[1]) == want
    small = decontaminate.make_windows([(str(i), b" ".join(b"w%d" % x for x in rng.integers(0, 40, 3))) for i in range(8)], 10)
    own = decontaminate.postings(small, *lists)
    whole, steps = ([sorted(zip(*map(np.ndarray.tolist, x))) for x in (r[:2], r[2:])] for r in (decontaminate.intersect(small, int(bounds[-1]), *own, 2, bounds, n) for n in (1 << 30, 97)))
    assert whole == steps and all(whole)
