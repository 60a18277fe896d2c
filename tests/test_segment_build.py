"""Building a segment: postings of a row are gathered in the task that reads it, and rows of one key are one row of a search."""

import pytest

from colloquy.operators import segments as W

ROWS = [(1, ["b", "a", "b", "é", "b"]), (2, []), (3, ["a"] * 7 + ["z"]), (None, ["a", "z"])] + [(k, [f"w{i % 9}" for i in range(k)]) for k in range(10, 40)]


def wanted():
    return sorted(((W.bucket_of(t), t, k, len(words), [i for i, w in enumerate(words) if w == t]) for k, words in ROWS for t in set(words)), key=str)


def test_postings_without_a_shuffle(spark):
    found = W.postings_of(spark.createDataFrame(ROWS, "key long, words array<string>").coalesce(1))
    assert sorted(map(tuple, found.collect()), key=str) == wanted()
    assert "Exchange" not in found.sortWithinPartitions("bucket", "term")._jdf.queryExecution().executedPlan().toString()
    assert W.postings_of(spark.createDataFrame([], "key string, words array<string>")).count() == 0


@pytest.mark.parametrize("size", [1, 6, 25])
def test_pieces(size):
    """Rows are gathered in pieces of about so many words, a longer row whole."""
    import pyarrow as pa

    ends = W.np.cumsum([len(w) for _, w in ROWS])
    parts = list(W.pieces(ends, size))
    assert [i for a, b in parts for i in range(a, b)] == list(range(len(ROWS)))
    assert all(b - a == 1 or ends[b - 1] - (ends[a - 1] if a else 0) <= size for a, b in parts)
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in ROWS], pa.int64()), pa.array([w for _, w in ROWS], pa.list_(pa.string()))], ["key", "words"])
    got = [tuple(r.values()) for a, b in parts for r in W.gathered(batch.slice(a, b - a), W.BUCKETS).to_pylist()]
    assert sorted(got, key=str) == wanted()


def test_one_key_in_two_files_is_one_row(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    W.add_segment(spark.createDataFrame([(1, "red fish"), (1, "red cat red"), (2, "blue cat"), (3, "cow")], "id long, body string").repartition(4), "id", "body", folder, "a")
    index = W.Index(spark, folder)
    assert [(r.key, len(r.hits)) for r in index.search("red cat").collect()] == [(1, 4)] and [r.key for r in index.search("cow").collect()] == [3]
    assert tuple(index.figures().first()) == (4, 8, 3)
