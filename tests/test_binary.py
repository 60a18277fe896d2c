"""Stores of sorted tables and messages in wire format: round trips, cuts, and what is broken."""

import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.functions import wire
from colloquy.plans import binaries
from colloquy.sources import sorted_tables as T


def laid(folder, name, pieces):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(b"".join(pieces))
    return (folder / name).stat().st_size


def read(folder, part_bytes=T.PART_BYTES):
    reader = T.Reader({"path": str(folder), "partBytes": str(part_bytes)})
    parts = reader.partitions()
    return [row[1:] for part in parts for row in reader.read(part)], len(parts)


def test_table_by_hand(tmp_path):
    """A table put together byte by byte: two entries that share a prefix, one restart point."""
    key = lambda k, s, kind: k + struct.pack("<Q", s << 8 | kind)
    a, b = key(b"apple", 7, 1), key(b"apply", 9, 0)
    data = bytes([0, len(a), 3]) + a + b"red" + bytes([4, len(b) - 4, 0]) + b[4:] + struct.pack("<II", 0, 1)
    index = bytes([0, len(b), 2]) + b + bytes([0, len(data)]) + struct.pack("<II", 0, 1)
    meta = struct.pack("<II", 0, 1)
    at_meta = len(data) + 5
    at_index = at_meta + len(meta) + 5
    footer = bytes([at_meta, len(meta), at_index, len(index)]).ljust(40, b"\0") + bytes.fromhex("57fb808b247547db")
    laid(tmp_path, "000003.ldb", [data, bytes(5), meta, bytes(5), index, bytes(5), footer])
    assert read(tmp_path)[0] == [(7, False, b"apple", b"red"), (9, True, b"apply", None)]


def test_log_by_hand(tmp_path):
    write = struct.pack("<QI", 41, 2) + b"\x01\x01k\x02v1" + b"\x00\x01k"
    laid(tmp_path, "000004.log", [struct.pack("<IHB", 0, len(write), 1), write])
    assert read(tmp_path)[0] == [(41, False, b"k", b"v1"), (42, True, b"k", None)]


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.binary(max_size=12), st.tuples(st.booleans(), st.binary(max_size=300)), max_size=150), st.integers(1, 3000))
def test_table_in_any_cut(tmp_path_factory, entries, part_bytes):
    """Every entry comes out once, wherever the ranges are cut."""
    folder = tmp_path_factory.mktemp("table")
    rows = [(i, d, k, None if d else v) for i, (k, (d, v)) in enumerate(sorted(entries.items()))]
    laid(folder, "000007.ldb", binaries.table_bytes(iter(rows)))
    assert read(folder, part_bytes)[0] == rows


@pytest.mark.parametrize("seed", range(6))
def test_log_in_any_cut(tmp_path, seed):
    """Records over many blocks, ends of blocks too short for a head, and a range a block."""
    rng = random.Random(seed)
    rows = [(2 * i, rng.random() < 0.2, f"k{i}".encode(), rng.randbytes(rng.choice([0, 5, 900, T.LOG_BLOCK - 36, 100_000]))) for i in range(60)]
    rows = [(s, d, k, None if d else v) for s, d, k, v in rows]
    size = laid(tmp_path, "000009.log", binaries.log_bytes(binaries.writes(iter(rows))))
    got, n = read(tmp_path, T.LOG_BLOCK)
    assert got == rows and n == -(-size // T.LOG_BLOCK)
    whole = (tmp_path / "000009.log").read_bytes()
    (tmp_path / "000009.log").write_bytes(whole[:-3])
    assert read(tmp_path, T.LOG_BLOCK)[0] == rows[:-1]


def test_manifest_and_odd_files(tmp_path):
    row = lambda s, v: iter([(s, False, b"k", v)])
    assert read(tmp_path)[0] == [] and read(tmp_path / "none")[0] == []
    for n, v in ((5, b"alive"), (3, b"removed")):
        laid(tmp_path, f"{n:06d}.ldb", binaries.table_bytes(row(n, v)))
    laid(tmp_path, "000004.log", binaries.log_bytes(binaries.writes(row(90, b"earlier"))))
    laid(tmp_path, "000009.log", [])
    laid(tmp_path, "LOCK", [])
    assert {v for *_, v in read(tmp_path)[0]} == {b"alive", b"removed", b"earlier"}
    laid(tmp_path, "MANIFEST-000001", [binaries.manifest_bytes([5], [3], 9)])
    laid(tmp_path, "CURRENT", [b"MANIFEST-000001\n"])
    assert read(tmp_path)[0] == [(5, False, b"k", b"alive")]
    laid(tmp_path / "other", "000001.ldb", [b"no table, but long enough to hold a footer of its own size"])
    with pytest.raises(ValueError, match="no sorted table"):
        read(tmp_path)


def test_newest_of_stores(spark, tmp_path):
    """Overwritten and deleted keys, in two stores whose sequences overlap; a key that is written often."""
    T.register(spark)
    rows = [(i, False, b"often", str(i).encode()) for i in range(3000)]
    laid(tmp_path / "a", "000002.ldb", binaries.table_bytes(iter([(5000, True, b"gone", None), (1, False, b"gone", b"x"), (7, False, b"kept", b"y")])))
    laid(tmp_path / "a", "000003.log", binaries.log_bytes(binaries.writes(iter(rows))))
    laid(tmp_path / "b", "000002.log", binaries.log_bytes(binaries.writes(iter([(9, False, b"gone", b"z"), (10, False, b"kept", b""), (11, True, b"often", None)]))))
    records = spark.read.format("sorted_tables").option("path", str(tmp_path)).option("partBytes", str(T.LOG_BLOCK)).load()
    assert records.rdd.getNumPartitions() > 3
    got = T.newest(records.selectExpr("*", "regexp_extract(file, '/([ab])/', 1) AS store"), "store").collect()
    assert {(r.store, bytes(r.key), bytes(r.value), r.sequence) for r in got} == {("a", b"kept", b"y", 7), ("a", b"often", b"2999", 2999), ("b", b"gone", b"z", 9), ("b", b"kept", b"", 10)}


def message(tree):
    """The bytes of a message of (number, value): numbers as varints, text and nested messages with their length."""
    out = b""
    for number, value in tree:
        if isinstance(value, int):
            out += binaries.packed(number << 3) + binaries.packed(value & (1 << 64) - 1)
        else:
            raw = value.encode() if isinstance(value, str) else value if isinstance(value, bytes) else message(value)
            out += binaries.packed(number << 3 | 2) + binaries.prefixed(raw)
    return out


def leaves(tree, above=""):
    for number, value in tree:
        path = f"{above}{number}"
        if isinstance(value, list):
            yield from leaves(value, path + ".")
        elif isinstance(value, int):
            yield path, "varint", value, None
        elif isinstance(value, str):
            yield path, "text", None, value
        else:
            yield path, "bytes", None, value.hex()


NUMBER = st.integers(1, 5000)
PLAIN = st.text(st.characters(min_codepoint=32, exclude_categories=["Cs", "Cc"]), max_size=200)
# A nested message begins with a small number, whose tag is a control character, as no text here does.
TREE = st.recursive(st.lists(st.tuples(NUMBER, st.one_of(PLAIN, st.integers(-(1 << 63), (1 << 63) - 1), st.just(b"\xff\xfe"))), max_size=5), lambda inner: st.lists(st.tuples(NUMBER, st.one_of(PLAIN, inner.map(lambda t: [(1, 3), *t]))), max_size=5), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(TREE, max_size=4))
def test_walk_of_nested_messages(trees):
    """A batch of messages gives the leaves of each, in order."""
    assert wire.walk([message(t) for t in trees]) == [list(leaves(t)) for t in trees]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=60), max_size=4))
def test_walk_of_anything(bodies):
    got = wire.walk(bodies)
    assert len(got) == len(bodies) and got == [wire.walk([b])[0] for b in bodies]


def test_walk_of_odd_bodies():
    body = message([(1, 5), (2, "a text"), (3, [(1, 300), (2, "deep")])])
    said = list(leaves([(1, 5), (2, "a text"), (3, [(1, 300), (2, "deep")])]))
    framed = b"\0" + len(body).to_bytes(4, "big") + body
    assert wire.walk([framed + framed, body[:-2], b"", b"\x00\x01", b"\x0b"]) == [said + said, said[:2], [], [], []]
    fixed = bytes([1 << 3 | 5]) + (7).to_bytes(4, "little") + bytes([2 << 3 | 1]) + (-3).to_bytes(8, "little", signed=True)
    assert wire.walk([fixed]) == [[("1", "fixed32", 7, None), ("2", "fixed64", -3, None)]]
    # Text with control characters that reads as no message stays text; a length beyond the body ends it.
    assert wire.walk([message([(1, "\x01\x02\x03")])]) == [[("1", "text", None, "\x01\x02\x03")]]
    assert wire.walk([b"\x0a\xff\xff\xff\xff\xff\xff\xff\xff\xff\x01ab"]) == [[]]


def test_summaries(spark):
    who = "0190aaaa-0000-7000-8000-00000000beef"
    rows = [
        (1, message([(1, f"id {who}"), (2, [(1, 9), (2, "with claude-x1 inside")]), (3, "What is rain?"), (4, [(1, 2), (2, "What is rain?")]), (5, "version 1.2"), (6, "version 1.2")])),
        (2, message([(1, 1), (2, "<user_request> Sum\nthem up </user_request>"), (3, "twice here"), (4, "twice here")])),
        (3, message([(1, "error here"), (2, "error here"), (3, who), (4, who), (5, "once only")])), (4, None), (5, b""),
        (6, message([(1, 1)] + [(2, f"word number {i}") for i in range(3000)] + [(2, "word number 7")])),
    ]
    got = {r.id: r for r in wire.summaries(spark.createDataFrame(rows, "id int, body binary")).collect()}
    assert {i: r.prompt for i, r in got.items()} == {1: "What is rain?", 2: "Sum\nthem up", 3: None, 4: None, 5: None, 6: "word number 7"}
    assert (got[1].identifier, got[1].model_name, got[3].identifier) == (who, "claude-x1", who) and got[2].model_name is None
    assert got[4].fields is None and got[5].fields == [] and len(got[6].fields) == 3002
    runs = spark.createDataFrame([("ab�hello you\x01\x02日本語です文字列です", 1)], "t string, i int").select(wire.readable_runs(wire.F.col("t")).alias("r")).first().r
    assert runs[0] == "hello you"


def test_packing(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 127, 128, 300, 16384, 2**40)], "n long")
    assert all(bytes(r[1]) == binaries.packed(r[0]) for r in rows.select("n", binaries.varint(wire.F.col("n"))).collect())
