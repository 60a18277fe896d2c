"""The operators against brute force on small rows, with nulls, empty and long texts, repeats, ties and clashing columns."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
from colloquy.llm import common, decontaminate, html_extract, language, licenses, media, mixing, simhash, token_count, toxicity, url_filter

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, an empty text, a very long one, repeats, and columns whose names the operators use inside."""
    long = " ".join(f"word{i % 977}" for i in range(200_000))
    rows = [(1, None, None, None, None), (None, "some text here", "en", "a", 14), (2, "", "en", "a", 0), (3, long, "en", "b", len(long)), (4, "same same", "en", "b", 9), (4, "same same", "en", "b", 9), (None, None, None, None, None)]
    extra = ", row string, fp string, label int, score double, size string, toxicity_score int, lang_pred int, copy int, n_words int, its_id int, own int"
    return spark.createDataFrame([(*r, "r", "f", 1, 0.5, "s", 2, 3, 4, 5, 6, 7) for r in rows], DOC + extra)


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    out, word = [], ""
    for c in lowered + " ":
        if ord(c) >= 128 or c.isdigit() or "a" <= c <= "z":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def test_licenses(spark, docs):
    said = [(1, "MIT   License, apache-license\nmit license"), (2, None), (3, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0"), (4, "mit licenses"), (5, "SPDX-License-Identifier: see the file LICENSE\nSPDX-License-Identifier: 42"), (6, "// SPDX-License-Identifier: MIT OR GPL-3.0-or-later */"), (7, "SPDX-License-Identifier: MIT AND GPL-3.0")]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(said, "doc_id long, text string").unionByName(docs.selectExpr("doc_id + 1000 as doc_id", "text"))).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (6, 3, 0, 4, "apache,mit")
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].labels) == (0, 0, None, "")
    assert got[3].labels == "apache-2.0,gpl-2.0,mit" and got[3].accepted is False and got[4].n_base == 0
    assert got[5].labels == "" and got[5].expressions == [] and got[5].accepted is None
    assert got[6].labels == "gpl-3.0-or-later,mit" and got[6].accepted is True
    assert got[7].labels == "gpl-3.0,mit" and got[7].accepted is False
    for r in docs.collect():
        words, g = words_of(r.text), got[r.doc_id + 1000]
        starts = [i for i in range(len(words)) for p in licenses.BASE if words[i : i + len(p.split())] == p.split()]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(words), len(starts), min(starts, default=None), max(starts, default=None))
        assert 0 <= g.score <= 1 and set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(","))


def test_license_scan_of_odd_rows(spark, odd):
    got = licenses.license_scan(odd).collect()
    assert len(got) == 7 and licenses.license_scan(odd.limit(0)).count() == 0
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words) for r in got) == [(False, 1, 0), (False, 2, 0), (False, 3, 200_000), (False, 4, 2), (False, 4, 2), (True, 0, 0), (True, 0, 3)]
    named = spark.createDataFrame([("17", "mit license"), ("x", None)], "doc_id string, text string").where("doc_id = '17'")
    assert [(r.doc_id, r.n_base) for r in licenses.license_scan(named).collect()] == [(17, 1)]


def test_license_expressions():
    postfix = licenses.parse("MIT OR GPL-2.0 WITH Classpath-exception-2.0 AND (BSD-3-Clause or ISC)")
    assert postfix == ["MIT", "GPL-2.0", "Classpath-exception-2.0", "WITH", "BSD-3-Clause", "ISC", "OR", "AND", "OR"]
    assert licenses.evaluate(postfix, {"mit"}) and not licenses.evaluate(postfix, {"GPL-2.0", "ISC"}) and licenses.evaluate(postfix, {"GPL-2.0", "classpath-exception-2.0", "isc"})
    for wrong in ("MIT AND", "(MIT", "", "42", "(MIT OR ISC) WITH LLVM-exception", "MIT WITH (LLVM-exception)", "MIT WITH ISC", "LLVM-exception", "not a licence"):
        assert licenses.parse(wrong) is None, wrong
    assert licenses.evaluate(licenses.parse("GPL-2.0+"), {"gpl-2.0"}) and licenses.parse("LicenseRef-own OR MIT") == ["LicenseRef-own", "MIT", "OR"]


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    rng = np.random.default_rng(3)
    letters = "abc▁é"
    pieces = {c: float(-rng.random() * 4 - 1) for c in "abc▁"} | {"".join(p): float(-rng.integers(1, 6)) for n in (2, 3) for p in itertools.product("abc", repeat=n) if rng.random() < 0.6} | {"▁a": -1.5, "▁ab": -2.0}
    model = token_count.Unigram(pieces, fallback=False)
    theirs = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces.items()], unk_id=0, byte_fallback=False))
    for _ in range(400):
        text = "".join(rng.choice(list(letters[:4]), rng.integers(1, 14)))
        if "▁" in text.lstrip("▁"):
            continue
        assert model.count(text) == len(theirs.encode(text).ids), text
    # Whole texts with characters that are no pieces, in runs too.
    theirs.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    for _ in range(300):
        text = " ".join("".join(rng.choice(list("abcxyé"), rng.integers(1, 8))) for _ in range(rng.integers(1, 9)))
        assert token_count.count_tokens(text, token_count.Counts(model)) == len(theirs.encode(text).ids), text


def best_segmentation(model, pieces, segment):
    """Viterbi over all pieces that start at each place, one by one, with the whole way kept."""
    ways = [(0.0, [])] + [None] * len(segment)
    for end in range(1, len(segment) + 1):
        for start in range(end):
            piece = segment[start:end]
            if ways[start] and (piece in pieces or len(piece) == 1):
                score = ways[start][0] + pieces.get(piece, model.unknown)
                if ways[end] is None or score > ways[end][0]:
                    ways[end] = score, [*ways[start][1], piece]
    return sum(1 if p in pieces else len(p.encode()) for p in ways[-1][1])


def test_token_counts_of_the_query(spark, docs, odd):
    """The query's own vocabulary against plain Viterbi, each distinct word of all texts."""
    import sentencepiece

    path = "/opt/tokenizers/piece_bpe_32k.model"
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    model, known = token_count.load(path), {}
    rows = docs.where("length(text) < 4000").select("doc_id", "text")
    texts = dict(map(tuple, rows.collect()))
    for r in token_count.token_counts(rows, path).collect():
        text, want = texts[r.doc_id] or "", 0
        for word in text.split(" ") if text else []:
            if word not in known:
                known[word] = best_segmentation(model, pieces, "▁" + word)
            want += known[word]
        if "  " not in f" {text} ":
            assert (r.n_tokens, r.n_bytes) == (want, len(text.encode())), r.doc_id
    got = token_count.token_counts(odd, path).collect()
    assert len(got) == 7 and token_count.token_counts(odd.limit(0), path).count() == 0 and all((r.n_tokens > 0) == (r.n_bytes > 0) for r in got)


def test_many_url_rules(spark):
    """More rules than one segment of the filter holds."""
    rules = spark.range(50_000).selectExpr("concat('h', id, '.org') AS host", "concat('/p', id % 7, '/') AS path", "'block' AS verdict")
    pages = spark.range(2000).selectExpr("id AS page_id", "concat('http://x.h', id * 50, '.org/p', id % 7, '/z') AS url")
    got = {r.page_id: r.rule for r in url_filter.url_verdicts(pages, rules).collect()}
    assert got == {i: f"h{i * 50}.org/p{i % 7}/" if i * 50 < 50_000 and i * 50 % 7 == i % 7 else None for i in range(2000)}
    assert url_filter.url_verdicts(pages.limit(0), rules).count() == 0 and url_filter.url_verdicts(pages, rules.limit(0)).where("verdict = 'allow'").count() == 2000
    held = [x for part in url_filter.build_filter(rules.selectExpr("host || path AS rule"), url_filter.blocks_for(50_000)).first().held for x in part]
    assert len(held) == 8192 and 0.2 < sum(bin(x % 2**64).count("1") for x in held) / (64 * 8192) < 0.5


def test_urls(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    urls = [None, "", "no scheme", "http://Example.COM/en/x?q#f", "https://www.example.com/en/", "https://a.www.example.com/en/y", "http://x.net/fr/1", "http://net/es/", "http://notexample.com/en/", "http://example.com", "http://example.org/en/", "http://x.net/fr?/fr/", "a://b.com/://c.net/es/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_filter.url_verdicts(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, u in enumerate(urls):
        head, sep, rest = (u or "").partition("://")
        host = rest
        for c in "/?#":
            host = host.partition(c)[0]
        tail = rest[len(host) :]
        path = tail.partition("?")[0].partition("#")[0] if sep else ""
        host = host.lower() if sep else ""
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits, default=(0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, want[1], want[2]), u
    plan = url_filter.url_verdicts(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_media(spark, docs, odd):
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = media.media_columns(rows).collect()
    assert len(got) == rows.count() and not any(r.error for r in got)
    for doc_id, text in rows.where("doc_id is not null").dropDuplicates(["doc_id"]).limit(60).collect():
        raw = (text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        found = [r for r in got if r.doc_id == doc_id]
        assert (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])) in [(r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found]


def test_media_ranges_and_bad_members(spark, docs, tmp_path):
    path = f"file://{tmp_path}/arc"
    media.write_archive(docs.select("doc_id", "text"), path)
    assert media.read_archive(spark, path, 4096).count() == docs.count()
    victim = next(tmp_path.glob("arc/part-*"))
    data = bytearray(victim.read_bytes())
    data[60] ^= 0xFF
    victim.write_bytes(bytes(data))
    broken = media.read_archive(spark, path).where("error is not null").collect()
    assert len(broken) == 1 and broken[0].media is None


def test_mixing(spark, docs, odd):
    for table in (docs, odd.select("doc_id", "text", "lang", "source", "n_chars")):
        rows = mixing.mix(table).collect()
        assert len(rows) == table.count()
        sizes = {}
        for r in table.collect():
            sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
        ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
        weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(ranked)}
        total, capped = sum(sizes.values()), {s for s in ranked if sizes[s] == 0}
        while True:
            left = total - sum(3 * sizes[s] for s in capped)
            free = sum(weights[s] for s in ranked if s not in capped)
            over = {s for s in ranked if s not in capped and weights[s] * left / free > 3 * sizes[s]}
            if not over:
                break
            capped |= over
        want = {s: 3 * sizes[s] if s in capped else weights[s] * left / free for s in ranked}
        taken = {}
        source_of = {}
        for r in table.collect():
            source_of.setdefault(r.doc_id, r.source)
        for r in rows:
            taken[source_of[r.doc_id]] = taken.get(source_of[r.doc_id], 0) + r.taken
            assert 0 <= r.taken <= 3 * r["size"]
        if table is docs:
            assert all(abs(taken[s] - want[s]) <= 1 for s in ranked)
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(table).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixture_rows(spark, odd):
    rows = mixing.mixture(odd).collect()
    assert all(len((r.text or "").split()) == r["n_words_"] for r in rows)
    plan = {}
    for r in mixing.mix(odd).where("doc_id is not null").collect():
        plan[r.doc_id] = plan.get(r.doc_id, 0) + r.taken
    for doc_id, n in plan.items():
        assert sum(r["n_words_"] for r in rows if r.doc_id == doc_id) == n


def test_mixing_of_equal_rows(spark):
    """One source of equal rows, where fractions end among them."""
    rows = spark.range(3000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'a b c' AS text", "CASE WHEN id % 3 = 0 THEN 'y' ELSE 'x' END AS source").repartition(5)
    got = {r.source_size: r for r in mixing.mix(rows).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("taken").alias("most")).collect()}
    assert all(abs(r.taken - r.target) <= 1 and r.most <= 9 for r in got.values()) and set(got) == {3000, 6000}
    assert mixing.mixture(rows).agg(F.sum("n_words")).first()[0] == 9000


def test_mixing_of_distinct_texts_without_ids(spark):
    """Rows without an id, or with one id, spread over all slices by their texts, and the fraction still ends to a word."""
    rows = spark.range(4000).selectExpr("CASE WHEN id % 2 = 0 THEN 7 END AS doc_id", "concat('a b', id) AS text", "CASE WHEN id % 3 = 0 THEN 'y' ELSE 'x' END AS source")
    spread = mixing.keyed_of(rows, "mix").groupBy("slice").count().agg(F.count("*"), F.max("count")).first()
    assert spread[0] == mixing.SLICES and spread[1] < 60
    got = mixing.mix(rows).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("taken").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= 1 and r.most <= 6 for r in got) and len(got) == 2
    assert sorted(map(str, mixing.mix(rows).collect())) == sorted(map(str, mixing.mix(rows.repartition(7)).collect()))


def test_samples_keep_their_bound(spark):
    """Null and repeated ids, and one id for all rows, don't lift the bounds of the training samples."""
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 1 ELSE id END AS doc_id", "concat('word', id, ' text') AS text", "CASE WHEN id < 2990 THEN 'en' ELSE 'de' END AS lang")
    got = language.sample_of(rows, sample_docs=100)
    assert len(got) <= 100 and {lang for lang, _ in got} == {"en", "de"} and sum(lang == "de" for lang, _ in got) == 10
    assert len(language.sample_of(rows.unionByName(rows), sample_docs=100)) == len(got) and language.sample_of(rows.limit(0)) == []
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.sample_words(rows, labels, 100).count() == 2
    assert toxicity.unlabelled_words(rows, 100).count() <= 100


def test_toxicity_without_labels(spark):
    rows = spark.createDataFrame([(i, "you are an idiot and a moron" if i % 9 == 0 else f"plain words about thing{i} and thing{i + 1}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(rows, toxicity.learn(rows, labels)).collect()
    assert min(r.score for r in got if r.doc_id % 9 == 0) > max(r.score for r in got if r.doc_id % 9)


def test_toxicity(spark, docs, odd):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.learn(docs, labels.where(~toxicity.held_out()))
    met = toxicity.toxicity_scores(docs, model).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in met) >= 0.9 * len(met)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in met)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in met)
    kept = toxicity.without_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    nothing = toxicity.learn(docs, labels.limit(0))
    assert toxicity.toxicity_scores(docs, nothing).count() == docs.count() and toxicity.toxicity_scores(docs.limit(0), nothing).count() == 0


def test_label_model_finds_the_good_voters():
    rng = np.random.default_rng(5)
    truth = rng.random(3000) < 0.3
    good = np.stack([np.where(truth, rng.random(3000) < 0.8, rng.random(3000) < 0.02) for _ in range(4)], axis=1)
    votes = np.concatenate([good, good[:, :1], (rng.random((3000, 2)) < 0.2)], axis=1).astype(np.float32)
    known = np.where(rng.random(3000) < 0.2, truth, -1).astype(np.int64)
    m = toxicity.fit_label_model(votes, known)
    assert ((m.posterior(votes) > 0.5) == truth).mean() > 0.95
    assert m.share[0] < 0.7 < m.share[1] and m.correlations[0, 4] > 0.9


def brute_decontamination(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words_of(text)
        if item is None or not w:
            continue
        for i in range(max(1, len(w) - window + 1)):
            windows.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for key, names in windows.items():
            for i in range(len(w) - len(key) + 1):
                if w[i] == key[0] and tuple(w[i : i + len(key)]) == key:
                    hit |= set(range(i, i + len(key)))
                    found |= names
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


def test_decontamination(spark, docs):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    odd_items = spark.createDataFrame([(900, None), (901, ""), (902, "Short item"), (903, "a a a"), (902, "Short item"), (None, "x y")], "item_id long, text string")
    more = spark.createDataFrame([(9001, "a short ITEM, a A a a!"), (9002, None), (9001, "a short item"), (9003, "x y")], "doc_id long, text string")
    rows, items = docs.select("doc_id", "text").unionByName(more), bench.select(F.col("item_id").cast("long"), "text").unionByName(odd_items)
    want = brute_decontamination([tuple(r) for r in rows.collect()], [tuple(r) for r in items.collect()])
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for block in (decontaminate.BLOCK_BYTES, 2000):
        got = decontaminate.digest(decontaminate.contamination(rows, items, block_bytes=block)).select(*columns)
        assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert decontaminate.digest(decontaminate.contamination(rows, items.limit(0))).where("contaminated").count() == 0
    assert decontaminate.contamination(rows.limit(0), items).count() == 0


def test_cutting_across_blocks(spark):
    """What a cut for one block joins is a window of another block, whichever comes first."""
    items = spark.createDataFrame([(1, "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10"), (2, "b1 b2 b3 b4 b5 b6 b7 b8 b9 b10")], "item_id long, text string")
    inner = {1: "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10", 2: "b1 b2 b3 b4 b5 b6 b7 b8 b9 b10"}
    rows = [(k, f"x {inner[3 - k][:14]} {inner[k]} {inner[3 - k][15:]} y", "en", "s", 1) for k in (1, 2)]
    docs = spark.createDataFrame([*rows, (3, "clean", "en", "s", 5)], DOC)
    for block in (decontaminate.BLOCK_BYTES, 5):
        got = {r.doc_id: r.text.split() for r in decontaminate.decontaminated(docs, items, block_bytes=block).collect()}
        assert got == {1: ["x", "y"], 2: ["x", "y"], 3: ["clean"]}, block


def test_decontaminated_texts(spark, odd):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    passage = "one two three four five six seven eight nine ten"
    rows = spark.createDataFrame([(1, f"Before. {passage.title()}! After", "en", "s", 1), (2, passage, "en", "s", 1), (3, f"one two {passage} three four five six seven eight nine ten", "en", "s", 1), (4, None, "en", "s", None), (5, "clean", "en", "s", 5)], DOC)
    got = {r.doc_id: r for r in decontaminate.decontaminated(rows, items).collect()}
    assert got[1].text == "Before. ! After" and got[1].n_chars == len(got[1].text)
    assert set(got) == {1, 4, 5} and got[5].n_chars == 5 and got[4].text is None
    kept = decontaminate.decontaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_html(spark):
    page = "<html><head><title>T</title><style>x{}</style></head><body><nav><a>Home</a><a>About</a></nav><article><h1>A &amp; B</h1><p>One  two\nthree four five six seven.</p><script>var x=1</script><p>Second paragraph of the text with words&nbsp;here.</p></article><div class='comments'><p>Nice one</p></div><footer>Copyright 2020</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 1), (3, "u", "", 1), (4, "u", "plain words only", 1), (None, "u", "<div", 1)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_extract.main_text(rows).collect()}
    assert got[1].text == "A & B\n\nOne two three four five six seven.\n\nSecond paragraph of the text with words here."
    assert (got[2].text, got[3].text, got[4].text) == ("", "", "plain words only")
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.main_text(rows.limit(0)).count() == 0


WORDS = "river towns report water bridge summer people market harbour winter".split()


@pytest.mark.parametrize("own", [False, True])
def test_html_layouts(own):
    """Pages put together from known blocks and furniture: the blocks come out, whole and in order, and nothing else."""
    rng = np.random.default_rng(11)
    furniture = ["<nav><ul><li><a href='/a'>Home</a></li><li>News</li></ul></nav>", "<header class='site-header'><b>Daily</b> paper</header>", "<div class='ad'>Buy one now</div>", "<form action=x><label>Search</label><input name=q><button>Go</button></form>", "<aside><h3>Related</h3><p>Other things to read here today and tomorrow</p></aside>", "<div id='comments'><p>Nice post, thank you so much for it all of you and more</p><p>I agree</p></div>", "<div class='cookie-notice'>We use cookies <button>OK</button></div>", "<footer>&copy; All rights</footer>", "<script>var a = '<p>no</p>';</script>", "<style>p{}</style><!-- <p>no</p> -->"]
    inside = ["<div class='ad'>An offer for you</div>", "<div class='share-buttons'>Share this</div>", "<script>x()</script>", "<!-- note -->"]

    def sentence():
        return " ".join(rng.choice(WORDS, rng.integers(1, 30)))

    pages = []
    for _ in range(60):
        blocks = [sentence() for _ in range(rng.integers(2, 9))]
        shapes = ["<p>{}</p>", "<p>{}", "<h2 class=post-header>{}</h2>", "<ul class='menu'><li>{}</li></ul>", "<div class='side'>{}</div>", "<blockquote>\n {} \n</blockquote>", "<p title='a > b'>{}<br></p>"]
        body = "".join(str(rng.choice(inside)) * int(rng.random() < 0.2) + str(rng.choice(shapes)).format(b.replace(" ", "  ", 1)) for b in blocks)
        before, after = ("".join(rng.choice(furniture, rng.integers(0, 5))) for _ in "ab")
        mark = str(rng.choice(["article", "main"]))
        head = str(rng.choice(["<head><title>T x</title></head>", "<head><title>T x</title>", "", "<meta charset=utf-8>"]))
        pages.append((f"<!DOCTYPE html><html>{head}<body>{before}<{mark}>{body}</{mark}>{after}</body></html>", "\n\n".join(blocks)))
    model = html_extract.Model([p for p, _ in pages[:30]] if own else [])
    for page, want in pages:
        assert html_extract.extract(page, model)[0] == want, page


def test_region_leaves_out_what_no_class_marks():
    """Link lists around the text are plain elements; without the region they would be text."""
    links = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in WORDS[:6])
    page = f"<body><ul>{links}</ul><div><h1>A title here</h1><p>{' '.join(WORDS * 4)}</p><p>The end.</p></div><ul>{links}</ul></body>"
    model = html_extract.Model([])
    assert html_extract.extract(page, model)[0] == "A title here\n\n" + " ".join(WORDS * 4) + "\n\nThe end."
    tokens = html_extract.tokens_of(page, model.elements)
    assert html_extract.region_text(tokens, 0, len(tokens)).startswith("river\n\ntowns")


def test_html_elements_learned_from_a_table():
    """A class that only the table's own pages have is furniture then, also on pages without marks."""
    marked = [f"<body><div class='zone{i % 2}'>Latest from us</div><article><p>{' '.join(WORDS)} {i}</p></article></body>" for i in range(8)]
    page = f"<body><div class='zone1'>Latest {' '.join(WORDS)}</div><div><p>{' '.join(WORDS * 3)}</p></div></body>"
    assert html_extract.extract(page, html_extract.Model(marked))[0] == " ".join(WORDS * 3)
    assert html_extract.extract(page, html_extract.Model([]))[0].startswith("Latest")


def test_html_of_bad_pages_in_linear_time():
    import time

    model = html_extract.Model([])
    for part in ("<", "<a x=\"", "<a b='c ", "<div>", "</b>", "<!-- ", "<svg>", "word "):
        began = time.process_time()
        html_extract.extract(part * 40_000, model)
        assert time.process_time() - began < 6, part
    assert html_extract.extract("a < b and c <d e", model)[0] == "a < b and c <d e"


def test_best_region():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = [float(x) for x in rng.integers(-4, 4, rng.integers(0, 12))]
        a, b = html_extract.best_region(s)
        best = max([0.0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])
        assert sum(s[a:b]) == best


def test_language_gradients():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in language.initial(3, rng).items()}
    codes, real = language.pad([b"ab", b"xyz", b"q"])
    labels, rows = np.array([0, 1, 2]), np.ones(3)
    _, g = language.gradients(w, codes, real, labels, rows)
    for name, at in (("f_gate", (1, 2)), ("b_new", (0, 3)), ("embed", (97, 2)), ("out", (5, 1)), ("f_in", (2, 40)), ("b_b", (7,))):
        eps, old = 1e-3, w[name][at]
        w[name][at] = old + eps
        up = language.gradients(w, codes, real, labels, rows)[0]
        w[name][at] = old - eps
        down = language.gradients(w, codes, real, labels, rows)[0]
        w[name][at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-3


def test_language(spark, docs, odd):
    model = language.learn(docs)
    got = language.identify(docs, model).collect()
    right = {r.doc_id: r.lang for r in docs.collect()}
    judged = [r for r in got if r.lang_pred != "und"]
    unseen = [r for r in judged if r.held_out and right[r.doc_id] is not None]
    assert len(unseen) > 20 and sum(r.lang_pred == right[r.doc_id] for r in unseen) >= 0.95 * len(unseen)
    assert sum(r.lang_pred == right[r.doc_id] for r in judged) >= 0.95 * len(judged) and len(judged) >= 0.9 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    no_letters = spark.createDataFrame([(1, "123 ... !?"), (2, None), (3, "")], "doc_id long, text string")
    assert {r.lang_pred for r in language.identify(no_letters, model).collect()} == {"und"}
    assert all(len(p) <= 64 and p.decode() for p in language.pieces_of(("日本" * 70).encode()))
    nested = odd.withColumn("deep", F.struct(F.lit(1).alias("a b")))
    assert language.with_language(nested, model).columns == nested.columns
    kept = language.with_language(odd, model)
    assert kept.columns == odd.columns and kept.where("text is null or text = ''").count() == 0
    assert language.identify(docs.limit(0), model).count() == 0


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in "\t\n\v\f\r " else c for c in lowered).split(" ") if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps):
    label = dict.fromkeys(fps)
    for f in fps:
        label[f] = f
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(fps, 2):
            if bin(a ^ b).count("1") <= 2 and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_simhash(spark, docs, odd):
    rows = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    texts = [tuple(r) for r in rows.collect()]
    fp = {t: brute_fingerprint(t) for _, t in texts}
    label = brute_components(sorted(set(fp.values())))
    smallest = {}
    for d, t in texts:
        if d is not None:
            k = label[fp[t]]
            smallest[k] = min(smallest.get(k, d), d)
    want = sorted(str((d, f"{fp[t]:016x}", smallest.get(label[fp[t]]))) for d, t in texts)
    assert sorted(str(tuple(r)) for r in simhash.digest(simhash.near_duplicates(rows)).collect()) == want
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == len({label[brute_fingerprint(t)] for (t,) in odd.select("text").collect()})


@pytest.mark.parametrize("direct", [256, 4])
def test_anchor_links(spark, monkeypatch, direct):
    """Random words with many neighbours, compared at the anchors or through midpoints."""
    monkeypatch.setattr(simhash, "DIRECT", direct)
    rng = np.random.default_rng(direct)
    base = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    fps = set()
    for b in base:
        fps.add(b)
        for _ in range(25):
            x = b
            for i in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(i)
            fps.add(x)
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fps]
    got = simhash.classes(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    want = brute_components(sorted(fps))
    groups = {}
    for r in got:
        groups.setdefault(r.label, set()).add(r.fp % (1 << 64))
    wanted = {}
    for f, k in want.items():
        wanted.setdefault(k, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    assert {r.node: r.label for r in simhash.components(links).collect()} == dict.fromkeys(range(301), 0) | {1000: 1000, 1001: 1000}


def joined_rows(spark, run):
    """What run returns, and the rows that all joins made meanwhile."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = store.executionsCount()
    found = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    rows, every = 0, store.executionsList(before, 100_000)
    for i in range(every.size()):
        k = every.apply(i).executionId()
        values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            for metric in (node.metrics().apply(j) for j in range(node.metrics().size())):
                if "Join" in node.name() and metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    rows += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return found, rows


def test_dense_groups_cost_their_links_once(spark):
    """Rounds work on what has not come together, and labels go on from known ones."""
    rng = np.random.default_rng(3)
    groups = rng.integers(0, 1 << 62, (6, 200)).tolist()
    pairs = [(min(x, y), max(x, y)) for g in groups for i, x in enumerate(g) for y in g[i + 1 : i + 16]]
    links = spark.createDataFrame(pairs, "a long, b long")
    want = {x: min(g) for g in groups for x in g}
    got, rows = joined_rows(spark, lambda: {r.node: r.label for r in simhash.components(links).collect()})
    assert got == want
    assert len(pairs) <= rows <= 2 * len(pairs)
    known = simhash.components(links)
    more = spark.createDataFrame([(groups[0][5], groups[1][7]), (groups[1][2], groups[2][3]), (5, groups[3][0]), (7, 8)], "a long, b long")
    got = {r.node: r.label for r in simhash.components(more, known=known).collect()}
    first = min(map(min, groups[:3]))
    assert got == want | {x: first for g in groups[:3] for x in g} | dict.fromkeys([5, *groups[3]], 5) | {7: 7, 8: 7}
    assert {r.node: r.label for r in simhash.components(more.limit(0), known=known).collect()} == want


def planned_size(capsys, df):
    """The size that Spark plans with, as it prints it: a number and its unit."""
    capsys.readouterr()
    df.explain("cost")
    return re.search(r"Statistics\(sizeInBytes=([^,)]+)", capsys.readouterr().out)[1].split()


def test_planned_sizes_stay_small(spark, capsys):
    """Rounds and calls that go on from known labels don't multiply the sizes that Spark plans with."""
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    labels = simhash.components(links)
    labels = simhash.components(spark.createDataFrame([(60, 100), (200, 201)], "a long, b long"), known=labels)
    assert {r.node: r.label for r in labels.collect()} == dict.fromkeys([*range(61), 100, 101], 0) | {200: 200, 201: 200}
    number, unit = planned_size(capsys, labels)
    assert float(number) * {"B": 1, "KiB": 1 << 10}[unit] < 1 << 20


def test_pipeline(spark, docs):
    """The stages one by one against what each decides, then the run as a whole."""
    import corpus_pipeline
    import test_near_copies

    current = docs
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, current, DATA), "test")
        if name != "mixing":
            assert out.columns == docs.columns, name
            assert 0 < out.count() <= current.count()
        if name == "near_duplicates":
            want, _ = test_near_copies.brute_kept([tuple(r) for r in current.select("doc_id", "text").collect()])
            assert {r.doc_id for r in out.collect()} == want
        if name == "decontamination":
            found = decontaminate.digest(decontaminate.contamination(out, spark.read.parquet(f"{DATA}/benchmark.parquet")))
            assert found.where("contaminated").count() == 0
        if name == "mixing":
            assert sorted(map(str, out.collect())) == sorted(map(str, corpus_pipeline.run(spark, DATA).collect()))
        current = out


def test_pipeline_of_odd_rows(spark, odd):
    """Nulls, repeats, long texts and clashing columns through every stage, and an empty table."""
    import corpus_pipeline

    for current in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            current = common.written(stage(spark, current, DATA), "test")
            assert set(odd.columns) <= set(current.columns), name
        assert current.where("text is null").count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
