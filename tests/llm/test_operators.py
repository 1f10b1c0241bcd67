"""The operators against brute force, on small tables and on odd ones."""

import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orderflow.llm import (
    components, embedding_dedup, hashed_model, minhash_dedup, mixing, packing, quality_classifier, quality_rules, sharding, toxicity, warc, wavelet,
)
from orderflow.llm.oracle import ORACLE
from orderflow.llm.queries import QUERIES
from orderflow.llm.tables import documents, importable, tokenizer_file
from orderflow.llm.tokens import encoder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, rep string, bucket string, row string, `rank` string"
BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, columns with clashing names."""
    importable(spark)
    rnd = random.Random(4)
    long = " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rnd.randrange(900)) for _ in range(30_000))
    extra = ("x",) * 5
    rows = [
        (1, "one two three four five six seven", "en", "a", 3), (2, "one two three four five six seven", "en", "a", 3),
        (2, "one two three four five six seven", "en", "a", 3), (3, "", "en", "b", 0), (4, None, None, None, None),
        (None, "a text that has no name at all", "en", None, 1), (5, long, "en", "a", 1), (6, long + " tail", "en", "b", 1),
        (7, "Word", "de", "b", 4), (8, "word", "de", "b", 4), (9, " \n\t ", "de", "c", 3), (10, "é ü <|endoftext|>  x\n\ny", "fr", "c", 9),
    ]
    return spark.createDataFrame([(*r, *extra) for r in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark, odd):
    return odd.limit(0)


def norm(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    engine = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        engine.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), engine.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert norm(got.select(*columns).collect()) == norm([tuple(r[i] for i in order) for r in want.fetchall()])


def whole_ids(tokenizer, texts, end):
    t = encoder(tokenizer_file(tokenizer)).tokenizer
    return [np.array([*e.ids, end], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", [BYTES, WORDS])
def test_pieces_encode_as_whole_texts(name):
    rnd = random.Random(1)
    alphabet = " \n\t'abAZ09.,!é́ßΣİ😀\x00 　  <|>"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(2000)] + ["", "a.", "a. b, c.\nD e", None]
    got = encoder(tokenizer_file(name)).encode(texts)
    assert got == [x[:-1].tobytes() for x in whole_ids(name, texts, 0)]


def test_wavelet_matrix_answers():
    ids = np.random.default_rng(2).integers(0, 700, 5000)
    m = wavelet.WaveletMatrix.build(ids, 10)
    assert (m.decode() == ids).all()
    for i in (0, 1, 511, 512, 4999):
        assert m.access(i) == ids[i]
    for token in (0, 5, 699, int(ids[0])):
        places = np.flatnonzero(ids == token)
        assert m.count(token) == len(places) and m.count(token, 100, 900) == ((places >= 100) & (places < 900)).sum()
        assert [m.occurrence(token, k) for k in range(len(places))] == places.tolist()
    with pytest.raises(IndexError):
        m.occurrence(1023, 0)


def test_wavelet_shards(spark, odd, empty):
    got = wavelet.wavelet_shards(odd, tokenizer_file(WORDS), 2).orderBy("start").collect()
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = whole_ids(WORDS, [r.text for r in rows], 2)
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    assert [r.n_tokens for r in got] == [len(x) for x in ids]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(x) for x in ids]
    assert [r.start for r in got] == [sum(len(x) for x in ids[:k]) for k in range(len(ids))]
    assert wavelet.wavelet_shards(empty, tokenizer_file(WORDS), 2).count() == 0


def test_packing(spark, odd, empty):
    docs = corpus_pipeline.written(
        odd.unionByName(documents(spark, SF), allowMissingColumns=True).withColumn("doc_id", F.monotonically_increasing_id()), "numbered"
    )
    rows = docs.select("doc_id", "text").collect()
    ids = {r.doc_id: x for r, x in zip(rows, whole_ids(BYTES, [r.text for r in rows], 0))}
    got = packing.pack(docs, tokenizer_file(BYTES)).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.doc_id, []).append(r)
    assert set(parts) == set(ids)
    for doc, pieces in parts.items():
        pieces.sort(key=lambda r: r.start)
        assert b"".join(r.ids for r in pieces) == ids[doc].tobytes()
        assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.doc_tokens == len(ids[doc]) for r in pieces)
    windows = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert windows.get(r.sequence_id, 0) == r.offset
        windows[r.sequence_id] = r.offset + r.length
    assert max(windows.values()) == 1024 and sum(n < 1024 for n in windows.values()) <= 1
    assert packing.pack(odd, tokenizer_file(BYTES)).agg(F.sum("length")).first()[0] == sum(
        len(x) for x in whole_ids(BYTES, [r.text for r in odd.collect()], 0)
    )
    assert packing.pack(empty, tokenizer_file(BYTES)).count() == 0


def test_bm25_ranks_shared_rare_terms_first():
    docs = [np.array(x) for x in ([1, 2, 3], [1, 9, 9, 8], [2, 3, 7], [1, 8, 8])]
    often = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=10)
    idf = np.log(1 + (4 - often + 0.5) / (often + 0.5))
    scores = packing.Index(docs, idf, 3.25).scores(0)
    for k, d in enumerate(docs):
        tf = {t: (d == t).sum() for t in (1, 2, 3)}
        want = sum(idf[t] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / 3.25)) for t, f in tf.items())
        assert scores[k] == pytest.approx(want, rel=1e-5)
    assert scores.argsort()[::-1][1] == 2


def brute_tree(rows, names, target):
    """Leaves of a k-d tree, left to right: lists of rows (size, keys)."""
    root = [max(1, max(r[1][k] for r in rows) - min(r[1][k] for r in rows)) for k in names]
    done, work = [], [rows]
    while work:
        node = work.pop()
        spans = [max(r[1][k] for r in node) - min(r[1][k] for r in node) for k in names]
        total = sum(r[0] for r in node)
        if total <= target or not any(spans):
            done.append(node)
            continue
        dim = max(names, key=lambda k: (spans[k] / root[k], -k))
        below, cut = 0, None
        for key in sorted({r[1][dim] for r in node}):
            weight = sum(r[0] for r in node if r[1][dim] == key)
            if below + weight >= total / 2:
                cut = key + (total / 2 - below > weight / 2)
                break
            below += weight
        work += [[r for r in node if r[1][dim] >= cut], [r for r in node if r[1][dim] < cut]]
    return done


def test_shards_of_a_target_are_those_of_a_brute_force_tree(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TOLERANCE", 0)
    docs = documents(spark, SF)
    dims = sharding.metadata(docs)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", (F.octet_length(text) + 1).alias("size"), *[sharding._key(v).alias(f"d{i}") for i, v in enumerate(dims.values())])
    rows = [(r["size"], [r[f"d{i}"] for i in range(len(dims))], r.doc_id) for r in keyed.collect()]
    target = sum(r[0] for r in rows) / 9
    got = {}
    for r in sharding.kd_shards(docs, target_bytes=target).collect():
        got.setdefault(r.shard, set()).add(r.doc_id)
    want = [{r[2] for r in leaf} for leaf in brute_tree(rows, range(len(dims)), target)]
    assert [got[k] for k in range(len(got))] == want and len(want) > 9
    weights = {r[2]: r[0] for r in rows}
    assert all(sum(weights[d] for d in leaf) <= target or len(leaf) == 1 for leaf in want)


def test_shards(spark, odd, empty):
    docs = odd.unionByName(documents(spark, "/root/testdata/sf0.01"), allowMissingColumns=True)
    got = sharding.kd_shards(docs, shards=16).collect()
    assert len(got) == docs.count()
    small = sharding.kd_shards(documents(spark, "/root/testdata/sf0.01"), shards=16).collect()
    sums, slots = {}, {}
    for r in small:
        sums[r.shard] = sums.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(sums) == set(range(16)) and max(sums.values()) < 1.1 * min(sums.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    named = [r for r in sharding.kd_shards(odd, shards=16).collect()]
    assert len(named) == 12 and {(r.size, r.text_crc32) for r in named if r.doc_id == 4} == {(1, 0)}
    assert {r.text_crc32 for r in named if r.doc_id == 5} == {zlib.crc32(texts[5])}
    assert sharding.kd_shards(empty, shards=16).count() == 0 == sharding.kd_shards(empty, target_bytes=10).count()
    with pytest.raises(ValueError):
        sharding.kd_shards(odd)


def test_warc(spark):
    importable(spark)
    rows = [(3, "http://a", "same"), (1, "http://b", "same"), (2, None, None), (4, "u", ""), (5, "x y", "é" * 50_000), (6, "z", "same"), (None, "n", "same"), (7, "n", "alone\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "q", 1) for r in rows], "page_id bigint, url string, html string, digest string, size int")
    got = {r.page_id: r for r in warc.warc_round_trip(pages).collect()}
    for page, _, html in rows:
        payload = (html or "").encode()
        first = min(p for p, _, h in rows if p is not None and (h or "") == (html or ""))
        r = got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if page == first else ("revisit", first))
    index = warc.write_archives(pages, f"{spark.conf.get('spark.sql.warehouse.dir')}/warc-{random.random()}", least_bytes=5)
    some = warc.read_records(index.where("page_id in (5, 7, 3)")).collect()
    assert {r.page_id: r.payload for r in some} == {5: ("é" * 50_000).encode(), 7: b"alone\r\n\r\n", 3: b"same"}
    assert {r.record_type for r in some} == {"response"}
    assert warc.warc_round_trip(pages.limit(0)).count() == 0
    assert list(warc.ranges(np.array([0, 10, 100_000_000]), np.array([10, 5, 7]))) == [(0, 2), (2, 3)]


def brute_groups(sets, percent=80):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def top(i):
        return i if root[i] == i else top(root[i])

    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("blocks", [False, True])
def test_near_duplicates(spark, monkeypatch, blocks):
    importable(spark)
    if blocks:  # every bucket and candidate set in several blocks
        monkeypatch.setattr(minhash_dedup, "BUCKET_BLOCK", 4)
        monkeypatch.setattr(minhash_dedup, "SHINGLE_BLOCK", 300)
    rnd = random.Random(8)
    texts = []
    for _ in range(6):
        base = [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice((12, 60, 200)))]
        for _ in range(12):
            copy = [w if rnd.random() > rnd.choice((0.0, 0.02, 0.06, 0.1)) else f"x{rnd.randrange(99)}" for w in base]
            texts.append(" ".join(copy).replace("w1", "W1"))
    rnd.shuffle(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs, 2, 0.8).collect()}
    sets = {}
    for i, t in enumerate(texts):
        w = t.lower().split()
        sets[i] = set(zip(w, w[1:]))
    want = brute_groups(sets)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    got = minhash_dedup.near_duplicates(odd, 2, 0.8).collect()
    assert len(got) == 12
    found = {r.doc_id: r.component_id for r in got}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, None: None, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9, 10: 10}
    assert minhash_dedup.near_duplicates(empty).count() == 0
    kept = minhash_dedup.keep(odd, 2, 0.8)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 7, 9, 10]


def test_shingles_of_chunks_shorter_than_a_shingle():
    """Each text alone in its chunk gives the set that it gives among others."""
    texts = [None, "", "a", "a b", "a b c", "a b c d", "a b c d e", "a b c d e f g"]
    together = minhash_dedup.shingle_sets(pa.RecordBatch.from_pydict({"text": texts}), 5)
    for text, want in zip(texts, together):
        (got,) = minhash_dedup.shingle_sets(pa.RecordBatch.from_pydict({"text": pa.array([text], pa.string())}), 5)
        assert got.tolist() == want.tolist()


def test_near_duplicates_of_odd_rows_with_five_words(spark, odd):
    rows = minhash_dedup.near_duplicates(odd.unionByName(odd.where("doc_id = 7").withColumns({"doc_id": F.lit(11), "text": F.lit("two words")})).repartition(13)).collect()
    assert len(rows) == 13 and {r.doc_id: r.component_id for r in rows}[2] == 1


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).unionByName(
        spark.createDataFrame([(500, 500), (600, 601)], "a bigint, b bigint")
    )
    got = {r.id: r.component for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(300)} | {600: 600, 601: 600}


def test_embeddings(spark, monkeypatch):
    importable(spark)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 40)
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(30, 16))
    rows = []
    for i in range(240):
        v = base[rnd.integers(30)] + rnd.normal(size=16) * rnd.choice([0, 0.02, 0.1, 0.2, 0.4])
        rows.append((i, v.tolist(), int(rnd.integers(2)), "x"))
    good = len(rows)
    rows += [(300, None, 1, "x"), (301, [0.0] * 16, 1, "x"), (302, [float("nan")] * 16, 1, "x"), (303, [1.0, None], 1, "x"), (304, rows[0][1], None, "x"), (305, [], 0, "x"), (306, [3.0, 4.0], 0, "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, cell string")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    x = np.array([r[1] for r in rows[:good]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:good]])
    near = (x @ x.T >= 0.98) & (label[:, None] == label) & ~np.eye(good, dtype=bool)
    root = list(range(good))
    for _ in range(good):
        root = [min([root[i], *[root[j] for j in np.flatnonzero(near[i])]]) for i in range(good)]
    assert near.sum() > 100
    assert [got[i].n_links for i in range(good)] == near.sum(1).tolist()
    assert [got[i].component_id for i in range(good)] == root
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(300, 307))
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_mixing(spark, odd, empty):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = mixing.mixed_documents(docs).collect()
    names = {r.doc_id: r.source for r in docs.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    sources = sorted(set(names.values()))
    size = {s: sum(len(texts[d].encode().split()) for d in names if names[d] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    want, free, left = {}, set(sources), 1.5 * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            want |= {s: level * weight[s] for s in free}
            break
        want |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        free -= over
    taken = dict.fromkeys(sources, 0)
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode().split()) and 0 <= r.taken <= 2 * r.size
        assert r.source_size == size[names[r.doc_id]] and r.target == pytest.approx(want[names[r.doc_id]])
        taken[names[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in sources)
    assert norm(rows) == norm(mixing.mixed_documents(docs.repartition(7)).collect())
    assert len(mixing.mixed_documents(odd).collect()) == 12
    assert mixing.mixed_documents(empty).count() == 0
    copies = mixing.mixed_copies(docs)
    assert copies.columns == docs.columns
    words = {}
    for r in copies.collect():
        assert r.text in texts[r.doc_id]
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
    assert words == {r.doc_id: r.taken for r in rows if r.taken}
    assert mixing.mixed_copies(odd).columns == odd.columns and mixing.mixed_copies(empty).count() == 0


def test_rules_on_odd_rows(spark, odd, empty):
    got = quality_rules.quality_rules(odd)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == 12 and rows[4].n_words == 0 and rows[4].base_failed and not rows[4].kept
    assert rows[5].n_words == 30_000 and rows[10].n_symbols == 4
    assert quality_rules.keep(odd).columns == odd.columns and quality_rules.keep(empty).count() == 0
    assert quality_rules.quality_rules(empty).count() == 0
    for name in quality_rules.POLICIES:
        assert all(r[f"passed_{name}"] == (r.failed_bits & quality_rules.mask_of(quality_rules.POLICIES[name]) == 0) for r in rows.values())
    clash = odd.select("*", F.lit("mine").alias("failed_bits"), F.lit("too").alias("n_words"))
    assert norm(quality_rules.keep(clash).collect()) == norm([(*r, "mine", "too") for r in quality_rules.keep(odd).collect()])
    table = {r.rule: (r.failed, r.only_this) for r in quality_rules.ablations(quality_rules.ledger(documents(spark, SF)), "v2").collect()}
    bits = [r.failed_bits for r in quality_rules.ledger(documents(spark, SF)).collect()]
    for k, rule in enumerate(quality_rules.RULES):
        assert table[rule] == (sum(b >> k & 1 for b in bits), sum(b == 1 << k for b in bits))
    assert {r.failed for r in quality_rules.ablations(quality_rules.ledger(empty), "v1").collect()} == {0}


def test_few_kinds_of_words_are_bad_at_any_length(spark):
    for n in (500, 2000, 2001, 2500, 20_000):
        text = " ".join(f"w{random.Random(k).randrange(60)}" for k in range(n))
        rich = " ".join(f"w{k % (n // 3)}" for k in range(n))
        batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [text, rich]})
        cast = quality_classifier.unpack(quality_classifier.votes(batch))[:, list(quality_classifier.LABELLERS).index("variety")]
        assert cast.tolist() == [0, 1]


def test_the_sample_keeps_its_size_at_a_tiny_share(spark):
    rows = spark.range(30_000_000).withColumnRenamed("id", "doc_id")
    kept = rows.where(hashed_model.drawn(2e-7)).count()
    assert 1 <= kept <= 15  # a millionth would be 30
    assert rows.limit(100).where(hashed_model.drawn(1.0)).count() == 100


def test_toxicity(spark, odd, empty):
    sf = "/root/testdata/sf0.1"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    score, toxic = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    rank = score.argsort().argsort() + 1
    n = toxic.sum()
    assert (rank[toxic == 1].sum() - n * (n + 1) / 2) / n / (len(toxic) - n) > 0.95
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.97
    found = toxicity.toxicity(odd, labels.limit(0)).collect()
    assert len(found) == 12 and all(0 <= r.score <= 1 for r in found)
    assert toxicity.toxicity(empty, labels).count() == 0
    held = {r.doc_id for r in found if r.held_out}
    assert held == {r.doc_id for r in odd.collect() if zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0}


def test_factors_learn_a_pair_that_weights_miss(spark):
    """The label is the exclusive or of two features: no linear scorer does better than chance."""
    from orderflow.llm.hashed_model import Sparse, train

    rnd = np.random.default_rng(3)
    flags = rnd.integers(0, 2, (2000, 2))
    rows = [(i, float(a ^ b), [int(a), 2 + int(b)], [1.0, 1.0]) for i, (a, b) in enumerate(flags)]
    table = spark.createDataFrame(rows, "doc_id bigint, label double, at array<int>, x array<float>").repartition(3)
    right = {}
    for k in (0, 4):
        model = train(table, 2, k, 15, weigh=False, balance=True)
        cells = Sparse(4, np.repeat(np.arange(4), 2), np.array([0, 2, 0, 3, 1, 2, 1, 3]), np.ones(8))
        right[k] = ((model.scores(cells) >= 0.5) == np.array([False, True, True, False])).sum()
    assert right[4] == 4 and right[0] < 4


def test_toxicity_of_pairs_without_evidence_apart(spark):
    """Insults and groups are as often toxic as any text; only both in one text are always."""
    importable(spark)
    rnd, rows = random.Random(7), []
    for i in range(6000):
        draw, words = rnd.random(), [f"w{rnd.randrange(300)}" for _ in range(20)]
        insult, group, slur = draw < 0.3, draw < 0.09 or 0.3 <= draw < 0.51, 0.51 <= draw < 0.72
        words += [f"{rnd.randrange(6)}insult"] * insult + [f"{rnd.randrange(6)}group"] * group + ["slur"] * slur
        rnd.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group or slur), 2 * insult + group))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int, kind int")
    got = toxicity.toxicity(docs, docs.select("doc_id", "toxic")).join(docs, "doc_id").where("held_out").collect()
    shares = [np.mean([r.predicted for r in got if r.kind == k and (k or not r.toxic)]) for k in range(4)]
    assert shares[3] > 0.75 and max(shares[:3]) < 0.05


def test_weak_labels(spark, odd, empty):
    sf = "/root/testdata/sf0.1"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_classifier.quality(docs).join(labels, "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05
    assert quality_classifier.quality(odd).count() == 12 and quality_classifier.quality(empty).count() == 0
    assert quality_classifier.keep(odd).columns == odd.columns


def test_em_trusts_the_labellers_that_agree():
    def pattern(votes):
        return sum((v + 1) * 3 ** (len(votes) - 1 - k) for k, v in enumerate(votes))

    votes = [(1,) * 8, (-1,) * 7 + (1,), (1,) * 7 + (-1,), (-1,) * 8, (0,) * 8]
    chance, _ = quality_classifier.posteriors(np.array([pattern(v) for v in votes]), np.array([900, 60, 40, 60, 5]))
    assert chance[0] > 0.95 and chance[1] < 0.1 and chance[3] < 0.1 and chance[4] > 0.5


def test_pipeline(spark, odd, empty):
    docs = documents(spark, "/root/testdata/sf0.01")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
    tokens = {r.doc_id: r.n for r in docs.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    texts = before.select("doc_id", "text").collect()
    want = {}
    for r, ids in zip(texts, whole_ids(BYTES, [r.text for r in texts], 0)):
        want[r.doc_id] = want.get(r.doc_id, 0) + len(ids)
    assert tokens == want
    # windows and documents can be put together again from the result alone
    rows, windows = {}, {}
    for r in docs.orderBy("start").collect():
        rows.setdefault((r.row, r.doc_id), []).append(r.ids)
        windows.setdefault(r.sequence_id, {})[r.offset] = r.ids
    assert norm((d, b"".join(p)) for (_, d), p in rows.items()) == norm(
        (r.doc_id, x.tobytes()) for r, x in zip(texts, whole_ids(BYTES, [r.text for r in texts], 0))
    )
    sizes = [sum(map(len, w.values())) // 4 for w in windows.values()]
    assert max(sizes) == 1024 and sum(n < 1024 for n in sizes) <= 1
    for table in (odd, empty):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, SF), name)
