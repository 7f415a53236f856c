"""Each operator against brute force on small tables, with nulls, empty and long texts, repeats and an empty table."""

import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from parlance.llm import embedding_dedup, html_extract, minhash, mixing, pieces, pii, quality_mil, quality_rules, secret_scan, toxicity
from parlance.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, key long"


def rows_of(texts):
    return [(k, t, None if k == 1 else "en", None if k % 7 == 0 else f"s{k % 3}", 1, "x", 5) for k, t in enumerate(texts)]


BASE = [
    None, "", "   \n\t ", "one", prose(120, 1), prose(120, 1), prose(3000, 2), "a b c a b c a b c\na b c\na b c\n" * 8,
    "password=abcdefgh1 and token: 'short' AKIA" + "Q" * 14 + " " + "0a" * 20, "mail a.b@c.example.org ip 10.0.0.255 and 10.0.0.256 card 4111 1111 1111 1111 call +1 (555) 010-9999",
    "bob [at] mail [dot] example [dot] com", "x" * 5000, prose(60, 4) + " é ü 語 \U0001F600", prose(400, 5),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(BASE), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, 1, 0) for k in (4, 6, 13)] + [(7, 0, 1)], "doc_id long, quality int, toxic int")


def test_pieces_equal_the_model_and_decode(spark, docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    odd = [*[t or "" for t in BASE], " a  b\nc\t ｄ ﬁ \x00x", "日本語" * 60, "aaaa  \n\n  bbb;\r\n", "\n", "a\n b"]
    codec = pieces.codec()
    assert codec.encode(odd) == model.encode(odd)
    assert [codec.decode(i) for i in codec.encode(odd)] == odd
    got = {r.doc_id: r for r in pieces.encode_documents(docs).collect()}
    assert len(got) == len(BASE) and all(r.round_trip for r in got.values()) and got[0].ids == []
    assert pieces.decode_documents(pieces.encode_documents(docs)).where("doc_id = 4").first().text == BASE[4]
    assert pieces.encode_documents(empty).count() == 0


def test_suffix_array_finds_every_occurrence():
    codec = pieces.codec()
    data = np.frombuffer(b" the then\xff here", dtype=np.uint8)
    packed = codec.edges(data)
    assert (np.diff(packed) > 0).all()
    edges = np.stack([packed >> 24, (packed >> 16) & 0xFF, packed & 0xFFFF], axis=1)
    want = {(p, n) for p in range(len(data)) for n in range(1, codec.longest + 1) if bytes(data[p : p + n]) in set(codec.bytes_of[259:]) and p + n <= len(data)}
    assert {(int(p), int(n)) for p, n, _ in edges} == want


def test_features_are_chosen_without_the_rows_left_out():
    rows, feats = np.repeat(np.arange(100), 2), np.tile([5, 9], 100)
    feats[::2] = np.where(np.arange(100) < 50, 7, 8)  # feature 7 marks toxic rows, of which the last ones are left out
    toxic = (np.arange(100) < 50).astype(float)
    assert 7 in toxicity.chosen(rows, feats, toxic, np.ones(100, dtype=bool))
    turned = toxic.copy()
    turned[60:] = 1 - turned[60:]
    seen = np.arange(100) < 60
    assert (toxicity.chosen(rows, feats, toxic, seen) == toxicity.chosen(rows, feats, turned, seen)).all()


def test_toxicity_chain_learns_held_out_rows(spark, empty):
    texts, y = [], []
    for k in range(600):
        bad = k % 3 == 0
        texts.append(prose(60, k) + (" " + RNG.choice(["idiot", "scum", "grumblor"]) if bad else ""))
        y.append(float(bad))
    y = np.array(y)
    chain = toxicity.Chain.fit(pa.array(texts[:450]), y[:450])
    p = chain.probabilities(pa.array(texts[450:]))
    assert p.shape == (150, 4) and ((p[:, 3] >= 0.5) == (y[450:] > 0)).mean() > 0.95
    # The categories are groups of the toxic rows, told apart by what they hold.
    kinds = p[:, :3][y[450:] > 0].argmax(1)
    words = [t.rsplit(" ", 1)[1] for t, v in zip(texts[450:], y[450:], strict=True) if v]
    assert all(len({k for k, w in zip(kinds, words, strict=True) if w == v}) == 1 for v in set(words)) and len(set(kinds)) == 3
    assert (toxicity.Chain.fit(pa.array(texts[:450]), y[:450]).probabilities(pa.array(texts[450:])) == p).all()
    assert toxicity.toxicity(empty, chain).count() == 0
    assert toxicity.Chain.fit(pa.array(["a"]), np.array([0.0])).probabilities(pa.array([None, "b"], pa.string())).max() < 1e-6


def brute_secrets(text):
    out = []
    for k, (_, p, least) in enumerate(secret_scan.RULES):
        for m in re.finditer(p, text or "", re.ASCII):
            if not least or len(m.group(1)) >= least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.mark.parametrize("text", [
    "-----BEGIN " + "A " * 20_000 + "PRIVATE KEY-----", "-----BEGIN " * 20_000 + "X " * 20_000 + "PRIVATE KEY", "password" * 20_000 + "=" + "a" * 20_000,
    "token" + " " * 20_000 + "=" + " " * 20_000 + "'" + "b" * 20, "api_key=" * 20_000, "AKIA" * 20_000, "0a" * 100_000 + "g", "ghp_" + "a1" * 50_000, "ghp_" * 20_000,
    "xoxb-" + "a-" * 50_000, "AIza" + "_-" * 50_000, "sk_live_" * 20_000, "eyJ" + "a" * 100_000 + ".eyJ" + "b" * 100_000 + "." + "c" * 100_000, "eyJaaaaaaaa." * 20_000,
])
def test_long_repeats_take_no_stack(spark, text):
    got = secret_scan.secret_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(s) for s in got.found] == brute_secrets(text)


def test_secret_spans(spark, docs, empty, monkeypatch):
    more = ["ghp_" + "a1" * 20, "-----BEGIN RSA PRIVATE KEY-----", "\x01token=abcdefghij\x01", "API_KEY : \"abc.def-ghi\" apikey='12345678'", "sk_live_" + "a" * 20, "é token=abcdefgh"]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + k, t) for k, t in enumerate(more)] + [(100, more[0])], "doc_id long, text string"))
    got = secret_scan.secret_scan(table).collect()
    assert len(got) == len(BASE) + len(more) + 1
    for r in got:
        assert [(s.start, s.k, s.end) for s in r.found] == brute_secrets(r.text)
    assert sum(len(r.found) for r in got) >= 9
    assert secret_scan.secret_scan(empty).count() == 0
    # Null ids, repeated rows and clashing names; and many candidates, which are not broadcast.
    odd = spark.createDataFrame([(None, more[0], 1, "x")] * 3 + [(None, None, 1, "x"), (5, "AKIA" + "B" * 20, 1, "x")], "doc_id long, text string, key int, rules string")
    monkeypatch.setattr(secret_scan, "BROADCAST_DOCS", 0)
    got = sorted((str(r.doc_id), len(r.found)) for r in secret_scan.secret_scan(odd).collect())
    assert got == [("5", 1), ("None", 0), ("None", 2), ("None", 2), ("None", 2)]


def test_index_answers_as_texts_do(spark):
    texts = [prose(30, k) + RNG.choice(["", " secret", " tok en", " token ", " AKIA", " ghp_", " sk_live_x", " eyJ.eyJ"]) for k in range(300)]
    rows = secret_scan.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    keys = {r.key: r.text.lower() for r in rows.collect()}
    got = {r.key: set(r.rules) for r in secret_scan.candidates(rows).collect()}

    def holds(q, t):
        return q[1] in t if q[0] == "gram" else (all if q[0] == "and" else any)(holds(x, t) for x in q[1])

    for kind, p, _ in secret_scan.RULES:
        q = secret_scan.trigram_query(p)
        assert q is None or {k for k, v in got.items() if kind in v} == {k for k, t in keys.items() if holds(q, t)}


def test_trigram_queries_are_necessary():
    for kind, pattern, _ in secret_scan.RULES:
        assert (secret_scan.trigram_query(pattern) is None) == (kind == "hex")


def brute_counts(text):
    w = WORD.findall(text or "")
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {q for v in seen.values() if len(v) > 1 for i in v for q in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def spark_hash(value, seed=42):
    """Spark's xxhash64 of a string, or of a long with the hash before it as its seed."""
    raw = value.encode() if isinstance(value, str) else struct.pack("<q", value)
    h = xxhash.xxh64(raw, seed=seed & (2**64 - 1)).intdigest()
    return h - 2**64 if h >= 2**63 else h


def brute_ratios(texts, trusted, buckets):
    """The log ratio of each text from the definition: counts of hashed words and pairs, smoothed by the corpus."""
    grams = []
    for t in texts:
        hs = [spark_hash(w) for w in WORD.findall(t or "")]
        grams.append([h % buckets for h in hs] + [spark_hash(b, spark_hash(a)) % buckets for a, b in zip(hs, hs[1:], strict=False)])
    raw, hit = np.zeros(buckets), np.zeros(buckets)
    for k, g in enumerate(grams):
        np.add.at(raw, g, 1)
        if k in trusted:
            np.add.at(hit, g, 1)
    corpus = (raw + 1) / (raw.sum() + buckets)
    target = (hit + quality_rules.PRIOR * buckets * corpus) / (hit.sum() + quality_rules.PRIOR * buckets)
    lr = np.log(target) - np.log(corpus)
    return [float(lr[g].mean()) if g else 0.0 for g in grams]


@pytest.mark.parametrize("bits", [32, 3])
def test_quality_rules(spark, docs, empty, labels, bits, monkeypatch):
    monkeypatch.setattr(quality_rules, "HASH_BITS", bits)  # 3: windows of other words have the same hash
    table = docs.withColumns({c: F.lit(9) for c in ("words", "wh", "lines", "again", "wide", "kept", "row", "llr", "met")})
    got = {r.doc_id: r for r in quality_rules.quality_rules(table, labels, buckets=1 << 12).collect()}
    want = brute_ratios(BASE, {4, 6, 13}, 1 << 12)
    for k, t in enumerate(BASE):
        r = got[k]
        n = brute_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert abs(r.llr - want[k]) < 1e-9 and r.kept == (not r.base_failed and want[k] >= quality_rules.THRESHOLD)
        assert (r.words, r.wh, r.lines, r.again, r.wide, r.met) == (9,) * 6
    assert got[4].llr == got[5].llr and len({r.kept for r in got.values()}) == 2
    assert quality_rules.quality_rules(empty, labels).count() == 0
    none = labels.where("quality > 5")
    assert {r.llr for r in quality_rules.quality_rules(docs, none).collect()} == {0.0}


def test_quality_stage_keeps_what_the_query_keeps(spark, docs, empty, labels, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    query = {r.doc_id for r in quality_rules.op4_quality_rules(spark, str(tmp_path)).where("kept").collect()}
    staged = quality_rules.stage_quality(spark, docs, str(tmp_path))
    assert staged.columns == docs.columns and {r.doc_id for r in staged.collect()} == query
    assert quality_rules.stage_quality(spark, empty, str(tmp_path)).count() == 0


def brute_links(x, cosine=0.95):
    u = embedding_dedup.unit(np.asarray(x, dtype=np.float64))
    links = (u @ u.T >= cosine) & ~np.eye(len(x), dtype=bool)
    least = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(least, np.where(links, least[None, :], 10**9).min(1))
        if (new == least).all():
            break
        least = new
    return links, least


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 16))
    x = np.concatenate([base, base[:40] + 0.05 * rng.standard_normal((40, 16)), base[:5] * 3, np.repeat(base[:1], 30, 0) + 0.02 * rng.standard_normal((30, 16))]).astype(np.float32)
    rows = [(k, [float(c) for c in v], 0) for k, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0], 1), (904, [], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table).collect()}
    links, least = brute_links(x)
    for k in range(len(x)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (links[k].sum(), least[k], least[k] == k)
    for k in range(900, 905):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def planted_vectors(seed=2, n=6000, size=24):
    """Vectors in clusters, with near ones at all angles about the threshold, and one dense group."""
    rng = np.random.default_rng(seed)
    centres = embedding_dedup.unit(rng.standard_normal((60, size)))
    x = embedding_dedup.unit(centres[rng.integers(0, 60, n)] + 0.35 * rng.standard_normal((n, size)))
    turned = []
    for k in range(1500):
        c = rng.uniform(0.90, 0.999)
        noise = rng.standard_normal(size)
        noise -= (noise @ x[k]) * x[k]
        turned.append(c * x[k] + np.sqrt(1 - c * c) * noise / np.sqrt(noise @ noise))
    dense = x[n - 1] + 0.03 * rng.standard_normal((400, size))
    return np.concatenate([x, turned, dense])


@pytest.mark.parametrize("settings", [{"PER_CELL": 6, "PER_GROUP": 60}, {"PER_CELL": 6, "PER_GROUP": 400, "BLOCK": 64, "HEAVY": 120}])
def test_embedding_links_against_brute_force(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(embedding_dedup, k, v)
    x = planted_vectors()
    assert embedding_dedup.n_codes(len(x)) >= 32  # a grid of at least 32 by 32 cells
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table).collect()}
    links, least = brute_links(x)
    assert sum(got[k].n_links for k in got) >= 0.98 * links.sum() and all(got[k].n_links <= links[k].sum() for k in got)
    assert all(least[k] == least[got[k].component_id] for k in got)  # nothing is tied that links do not tie
    a, b = np.nonzero(links)
    assert np.mean([got[i].component_id == got[j].component_id for i, j in zip(a.tolist(), b.tolist(), strict=True)]) >= 0.98


def test_embeddings_in_double_precision_and_odd_ids(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LENGTHS", 1)
    big, tiny = 1e300, 1 + 2**-40
    rows = [("b", [big, 0.0]), ("a", [big, 1e295]), ("a", [0.0, 1.0]), ("c", [1e-5, tiny]), ("c", [1e-5, 1.0]), ("d", [1.0, 2.0, 3.0]), ("e", [1.0, 2.0, 3.1]), (None, [0.0, -1.0]), (None, None), ("f", [1.0, None])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id string, embedding array<double>, m int, id string")
    got = sorted(map(tuple, embedding_dedup.near_duplicates(table).collect()), key=str)
    assert got == sorted([("b", 1, "a", False), ("a", 1, "a", True), ("a", 2, "a", True), ("c", 2, "a", False), ("c", 2, "a", False), ("d", 1, "d", True), ("e", 1, "d", False), (None, 0, None, True), (None, 0, None, True), ("f", 0, "f", True)], key=str)


def brute_targets(sizes):
    """Shares by weight, stopped at twice a size, by trying ever higher levels of what one unit of weight gets."""
    weights = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    low, high = 0.0, 3.0 * sum(sizes) + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * s, mid * w) for s, w in zip(sizes, weights, strict=True)) < 1.5 * sum(sizes) else (low, mid)
    return [min(2 * s, high * w) for s, w in zip(sizes, weights, strict=True)]


def test_mixing(spark, docs, empty, tmp_path):
    texts = [prose(RNG.randint(5, 60), k) for k in range(3000)] + [None, ""]
    rows = [(k, t, "en", None if k % 9 == 0 else f"s{min(k % 7, 4)}", 1, "x", 5) for k, t in enumerate(texts)] + [(7, texts[7], "en", "s0", 1, "x", 5)] * 2
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op6_mixing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    n_words = lambda t: len(WORD.findall(t or ""))
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    sizes = {s: sum(n_words(r[1]) for r in rows if r[3] == s) for s in names}
    want = dict(zip(names, brute_targets([sizes[s] for s in names]), strict=True))
    source = {r[0]: r[3] for r in rows}
    taken = dict.fromkeys(names, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.size == n_words(texts[r.doc_id]) and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken % max(1, r.size) == 0 and r.taken <= 2 * r.size and len(r.shards) * r.size == r.taken
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.01 * max(want[s], 100) for s in names)
    again = mixing.op6_mixing(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    sized, _, takes = mixing.mix(docs)
    assert sized.count() == len(BASE) and all(len(r.shards) <= 2 for r in takes.collect())
    assert mixing.mix(empty)[0].count() == 0 and mixing.stage_mix(spark, empty, "").count() == 0
    assert mixing.stage_mix(spark, docs, "").columns == docs.columns


def test_mix_stage_takes_what_the_query_takes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 2000)
    texts = [prose(RNG.randint(5, 60), k) for k in range(800)]
    # Extra columns whose names the operator uses itself.
    kind = "doc_id long, text string, source string, size long, shards string, block long, h long, skey string, c0 int"
    table = spark.createDataFrame([(k, t, f"s{k % 3}", 1, "x", 2, 3, "y", 4) for k, t in enumerate(texts)], kind)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    query = {r.doc_id: r for r in mixing.op6_mixing(spark, str(tmp_path)).collect()}
    staged = mixing.stage_mix(spark, table, "")
    assert staged.columns == table.columns
    counts = {r.doc_id: r["count"] for r in staged.groupBy("doc_id").count().collect()}
    assert counts == {k: len(r.shards) for k, r in query.items() if r.shards}
    assert {r.c0 for r in staged.collect()} == {4} and len({s for r in query.values() for s in r.shards}) > 5
    # A tree that grows on executors deals the same.
    monkeypatch.setattr(mixing, "TOP_SHARDS", 2)
    assert {r.doc_id: sorted(r.shards) for r in mixing.op6_mixing(spark, str(tmp_path)).collect()} == {k: sorted(r.shards) for k, r in query.items()}


def test_targets_and_tree():
    sizes = [100, 1000, 50, 0, 400]
    t = mixing.targets(sizes)
    assert abs(sum(t) - 1.5 * sum(sizes)) < 1e-6 and all(x <= 2 * s + 1e-9 for x, s in zip(t, sizes, strict=True))
    quotas = [7, 100, 0, 31]
    tree = mixing.splitting_tree(quotas, 6)
    assert tree.sum(0).tolist() == quotas and tree.sum(1).max() - tree.sum(1).min() <= 3


def changed(text, share, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) if r.random() < share else w for w in text.split())


def test_near_duplicates(spark, empty):
    texts = [prose(200, k) for k in range(30)]
    near = [changed(t, 0.01, k) for k, t in enumerate(texts[:12])]
    far = [changed(t, 0.3, k) for k, t in enumerate(texts[:12])]
    chain = [prose(150, 99)]
    for k in range(40):
        chain.append(changed(chain[-1], 0.006, 1000 + k))
    every = [*texts, *near, *far, *chain, texts[0], None, "", "", "two words", "two words"]
    table = spark.createDataFrame(rows_of(every), SCHEMA)
    got = {r.doc_id: r for r in minhash.near_duplicates(table).collect()}
    assert len(got) == len(every)

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in every]
    for a in range(len(every)):
        for b in range(a):
            j = len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
            if j >= 0.85:
                assert got[a].component_id == got[b].component_id, (a, b, j)
    for k in range(12):
        assert got[42 + k].component_id != got[k].component_id
    assert got[len(every) - 1].component_id == len(every) - 2 and got[len(every) - 3].component_id == got[len(every) - 4].component_id
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert minhash.near_duplicates(empty).count() == 0


def weighted_jaccard(texts):
    """Weighted Jaccard similarities of all pairs, from the definition, with the operator's document frequencies."""
    idf = {}
    n = len(texts)
    words = [(t or "").lower().split() for t in texts]
    buckets = {w: int(minhash._hash_strings(pa.array([w]))[0][0]) & (minhash.DF_BUCKETS - 1) for ws in words for w in ws}
    df = {}
    for ws in words:
        for b in {buckets[w] for w in ws}:
            df[b] = df.get(b, 0) + 1
    idf = {w: 1 + np.log((1 + n) / (1 + df[b])) / np.log(2 + n) for w, b in buckets.items()}
    bags = []
    for ws in words:
        tf = {}
        for k in range(max(1, len(ws) - 4) if ws else 0):
            g = tuple(ws[k : k + 5])
            tf[g] = tf.get(g, 0) + 1
        bags.append({g: (1 + np.log(c)) * np.mean([idf[w] for w in g]) for g, c in tf.items()})
    out = np.zeros((n, n))
    for a in range(n):
        for b in range(n):
            low = sum(min(v, bags[b][g]) for g, v in bags[a].items() if g in bags[b])
            high = sum(bags[a].values()) + sum(bags[b].values()) - low
            out[a, b] = low / high if high else 0
    return out


def test_near_duplicates_equal_weighted_similarity(spark):
    texts = [prose(120, k) for k in range(20)]
    for k in range(20):
        texts += [changed(texts[k], share, 100 * k + j) for j, share in enumerate((0.005, 0.01, 0.02, 0.03, 0.05))]
    texts += [texts[3] + " " + texts[3], "one two three", "one two three four"]
    sims = weighted_jaccard(texts)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    linked = [(a, b) for a in range(len(texts)) for b in range(a) if sims[a, b] >= 0.8 + 1e-4]
    assert len(linked) > 60 and sum(got[a] == got[b] for a, b in linked) >= 0.98 * len(linked)
    # No class holds more than what links of 0.8 connect.
    least = np.arange(len(texts))
    for _ in range(len(texts)):
        least = np.minimum(least, np.where(sims >= 0.8 - 1e-4, least[None, :], len(texts)).min(1))
    assert all(least[a] == least[c] for a, c in got.items())


@pytest.mark.parametrize("block", [8, 3])
def test_blocks_do_not_change_links(spark, monkeypatch, block):
    chain = [prose(150, 7)]
    for k in range(60):
        chain.append(changed(chain[-1], 0.01, k))
    star = [changed(chain[0], 0.02, 500 + k) for k in range(60)]
    table = spark.createDataFrame(rows_of(chain + star), SCHEMA)
    want = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(table).collect())
    monkeypatch.setattr(minhash, "BLOCK", block)
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(table).collect()) == want


def test_near_duplicates_odd_rows(spark, empty):
    a, b = prose(80, 1), prose(80, 2)
    kind = "doc_id string, text string, n long, h long, key long, rep string, block int"
    rows = [("b", a), ("a", a), ("c", changed(a, 0.01, 3)), ("c", changed(a, 0.01, 3)), (None, a), (None, None), ("d", b), ("e", None), ("f", "")]
    table = spark.createDataFrame([(i, t, 1, 2, 3, "x", 4) for i, t in rows], kind)
    got = sorted(map(tuple, minhash.near_duplicates(table).collect()), key=str)
    assert [r for r in got if r[0] is None] == [(None, None, True)] * 2
    assert [r for r in got if r[0] is not None] == [("a", "a", True), ("b", "a", False), ("c", "a", False), ("c", "a", False), ("d", "d", True), ("e", "e", True), ("f", "e", False)]
    kept = minhash.stage_near_duplicates(spark, table, "")
    assert kept.columns == table.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["None", "None", "a", "d", "e"]
    assert minhash.stage_near_duplicates(spark, empty, "").count() == 0


def test_hot_keys_join_as_others(spark):
    from parlance.llm._common import keyed_join

    many = spark.createDataFrame([(0 if k % 3 else k, k) for k in range(3000)], "k long, v long")
    one = many.groupBy("k").agg(F.count("*").alias("n")).withColumn("x", F.col("k") * 2)
    got = keyed_join(many, one, ["k"], 3000)
    assert sorted(map(tuple, got.collect())) == sorted((0 if k % 3 else k, k, 2 * (0 if k % 3 else k)) for k in range(3000))


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(5, 5), (200, 201)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[100 + k] == 100 for k in range(30)) and got[201] == 200


def test_quality_network(spark, docs, empty):
    good, bad = [prose(200, k) for k in range(120)], [prose(150, k) + " " + " ".join(w.upper() + "!!" for w in prose(60, k + 500).split()) for k in range(120)]
    texts, y = good[:90] + bad[:90], np.array([1.0] * 90 + [0.0] * 90)
    x, bag = quality_mil.passages(pa.array(texts))
    model = quality_mil.AttentionMil().fit(x, bag, y)
    p = model.score(pa.array(good[90:] + bad[90:]))
    assert ((p >= 0.5) == np.array([True] * 30 + [False] * 30)).mean() > 0.9
    out = {r.doc_id: r.score for r in quality_mil.quality(docs, model).collect()}
    assert len(out) == len(BASE) and all(0 <= s <= 1 for s in out.values()) and out[4] == out[5] and out[0] == out[1]
    assert quality_mil.quality(empty, model).count() == 0


def test_quality_scores_do_not_depend_on_the_batch():
    texts = [prose(RNG.randint(1, 900), k) for k in range(90)] + [None, "", "x" * 5000, "é" * 700, prose(40, 3), prose(40, 3)]
    x, bag = quality_mil.passages(pa.array(texts))
    model = quality_mil.AttentionMil().fit(x, bag, np.arange(len(texts)) % 2.0)
    whole = model.score(pa.array(texts))
    for size in (1, 7):
        parts = [model.score(pa.array(texts[k : k + size], pa.string())) for k in range(0, len(texts), size)]
        assert (np.concatenate(parts) == whole).all()
    shuffled = list(range(len(texts)))
    random.Random(2).shuffle(shuffled)
    assert (model.score(pa.array([texts[k] for k in shuffled])) == whole[shuffled]).all() and whole[-1] == whole[-2]


def test_quality_query_learns_without_held_out_rows(spark, tmp_path):
    import zlib

    good = lambda k: prose(120, k)
    bad = lambda k: " ".join(w.upper() + "!!" for w in prose(90, k).split())
    texts = [good(k) if k % 2 else bad(k) for k in range(400)] + [None, ""]
    spark.createDataFrame(rows_of(texts), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    held = [zlib.crc32(str(k).encode()) % 5 == 0 for k in range(len(texts))]
    # Labels of held out rows are turned round: a model that learned from them would not be right on them.
    labels = spark.createDataFrame([(k, (k % 2) ^ int(held[k]), k % 2) for k in range(400)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in quality_mil.op8_quality_mil(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) and all(got[k].held_out == held[k] for k in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert sum(got[k].predicted == k % 2 for k in range(400) if held[k]) > 0.95 * sum(held[:400])
    toxic = {r.doc_id: r for r in toxicity.op2_toxicity(spark, str(tmp_path)).collect()}
    assert len(toxic) == len(texts) and all(toxic[k].held_out == held[k] for k in toxic)
    assert all(r.toxic == (r.p_toxic >= toxicity.THRESHOLD) for r in toxic.values())


def test_fit_rows_do_not_depend_on_order(spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    rows = [(k, f"text {k} {c}") for k in range(40) for c in "abc"]
    got = [quality_mil.fit_rows(spark.createDataFrame(x, "doc_id long, text string").repartition(n), labels, "quality", 20) for n, x in ((3, rows), (7, rows[::-1]))]
    assert got[0][0].to_pylist() == got[1][0].to_pylist() and (got[0][1] == got[1][1]).all() and all(t.endswith("c") for t in got[0][0].to_pylist())


def test_html():
    model = html_extract.fitted()
    page = (
        '<html><body><nav><ul><li><a href="/x">Menu item</a></li><li><a href="/y">Other</a></li></ul></nav><div class="ad">Buy now, please do.</div>'
        "<article><h1>The title &amp; more</h1><p><b>First\n  paragraph of the text, which is long enough to count as prose.<br>line<p>Second paragraph, again of some length, with a"
        " <a href=#>link</a> inside and an end.</article><div class='comments'><p>What a nice reader comment this is, friends.</p></div><footer>&copy; Someone</footer></body></html>"
    )
    got, none, broken = html_extract.extract([page, "", "</p><<>&#x110000;<div"], model)
    assert got == "The title & more First paragraph of the text, which is long enough to count as prose. line Second paragraph, again of some length, with a link inside and an end."
    assert none == "" and isinstance(broken, str)


ARTICLE = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A title of some words</h1><p>{}</p><p>Another paragraph that is long enough to be read as prose by all means.</p></article><footer>&copy; Us</footer></body></html>"


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ("Area is <math><mi>x</mi><mo>=</mo><mn>42</mn></math> in all", "Area is x=42 in all"), ("See <span class=it's>this</span> and that, it's a text", "See this and that, it's a text"),
        ("an <object data=x.pdf>old <b>fallback</b></object> text", "an old fallback text"), ('a <span title="un>closed</span> quote', "a closed quote"), ("1 < 2 and 3 > 2 <3", "1 < 2 and 3 > 2 <3"),
        ("a<!-- <p>x</p> -->b<![CDATA[c]]>d<?x?>e", "abde"), ("x &lt;b&gt; &#233; &unknown; &amp", "x <b> é &unknown; &"), ("a<script>if (a < b) '</p>'</script>b<style>p{}</style>c", "abc"), ("a <B CLASS='x\ny'\n>b</B\n> c", "a b c"),
    ],
)
def test_html_drops_nothing_of_the_article(inner, want):
    got = html_extract.extract([ARTICLE.format(inner)], html_extract.fitted())[0]
    assert got == f"A title of some words {want} Another paragraph that is long enough to be read as prose by all means."


BROKEN = {
    "quotes": '<a "' * 250_000, "values": '<a b="' * 160_000 + ">", "odd": "<a b='" + "<p>x" * 250_000, "less": "<" * 10**6, "open": "<div>" * 150_000, "ends": "<div>" * 60_000 + "</x>" * 120_000, "comments": "<!--" * 250_000,
    "data": "<![CDATA[" * 110_000, "list": "<ul>" + "<div>" * 50_000 + "<li></li>" * 60_000, "slashes": "<a " + "/" * 10**6 + ">", "equals": "<a " + "= " * 500_000 + ">", "script": "<script>" * 125_000,
}


@pytest.mark.parametrize("name", sorted(BROKEN))
def test_html_time_grows_with_the_page(name):
    import time

    at = time.process_time()
    root = html_extract.parse(BROKEN[name])
    html_extract._text(root, [True] * len(html_extract._walk(root)))
    assert time.process_time() - at < 10  # a scan in the square of a page's length takes minutes here


def test_html_equals_the_articles_of_the_tables():
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()
    texts = html_extract.extract(pages, html_extract.fitted())
    for page, text in zip(pages, texts, strict=True):
        inner = re.search(r"<article>(.*?)</article>", page, re.DOTALL).group(1)
        bare = html_extract.html_lib.unescape(re.sub(r"<[^>]*>", lambda m: "" if re.match(r"</?b>", m.group()) else " ", inner))
        assert text == " ".join(bare.split())


def test_html_labels_never_contradict():
    model = html_extract.fitted()
    rng = np.random.default_rng(5)
    right = total = 0
    for _ in range(60):
        nodes = html_extract._walk(html_extract.parse(html_extract._page(rng)))
        chosen = html_extract.decode(nodes, model.score(html_extract.features(nodes)))
        assert all(chosen[n.parent.order] for n, c in zip(nodes, chosen, strict=True) if c and n.parent)
        truth = html_extract._truths(nodes)
        right, total = right + (np.array(chosen) == truth).sum(), total + len(nodes)
    assert right / total > 0.98


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, "<p>x</p>")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_pages(pages.withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))).collect()}
    assert got[1] == "" and set(got) == {1, 2}
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = {}
    for kind, p in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and not all(int(x) <= 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out[kind].append(m.span())
    return out


def test_pii_base_equals_the_patterns():
    r = random.Random(1)
    for _ in range(4000):
        text = "".join(r.choice("ab@.+-() 0123456789_%é") for _ in range(r.randint(0, 60)))
        assert pii.detect(text) == brute_pii(text)


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("to john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"), ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("call plus one four one five five five five two six seven one", "phone", "plus one four one five five five five two six seven one"),
        ("at １９２.168.0.1 here", "ip", "１９２.168.0.1"), ("4111​1111​1111​1111", "card", "4111​1111​1111​1111"),
    ],
)
def test_pii_disguises(text, kind, span):
    _, added = pii.find(text)
    assert [text[a:b] for a, b in added[kind]] == [span]
    assert span not in pii.masked(text)


@pytest.mark.parametrize(
    ("text", "kind", "base", "added", "masked"),
    [
        ("to jоhn@example.com now", "email", ["hn@example.com"], ["jоhn@example.com"], "to <EMAIL> now"),
        ("to a@mail.example [dot] com now", "email", ["a@mail.example"], ["a@mail.example [dot] com"], "to <EMAIL> now"),
        ("to a@mail.example dot com", "email", ["a@mail.example"], ["a@mail.example dot com"], "to <EMAIL>"),
        ("to john [dot] doe@example.com", "email", ["doe@example.com"], ["john [dot] doe@example.com"], "to <EMAIL>"),
        ("+49 30 1234 56 seven eight nine one.", "phone", ["+49 30 1234 56"], ["+49 30 1234 56 seven eight nine one"], "<PHONE>."),
        ("a@mail.example and one two three four", "email", ["a@mail.example"], [], "<EMAIL> and one two three four"),
        ("bob [dot] smith@example.com", "email", ["smith@example.com"], ["bob [dot] smith@example.com"], "<EMAIL>"),
        ("+1 555 one two three 4567", "phone", [], ["+1 555 one two three 4567"], "<PHONE>"),
        ("at 192 dot 168 dot one dot one now", "ip", [], ["192 dot 168 dot one dot one"], "at <IP> now"),
        ("look at example.com", "email", [], [], "look at example.com"),
    ],
)
def test_pii_fragment_of_a_disguise(text, kind, base, added, masked):
    got = pii.find(text)
    assert [[text[a:b] for a, b in x[kind]] for x in got] == [base, added]
    assert pii.masked(text) == masked


def test_pii_table(spark, docs, empty):
    out = {r.doc_id: r for r in pii.pii_spans(docs).collect()}
    assert len(out) == len(BASE) and out[0].base == [] and [s.kind for s in out[9].base] == ["email", "ip", "card", "phone"]
    staged = pii.stage_pii(spark, docs, "")
    assert staged.columns == docs.columns and staged.where("doc_id = 0").first().text is None
    assert pii.pii_spans(empty).count() == 0 and pii.stage_pii(spark, empty, "").count() == 0
    # Other columns stay as they are, long integers with nulls too.
    big = spark.createDataFrame([(1, "a@b.example.org", 2**60 + 1), (2, None, None)], "doc_id long, text string, base long")
    assert sorted(map(tuple, pii.stage_pii(spark, big, "").collect())) == [(1, "<EMAIL>", 2**60 + 1), (2, None, None)]


LONG = {
    "digits": "1" * 10**6, "dotted": "a." * 500_000 + " [at] x", "ats": "a@" * 500_000, "dots": " dot " * 200_000 + "@", "names": "one " * 250_000, "plus": "+1((((" * 170_000,
    "marks": "[at]" * 250_000, "parts": "1." * 500_000, "mixed": "one 1 " * 160_000,
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_pii_time_grows_with_the_text(name):
    import time

    pii.find(LONG[name][:1000])
    at = time.process_time()
    pii.find(LONG[name])
    assert time.process_time() - at < 10  # a scan in the square of a text's length takes minutes here


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    clean = [prose(90, k) for k in range(60)]
    rows = rows_of([*clean, clean[0], changed(clean[1], 0.005, 1), None, "", clean[2] + " a@b.example.org"])
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sentencepiece":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.where("round_trip").count() == docs.count() > 0
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert not ids & {60, 62, 63}


def test_ids_that_stand_for_several_texts_lose_no_link(spark):
    x, y = prose(80, 71), prose(90, 72)
    near = lambda t: t + " " + VOCABULARY[0]
    rows = [(1, x), (1, y), (5, near(x)), (6, near(y)), (7, prose(70, 73)), (8, None), (8, ""), (9, near(y)), (9, x), (1, x)]
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (5, 1), (6, 1), (7, 7), (8, 8), (8, 8), (9, 1), (9, 1)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "l", 2) for i, t in rows], SCHEMA)
    kept = sorted((r.doc_id, r.text or "") for r in minhash.stage_near_duplicates(spark, docs, "").collect())
    assert kept == sorted([(1, x), (1, y), (7, prose(70, 73)), (8, "")])
    turned = spark.createDataFrame(rows[::-1], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(turned).collect()) == got


def test_texts_of_one_id_in_one_class_leave_one(spark):
    x = prose(100, 81)
    rows = [(3, x, "en", "s", 1, "l", 2), (3, x + " more", "en", "s", 1, "l", 2), (4, x, "en", "s", 1, "l", 2)]
    out = minhash.stage_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert len(out) == 1 and out[0].doc_id == 3
