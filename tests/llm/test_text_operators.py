"""Operators on documents against brute force, on small tables with odd rows."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import bpe, components, masked_lm, minhash, packing, quality, substring, token_blocks, tokens
from brindle.llm.common import Scratch
from brindle.llm.hashing import Words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def body(seed, n, vocabulary=300):
    r = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in r.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def rows():
    base = body(1, 120)
    words = base.split()
    passage = " ".join(f"p{i}" for i in range(60))
    near = [" ".join([*words[:k], f"new{k}", *words[k + 1 :]]) for k in range(5, 60, 3)]
    texts = [base, base, base.upper(), *near, body(2, 80), body(3, 80) + "\n" + passage, passage + " " + body(4, 50), "a " * 70, "", None, "one", "one two", " \t\n ", "één twee\u00a0drie vier", body(5, 4000), "a b c d e f g", "a b c d e f h", "<|endoftext|> x", "  two  spaces\n\nend"]
    return [(i * 3, t, "en", f"s{i}", None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Columns named like an operator's own, and a repeated row.
    return spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string, component string, n long")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def sets(rows, size):
    out = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").encode().translate(FOLD))
        out[i] = frozenset(tuple(w[a : a + size]) for a in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    return out


@pytest.mark.parametrize(("size", "ratio"), [(3, (85, 100)), (5, (80, 100))])
def test_near_duplicates(docs, rows, size, ratio):
    s = sets(rows, size)
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(s, 2):
        both = len(s[a] & s[b])
        if s[a] and s[b] and ratio[1] * both >= ratio[0] * (len(s[a]) + len(s[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = minhash.near_duplicates(docs, size, ratio).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(s[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)


def test_pairs_at_the_threshold_share_a_band():
    for threshold in (0.8, 0.85):
        made = minhash._signatures(3, minhash.bands_for(threshold))(pa.record_batch({"doc_id": [1], "text": [body(3, 300)]}))
        assert (1 - threshold**minhash.ROWS) ** len(made["bands"][0]) <= 1e-5


def test_near_duplicates_empty_and_null_ids(spark, empty):
    assert minhash.near_duplicates(empty).count() == 0
    got = minhash.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, None, True), (4, 2, False), (2, 2, True)}


def test_near_duplicates_of_ids_with_several_texts(spark):
    """A document of two texts has the links of both, whatever row comes first."""
    one, two, three = body(31, 60, 10_000), body(32, 60, 10_000), body(33, 60, 10_000)
    rows = [(1, one), (5, one + " end"), (5, two), (7, two), (8, three), (9, three), (9, three), (2, body(34, 9)), (2, body(35, 9))]
    want = {1: 1, 5: 1, 7: 1, 8: 8, 9: 8, 2: 2}
    for order in (rows, rows[::-1]):
        got = minhash.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert len(got) == len(rows) and all(r.component_id == want[r.doc_id] for r in got)


@pytest.mark.parametrize("one_task", [0, 500_000])
def test_connected_components(spark, monkeypatch, one_task):
    """Both ways of uniting edges, on long paths, a star and random edges."""
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    r = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, 500 + i) for i in range(1, 60)] + [tuple(map(int, x)) for x in r.integers(1000, 1200, (90, 2))] + [(7, 7), (3, 2), (2, 3)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()
    assert {r.id: r.component for r in got} == {x: find(x) for x in root} and len(got) == len(root)


def test_drop_near_duplicates(docs):
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {0} and not {3, 6} & {r.doc_id for r in kept.collect()}


def expected_repeats(rows, k):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows):
        w = WORD.findall((t or "").encode())
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            if key in seen:
                gone[a : a + k] = [True] * k
            seen.add(key)
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("together", [1, 300, 1 << 17])
def test_remove_repeats(docs, rows, spark, monkeypatch, together):
    """Buckets judged whole, dealt by digest, and both; over more ranges than a string's rows fill."""
    monkeypatch.setattr(substring, "TOGETHER", together)
    monkeypatch.setattr(substring, "shuffle_partitions", lambda s: 7)
    want = expected_repeats(rows, 20)
    got = substring.remove_repeats(docs).collect()
    assert len(got) == len(rows) + 1
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want


def test_cut_repeats_keeps_rows_and_columns(docs, rows):
    cut = {r.doc_id: r.text for r in substring.cut_repeats(docs).collect()}
    assert set(cut) == {r[0] for r in rows}
    want = expected_repeats(rows, 20)
    for i, t, *_ in rows:
        if not want[i][1]:
            assert cut[i] == t
        else:
            assert hashlib.sha256(b" ".join(WORD.findall(cut[i].encode()))).hexdigest() == want[i][2]


def test_cut_repeats_of_rows_that_repeat_an_id(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    other = body(21, 60, 10_000)
    rows = [(1, passage), (2, "x y " + passage + " z"), (2, other)]
    got = substring.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = {r.text for r in got if r.doc_id == 2}
    assert len(got) == 3 and "x y z" in texts
    rest = (texts - {"x y z"}).pop().split()
    assert rest and set(rest) <= set(other.split())


def thue_morse(n, first="a", second="b"):
    """Words of polynomial hashes that meet modulo 2**64, whatever the base."""
    return "".join((first, second)[i.bit_count() % 2] for i in range(n))


def test_words_that_meet_in_polynomial_hashes(spark):
    one, two = thue_morse(1024), thue_morse(1024, "b", "a")
    head = " ".join(f"h{i}" for i in range(19))
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"{head} {one}"), (4, f"{head} {two}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert all(r.kept for r in minhash.near_duplicates(docs.filter("doc_id < 3"), 3, (85, 100)).collect())


def test_remove_repeats_random(spark, monkeypatch):
    """Many partial overlaps over few words, in buckets that ranges and sizes cut."""
    monkeypatch.setattr(substring, "TOGETHER", 50)
    monkeypatch.setattr(substring, "shuffle_partitions", lambda s: 9)
    r = np.random.default_rng(17)
    base = [f"w{x}" for x in r.integers(0, 40, 600)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(r.integers(1, 4)):
            a = int(r.integers(0, 550))
            parts += base[a : a + int(r.integers(5, 60))] + [f"x{r.integers(0, 9)}"] * int(r.integers(0, 30))
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, " ".join(base[100:160])) for i in range(60)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in got} == expected_repeats(rows, 20)


def test_remove_repeats_odd_rows(spark):
    """Null ids and texts, versions of a document, and repeated rows."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(None, passage), (None, None), (1, None), (2, passage), (2, passage), (2, "x " + passage), (3, "y " + passage + " z"), (3, "other words")]
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 30, 0), (None, 0, 0), (1, 0, 0), (2, 30, 0), (2, 30, 0), (2, 31, 30), (3, 32, 30), (3, 2, 0)], key=str)


def test_cut_repeats_leaves_other_columns(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, passage, 9, "s", 1.5), (2, "ö " + passage + " é", 9, None, None), (3, None, 9, "spans", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_chars long, spans string, version double")
    got = substring.cut_repeats(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [rows[0], (2, "ö é", 3, None, None), rows[2]]


def test_remove_repeats_empty(empty):
    assert substring.remove_repeats(empty).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(tokens.public_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def test_encode_decode(docs, rows, library):
    t = library["byte_bpe_50k.json"]
    text = {r[0]: r[1] or "" for r in rows}
    for r in bpe.encode_decode(docs).collect():
        ids = t.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_decode_empty(empty, spark):
    assert bpe.encode_decode(empty).count() == 0
    got = bpe.encode_decode(spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2)], "doc_id long, text string, ids_sha256 int")).collect()
    assert len(got) == 3 and {(r.n_tokens, r.ids_sha256) for r in got} == {(0, hashlib.sha256(b"").hexdigest())}


ODD = ["a", "B", "é", " ", "\n", ",", ".", "'s", "'", "1", "²", "\u00a0", "\x1c", "\x85", "日", "<", "|", "$", "\t", "\u0301", "İ", "Σ", "<|endoftext|>"]


def test_fragments_equal_whole_texts(library):
    r = np.random.default_rng(5)
    texts = ["".join(r.choice(ODD, int(n))) for n in r.integers(1, 30, 800)] + ["ab" * 400, "x" * 300]
    own = bpe.load("byte_bpe_50k.json")
    for text in texts:
        ids = library["byte_bpe_50k.json"].encode(text, add_special_tokens=False).ids
        made, counts = own.encode(pa.array([text]))
        assert made.tolist() == ids and counts.tolist() == [len(ids)]
        assert own.decode(made)[0].tobytes().decode("utf-8", "replace") == library["byte_bpe_50k.json"].decode(ids, skip_special_tokens=False)
    for name, kind in (("byte_bpe_50k.json", tokens.SpacedEncoder), ("word_bpe_49k.json", tokens.FragmentEncoder), ("byte_bpe_50k.json", bpe.ByteBpe)):
        for some in (texts, [t for t in texts if "<|" not in t]):  # a text with an added token sends its slice another way
            ids, counts = tokens.encoder(name, kind).encode(pa.array([*some, None, ""]))
            ends = np.cumsum(counts)
            for text, a, b in zip([*some, "", ""], [0, *ends], ends, strict=False):
                assert ids[a:b].tolist() == library[name].encode(text, add_special_tokens=False).ids


def test_fragment_cache_forgets_the_oldest(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 3)
    cache, made = tokens.Cache(), []

    def make(keys):
        made.extend(keys)
        return [k.encode() for k in keys]

    for keys in (["a", "b"], ["c", "a"], ["d"], ["a"], ["e", "f"], ["g", "a"], ["b"]):
        assert cache.find(keys, make) == [k.encode() for k in keys]
    assert made.count("a") == 1 and made.count("b") == 2 and len(cache.young) + len(cache.old) <= 6


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_blocks_round_trip(n):
    r = np.random.default_rng(n)
    ids = np.where(r.random(n) < 0.05, r.integers(0, 2**32, n), r.integers(100, 300, n)).astype(np.uint32)
    assert (token_blocks.decode_blocks(token_blocks.encode_blocks(ids), n) == ids).all()
    same = np.full(n, 7, np.uint32)
    assert (token_blocks.decode_blocks(token_blocks.encode_blocks(same), n) == same).all()


def test_token_files(docs, rows, library):
    start = 0
    got = {r.doc_id: r for r in token_blocks.token_files(docs.dropDuplicates(["doc_id"])).collect()}
    for i, t, *_ in sorted(rows):
        ids = library["byte_bpe_50k.json"].encode(t or "", add_special_tokens=False).ids + [0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_empty(empty):
    assert token_blocks.token_files(empty).count() == 0


def test_pack(docs, rows, library):
    text = {r[0]: r[1] or "" for r in rows}
    got = packing.pack(docs, size=256).collect()
    by_bin = {}
    for r in got:
        ids = library["word_bpe_49k.json"].encode(text[r.doc_id], add_special_tokens=False).ids + [1]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert r.start == 256 * r.piece and (r.length == 256 or r.start + r.length == len(ids))
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_bin.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256


def test_plan_is_tight():
    r = np.random.default_rng(0)
    counts = {int(k): int(n) for k, n in zip(*np.unique(r.integers(1, 4097, 20000), return_counts=True), strict=True)}
    made = packing.plan(counts, 4096)
    packed = {}
    for times, used in made:
        assert sum(k * n for k, n in used) <= 4096
        for k, n in used:
            packed[k] = packed.get(k, 0) + times * n
    assert packed == counts
    assert sum(t for t, _ in made) <= 1.01 * sum(k * n for k, n in counts.items()) / 4096 + 1


def test_pack_empty(empty):
    assert packing.pack(empty).count() == 0


def test_quality_learns_from_the_training_fold_only(spark):
    good = [(i, body(i, 60, 5000), 1) for i in range(300)]
    bad = [(1000 + i, " ".join(w + "$$$" for w in body(i, 60, 5000).split()), 0) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(5000, None), (5001, ""), (None, "x y")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert len(got) == 363 and all(0 <= r.score <= 1 for r in got.values())
    held = [(i, q) for i, _, q in good + bad if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r.held_out and i is not None and i < 5000} == {i for i, _ in held}
    assert np.mean([got[i].predicted == q for i, q in held]) > 0.97
    # The held-out labels don't matter: turned around they give the same scores.
    turned = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, _, q in good + bad], "doc_id long, quality int")
    again = {r.doc_id: r.score for r in quality.score_quality(docs, turned).collect()}
    assert all(again[i] == r.score for i, r in got.items())


def test_quality_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}


def test_quality_of_odd_rows(spark, empty):
    """Empty tables, null and repeated ids, columns with names of its own; each row is kept by its own text."""
    rows = [(i, body(i, 40, 500) if i % 2 else " ".join("$" + w for w in body(i, 40, 500).split())) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    odd = [(None, rows[0][1]), (7, rows[2][1]), (7, rows[1][1]), (7, rows[1][1]), (900, None), (901, "")]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in rows + odd], "doc_id long, text string, score long, predicted string")
    assert quality.score_quality(empty, labels).count() == 0 and quality.keep_quality(empty, labels).count() == 0
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns
    by_id = {}
    for r in kept.collect():
        by_id.setdefault(r.doc_id, []).append(r.text)
    assert None not in by_id and len(by_id[7]) == 3 and rows[2][1] not in by_id[7]
    assert sum(i % 2 == 0 for i in by_id if i is not None and i < 400) <= 4 and sum(i % 2 for i in by_id if i is not None and i < 400) >= 196


def test_ftrl_updates():
    """The vectorised steps against the update rule, coordinate by coordinate."""
    r = np.random.default_rng(2)
    model, z, n = quality.Ftrl(), {}, {}

    def weight(d):
        a = z.get(d, 0.0)
        return 0.0 if abs(a) <= quality.L1 else -(a - math.copysign(quality.L1, a)) / ((quality.BETA + math.sqrt(n.get(d, 0.0))) / quality.ALPHA + quality.L2)

    for step in range(60):
        dims, values, label = r.choice(30, 8, replace=False), r.random(8), step % 2
        w = [weight(d) for d in dims]
        p = 1 / (1 + math.exp(-sum(a * v for a, v in zip(w, values, strict=True))))
        for d, v, a in zip(dims.tolist(), values, w, strict=True):
            g = (p - label) * v
            sigma = (math.sqrt(n.get(d, 0.0) + g * g) - math.sqrt(n.get(d, 0.0))) / quality.ALPHA
            z[d] = z.get(d, 0.0) + g - sigma * a
            n[d] = n.get(d, 0.0) + g * g
        model.learn(dims, values, label)
    assert np.allclose(model.weights(np.arange(30)), [weight(d) for d in range(30)])


def test_lm_scores(docs, rows, empty):
    got = {r.doc_id: r for r in masked_lm.score_documents(docs).collect()}
    for i, t, *_ in rows:
        n = len(WORD.findall((t or "").encode()))
        assert got[i].n_tokens == n and (got[i].score < 0) == (n > 0) and (got[i].mean_score is None) == (n == 0)
    assert got[0].score == pytest.approx(got[3].score) == pytest.approx(got[6].score)
    assert masked_lm.score_documents(empty).count() == 0


def test_lm_score_is_the_sum_of_conditionals():
    text = pa.array(["a b c a b", "c c"])
    words = Words(text, lower=True)
    h = words.hashes().view(np.int64)
    u, n = np.unique(h, return_counts=True)
    vocabulary, net = masked_lm.Vocabulary(u, n.astype(float), len(h), len(u)), masked_lm.Network()
    inputs, classes, _ = vocabulary.look(h)
    context = masked_lm.windows(words.row, inputs)
    assert context[5].tolist() == [masked_lm.EDGE, masked_lm.EDGE, inputs[6], masked_lm.EDGE]
    total = np.stack([net.log_probability(context, np.full(len(h), k)) for k in range(masked_lm.CLASSES)], axis=1)
    assert np.allclose(np.exp(total).sum(axis=1), 1, atol=1e-4)
    loss = lambda: -net.log_probability(context, classes).mean()
    before = loss()
    for _ in range(200):
        net.learn(context, classes, 0.5)
    assert loss() < before / 2


def test_lm_tells_words_of_equal_count_apart():
    """Each of 120 words follows a word of its own: the context gives it more than a share of a group of words."""
    words = Words(pa.array([f"left{i} right{i}" for i in range(120)]), lower=True)
    h = words.hashes().view(np.int64)
    u, n = np.unique(h, return_counts=True)
    vocabulary, net = masked_lm.Vocabulary(u, n.astype(float), len(h), len(u)), masked_lm.Network()
    inputs, outputs, share = vocabulary.look(h)
    context = masked_lm.windows(words.row, inputs)
    for _ in range(1500):
        net.learn(context, outputs, 0.5)
    assert (net.log_probability(context, outputs) + share).mean() > -1.5


def test_lm_scores_by_the_counts_of_all_words(spark, monkeypatch):
    """Texts of one word: probabilities sum to 1, and words that share an output differ by their own counts."""
    monkeypatch.setattr(masked_lm, "SPLIT", 6)
    monkeypatch.setattr(masked_lm, "KNOWN", 2, raising=False)
    counts = {f"w{i}": 200 // (i + 1) + i % 3 + 1 for i in range(150)}
    texts = [w for w, n in counts.items() for _ in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = {}
    for r in masked_lm.score_documents(docs).collect():
        scores.setdefault(texts[r.doc_id], set()).add(r.score)
    assert all(max(x) - min(x) < 1e-4 for x in scores.values())
    scores = {w: x.pop() for w, x in scores.items()}
    assert sum(math.exp(x) for x in scores.values()) == pytest.approx(1, abs=1e-3)
    h = dict(zip(counts, Words(pa.array(list(counts))).hashes().tolist(), strict=True))
    ranked = sorted(counts, key=lambda w: (-counts[w], np.uint64(h[w]).view(np.int64)))[32:]  # 32 have outputs of their own
    for a, b in itertools.combinations(ranked, 2):
        if h[a] % 4 == h[b] % 4:
            assert scores[a] - scores[b] == pytest.approx(math.log(counts[a] / counts[b]), abs=1e-4)


def test_lm_scores_do_not_hang_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "parts_for", lambda total: 3)
    docs = spark.createDataFrame([(i, body(i, 40 + i % 50, 200)) for i in range(120)], "doc_id long, text string")
    one, other = ({r.doc_id: r.score for r in masked_lm.score_documents(d).collect()} for d in (docs.coalesce(1), docs.orderBy(F.desc("doc_id")).repartition(7)))
    assert all(math.isclose(one[i], other[i], rel_tol=1e-5) for i in one)


def test_lm_grows_with_the_corpus():
    sizes = [(masked_lm.split_for(n), masked_lm.width_for(n)) for n in (0, 10**8, 10**9, 10**10)]
    assert sizes == sorted(sizes) and len({s for s, _ in sizes}) == 4 and sizes[-1][1] > sizes[0][1]


def test_near_copies_of_varying_noise(spark, monkeypatch):
    """A large group of copies, some too noisy to be linked, some linked only through others: no link is lost."""
    r = np.random.default_rng(8)
    base = body(9, 150, 100_000).split()
    rows = []
    for i in range(160):
        words = list(base)
        for k in r.choice(150, int(r.integers(0, 16)), replace=False):
            words[k] = f"x{r.integers(0, 40)}"
        rows.append((i, " ".join(words)))
    s = sets(rows, 3)
    root = {i: i for i in s}
    for _ in range(20):
        for a, b in itertools.combinations(s, 2):
            both = len(s[a] & s[b])
            if 100 * both >= 85 * (len(s[a]) + len(s[b]) - both):
                root[a] = root[b] = min(root[a], root[b])
    for one_task in (500_000, 0):
        monkeypatch.setattr("brindle.llm.components.ONE_TASK", one_task)
        got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, (85, 100)).collect()}
        assert got == root
    assert len(set(root.values())) > 5
