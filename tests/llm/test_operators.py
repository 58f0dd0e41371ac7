"""The ten operators on small tables against brute force, libraries, round trips and held-out rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

TOXIC = "you are an idiot and a moron . what a worthless clown"
CLEAN = ["the river runs by the old mill", "a letter came in the morning post", "we walked along the quiet shore", "bread and salt were on the table"]
ODD = "doc_id long, text string, lang string, source string, n_chars long, spans string, size string, node string, id string, score string, kept string"


def odd(spark, texts, source="s"):
    """Documents with nulls everywhere and extra columns whose names clash with results."""
    rows = [(i, t, None, source if i % 3 else None, None, "x", "x", "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ODD)


def base():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(12)]
    near = texts[0].split()
    near[7] = "changed"
    return [*texts, " ".join(near), texts[1], texts[1], None, "", "   ", "one", "one two", texts[2] + " " + " ".join(rng.choice(words, 3000)), texts[3].upper()]


# --- near duplicates ---


def brute_components(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return [len(s) for s in sets], label


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    from barloom.llm.near_dedup import near_duplicates

    texts = base()
    counts, label = brute_components(texts, size, 80)
    got = sorted(near_duplicates(odd(spark, texts), shingle=size).collect(), key=lambda r: r.doc_id)
    assert [r.n_shingles for r in got] == counts
    assert [r.component_id for r in got] == label
    assert [r.kept for r in got] == [i == x for i, x in enumerate(label)]


def test_near_duplicates_in_a_large_group(spark):
    """Copies of one text with edits of their own: links through the reference and beside it."""
    from barloom.llm.near_dedup import near_duplicates

    rng = np.random.default_rng(2)
    original = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(60):
        t = list(original)
        for p in rng.choice(100, rng.integers(0, 16), replace=False):
            t[p] = f"x{i}_{p}" if rng.random() < 0.7 else "y"
        texts.append(" ".join(t))
    _, label = brute_components(texts, 2, 80)
    got = sorted(near_duplicates(odd(spark, texts), shingle=2).collect(), key=lambda r: r.doc_id)
    assert [r.component_id for r in got] == label


def near_copies(count, words=120, most=21):
    rng = np.random.default_rng(11)
    first = [f"w{i}" for i in range(words)]
    texts = []
    for i in range(count):
        text = list(first)
        for at in rng.choice(words, 1 + i % most, replace=False):
            text[at] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(text))
    return texts


@pytest.fixture
def left(monkeypatch):
    """Rows of the index, of what the references see and of each later round."""
    from barloom.llm import near_dedup

    found, mixed = [], near_dedup._mixed

    def counted(live, *args, **kwargs):
        out = mixed(live, *args, **kwargs)
        found.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "_mixed", counted)
    return found


def test_near_copies_leave_rows_in_proportion(spark, left):
    """Rounds after the first start with a few rows of a large group, not with its index rows."""
    from barloom.llm.near_dedup import near_duplicates

    texts = near_copies(200)
    got = sorted(near_duplicates(odd(spark, texts), shingle=2).collect(), key=lambda r: r.doc_id)
    assert [r.component_id for r in got] == brute_components(texts, 2, 80)[1]
    assert left[0] > 10 * len(texts)
    assert sum(left[2:]) < 2 * len(texts), left


def test_pipeline_near_copies_leave_rows_in_proportion(spark, left):
    import corpus_pipeline

    texts = near_copies(150, words=300)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, odd(spark, texts), "").collect()}
    assert kept == set(brute_components(texts, 5, 80)[1])
    assert left[0] > 10 * len(texts)
    assert sum(left[2:]) < 2 * len(texts), left


def test_near_copies_linked_by_the_core_alone(spark):
    """Sets near the core of which none is the reference's neighbour, passages that only some share, and two groups."""
    from barloom.llm.near_dedup import near_duplicates

    passage = " ".join(f"p{i}" for i in range(30))
    texts = [t + (f" {passage}" if i % 3 == 0 else "") for i, t in enumerate(near_copies(60, most=12))]
    texts += [t.replace("w", "v") for t in near_copies(40, words=80, most=16)]
    got = sorted(near_duplicates(odd(spark, texts), shingle=2).collect(), key=lambda r: r.doc_id)
    assert [r.component_id for r in got] == brute_components(texts, 2, 80)[1]


def test_near_duplicates_without_ids_and_rows(spark):
    from barloom.llm.near_dedup import near_duplicates

    rows = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, "a b c"), (4, "a b c"), (9, "a b c")], "doc_id long, text string")
    got = [(r.doc_id, r.component_id, r.kept) for r in near_duplicates(rows, shingle=2).collect()]
    assert sorted(got, key=str) == sorted([(None, None, True)] * 2 + [(4, 4, True)] * 2 + [(9, 4, False)], key=str)
    assert near_duplicates(rows.limit(0)).count() == 0


# --- repeats ---


def test_sets_first_met_without_an_id(spark):
    from barloom.llm.near_dedup import near_duplicates

    words = [f"w{i}" for i in range(80)]
    near = " ".join([*words, "more"])
    rows = spark.createDataFrame([(None, near), (7, near), (3, " ".join(words))], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates(rows).collect()}
    assert got == {None: (None, True), 7: (3, False), 3: (3, True)}


def brute_repeats(rows, length):
    seen, out = {}, {}
    for i, t in sorted(rows):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], i)
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        out[i] = bytes(c for c, g in zip(t, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize(("length", "block"), [(50, 2_000), (50, 1 << 20), (12, 700), (1, 500)])
def test_repeats(spark, length, block):
    from barloom.llm.suffix_dedup import remove_repeats

    texts = base()
    texts += [texts[4][20:90] + "é" * 30 + texts[5][:80], "z" * 300, "z" * 120, "zz" + texts[6][100:160] + "qq"]
    found = remove_repeats(odd(spark, texts), length=length, block_bytes=block, bucket_rows=300)
    got = {r.doc_id: bytes(r.kept) for r in found.collect()}
    assert got == brute_repeats([(i, (t or "").encode()) for i, t in enumerate(texts)], length)


def test_hot_leading_key_is_cut_into_windows(spark):
    from barloom.llm.suffix_dedup import remove_repeats

    line = "this very common line stands in every single document of the table, word for word"
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("klmnop"), 30)) + line + "".join(rng.choice(list("klmnop"), 30)) for _ in range(200)]
    got = {r.doc_id: bytes(r.kept) for r in remove_repeats(odd(spark, texts), block_bytes=900, bucket_rows=200).collect()}
    assert got == brute_repeats([(i, t.encode()) for i, t in enumerate(texts)], 50)


def test_buckets_do_not_depend_on_the_block(spark):
    from barloom.llm.suffix_dedup import remove_repeats

    line = "this very common line stands in the first half of the table only, word for word"
    rng = np.random.default_rng(2)
    make = lambda n: "".join(rng.choice(list("klmnop"), n))
    shared = [make(60) for _ in range(150)]
    # Hot lines only in the blocks of the first half; every other passage once in each half.
    texts = [make(20) + line + make(20) + s + make(20) for s in shared] + [make(60) + s + make(60) for s in shared]
    docs = odd(spark, texts).repartitionByRange(2, "doc_id")
    got = {r.doc_id: bytes(r.kept) for r in remove_repeats(docs, block_bytes=900, bucket_rows=200).collect()}
    assert got == brute_repeats([(i, t.encode()) for i, t in enumerate(texts)], 50)


def test_repeats_without_ids_and_passages(spark):
    from barloom.llm.suffix_dedup import cut_passages, remove_repeats

    t = "abcdefghij" * 8
    rows = spark.createDataFrame([(None, t), (3, t), (None, t), (3, t)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, len(r.kept)) for r in remove_repeats(rows).collect()) == [(0, 0), (0, 0), (3, 80), (3, 80)]
    assert remove_repeats(rows.limit(0)).count() == 0
    passage = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"start one {passage} end"), (2, f"other begin {passage} finish é"), (3, "alone"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in cut_passages(docs).collect()}
    assert got[1].count("word") == 60 and got[3] == "alone" and got[4] is None
    assert "word5" not in got[2] and got[2].startswith("other begin") and got[2].endswith("finish é")


# --- tokens ---


@pytest.fixture(scope="module")
def odd_texts():
    rng = np.random.default_rng(3)
    chars = list("ab thein  ▁\n\t\x1c\x85éΣςİʼ'sdv12<|😀한漢ñ̈０²½.,;!-")
    made = ["".join(rng.choice(chars, rng.integers(0, 60))) for _ in range(300)]
    return [*made, "", "x" * 3000, "<|endoftext|>a<|startoftext|>  b", "don't I'LL we've", " lead  trail ", "   " * 20]


def test_token_counts_equal_the_library(spark, odd_texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    from barloom.llm.token_count import count_tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    expected = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(odd_texts, add_special_tokens=False)]
    got = sorted(count_tokens(odd(spark, [*odd_texts, None]), path).collect(), key=lambda r: r.doc_id)
    assert [r.n_tokens for r in got] == [*expected, 0]
    assert [r.n_bytes for r in got] == [len(t.encode()) for t in odd_texts] + [0]
    assert [r.over_limit for r in got] == [n > 2048 for n in [*expected, 0]]


def test_pieces_equal_the_library_and_come_back(spark, odd_texts):
    import public_tokenizers
    import sentencepiece

    from barloom.llm.pieces import MARK, decode, encode

    path = public_tokenizers.path("piece_bpe_32k.model")
    expected = sentencepiece.SentencePieceProcessor(model_file=path).encode(odd_texts)
    got = sorted(decode(encode(odd(spark, [*odd_texts, None]), path), path).collect(), key=lambda r: r.doc_id)
    assert [r.ids for r in got] == [*expected, []]
    assert [r.decoded for r in got] == [t.replace(MARK, " ") for t in odd_texts] + [""]


# --- TIFF ---


@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, 16])
def test_tiff_round_trip(compression, predictor, tile):
    from barloom.llm.tiff import Reader, write_gray

    rng = np.random.default_rng(4)
    images = [rng.integers(0, 256, (37, 50)).astype(np.uint8), np.zeros((5, 64), np.uint8), np.tile(np.arange(90, dtype=np.uint8), (80, 1))]
    data = write_gray(images, compression=compression, predictor=predictor, strip_rows=10, tile=tile)
    pages = list(Reader(data).pages())
    assert [(p.number, p.height, p.width) for p in pages] == [(i, *x.shape) for i, x in enumerate(images)]
    assert [p.pixels for p in pages] == [x.tobytes() for x in images]


def test_long_lzw_and_packbits():
    from barloom.llm.tiff import lzw_decode, lzw_encode, pack_bits, unpack_bits

    rng = np.random.default_rng(4)
    for data in (b"", b"a", bytes(rng.integers(0, 4, 60_000).astype(np.uint8)), bytes(rng.integers(0, 256, 30_000).astype(np.uint8)), b"ab" * 9000):
        assert lzw_decode(lzw_encode(data)) == data
        assert unpack_bits(pack_bits(data)) == data


def test_tiff_texts_and_faults(spark):
    from barloom.llm.tiff import payload, read_pages, store_texts

    texts = base()
    got = sorted(read_pages(store_texts(odd(spark, texts))).collect(), key=lambda r: r.doc_id)
    assert [bytes(r.pixels) for r in got] == [payload((t or "").encode()) for t in texts]
    assert got[13].feature == got[14].feature == got[1].feature
    bad = spark.createDataFrame([(1, bytearray(b"")), (2, None), (3, bytearray(b"II*\0\xff\xff\0\0")), (4, bytearray(b"II*\0\x08\0\0\0\0\0\0\0\0\0"))], "id long, media binary")
    assert all(r.page is None and r.error for r in read_pages(bad).collect())
    assert read_pages(bad.limit(0)).count() == 0


# --- sharding ---


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards(spark, shards):
    from barloom.llm.sharding import kd_shards

    rng = np.random.default_rng(6)
    texts = ["x" * int(n) for n in rng.integers(0, 400, 700)] + ["same text"] * 40 + [None, "", "é" * 2000]
    got = kd_shards(odd(spark, texts), shards=shards).collect()
    assert len(got) == len(texts)
    sizes = [sum(r["size"] for r in got if r.shard == s) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 2 * 4001
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got)
    assert kd_shards(odd(spark, []), shards=shards).count() == 0


def test_shards_of_equal_rows(spark):
    from barloom.llm.sharding import kd_shards

    got = kd_shards(odd(spark, ["abc"] * 64), shards=8).collect()
    assert sorted(sum(r.shard == s for r in got) for s in range(8)) == [8] * 8
    rows = spark.createDataFrame([(1, "a")] * 5, "doc_id long, text string")
    assert kd_shards(rows, shards=2).count() == 5


# --- mixing ---


def test_mix(spark):
    from barloom.llm.mixing import mix, targets

    rng = np.random.default_rng(7)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), ["b", "a", None, "c"][i % 4] if i % 5 else "a") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).collect()
    total = {}
    for r in got:
        total[r.source] = total.get(r.source, 0) + r["size"]
    expected = targets(list(total.items()), [5, 2, 1], 1.5, 2.0)
    for s in total:
        part = [r for r in got if r.source == s]
        assert {round(r.target, 6) for r in part} == {round(expected[s], 6)}
        assert abs(sum(r.taken for r in part) - expected[s]) <= 80
    assert sum(expected.values()) == pytest.approx(1.5 * sum(total.values()))
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in got)
    again = {r.doc_id: r.taken for r in mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    assert mix(docs.limit(0)).count() == 0
    assert mix(odd(spark, [None, "", "a b", "a b"])).count() == 4


def test_mix_prefers_quality(spark):
    from barloom.llm.mixing import mix

    rows = [(i, "w w w w" if i % 2 else "w 1. 2. 3.", "a") for i in range(2000)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.3).collect()
    good = sum(r.taken > 0 for r in got if r.doc_id % 2)
    assert good > 1.5 * sum(r.taken > 0 for r in got if not r.doc_id % 2)


# --- URL filter ---


def test_urls(spark):
    from barloom.llm.queries import RULES
    from barloom.llm.url_filter import judge

    html = {
        5: '<link rel="canonical" href="http://bad.net/x">', 6: "<META HTTP-EQUIV=refresh CONTENT='0; url=/moved'>", 7: '<link href=http://ok.example.net/en/1 rel=canonical>',
        8: '<link rel="canonical" href="http://a.info/5">',
    }
    urls = ["http://WWW.Example.NET/en/a?x#y", "https://example.net/de/", "http://m.example.com/de/1", "ftp://x.org/fr/q", "http://x.org/de/", "http://a.info/5", "http://b.info/p/6", "http://bad.net/7", "http://c.info/8#frag", None, "no scheme", "http://net", "http://b.info/moved", "http://a.info/5"]
    pages = spark.createDataFrame([(i, u, html.get(i), "z", "z") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    more = spark.createDataFrame([("http://b.info/moved", "http://x.org/fr/q"), (None, "http://x.org/")], "src string, dst string")
    got = {r.page_id: r for r in judge(pages, rules, redirects=more).collect()}
    assert len(got) == len(urls)
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("www.example.net", "/en/a", "example.net/en/", "allow")
    assert [got[i].verdict for i in (1, 2, 3, 4)] == ["block", "block", "allow", "allow"]
    assert [got[i].how for i in (5, 6, 8, 12, 13)] == ["alias"] * 5
    # 5 and 8 share a component with a blocked page; 6 and 12 reach an explicit allow.
    assert [got[i].verdict for i in (5, 8, 13, 6, 12)] == ["block"] * 3 + ["allow"] * 2
    assert got[7].verdict == "block" and got[7].rule == "net/"
    assert [(got[i].host, got[i].path, got[i].verdict) for i in (9, 10)] == [("", "", "allow")] * 2
    assert (got[11].host, got[11].path, got[11].rule) == ("net", "", None)
    assert judge(pages.limit(0), rules).count() == 0


# --- neighbours ---


def test_neighbours(spark):
    from barloom.llm.neighbours import search

    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 16))
    x[50:90] = x[50]
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)]
    rows += [(600, None, "z"), (601, [0.0] * 16, "z"), (602, [float("nan")] * 16, "z"), (603, [None] + [1.0] * 15, "z"), (None, x[3].tolist(), "z")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")
    got = search(vectors, vectors.where("vec_id % 20 = 0"), cell=64).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 600, 20):
        s = u[q] @ u.T
        s[q] = -9
        best = np.lexsort((np.arange(600), -np.round(s, 12)))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert len(mine) == 5 and all(abs(r.score - s[r.vec_id]) < 1e-12 for r in mine)
        hit += len(set(best) & {r.vec_id for r in mine})
        if q == 60:
            assert [r.vec_id for r in mine] == [50, 51, 52, 53, 54]
    assert hit >= 0.95 * 5 * 30
    few = vectors.where("vec_id < 3")
    assert search(few, few).count() == 6
    assert search(vectors.limit(0), vectors).count() == 0


def test_neighbours_widen_until_found(spark):
    from barloom.llm.neighbours import search

    rng = np.random.default_rng(14)
    x = rng.normal(size=(3000, 48))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    # A beam too small for the table has to grow by itself.
    got = search(vectors, vectors.where("vec_id % 100 = 0"), k=8, sample=4, rounds=2, trees=1, cell=64, beam=6).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 3000, 100):
        s = u[q] @ u.T
        s[q] = -9
        hit += len(set(np.argsort(-s)[:5]) & {r.vec_id for r in got if r.query_id == q})
    assert hit >= 0.9 * 5 * 30


def test_neighbours_walk_takes_no_job_a_step(spark):
    from barloom.llm.neighbours import search

    rng = np.random.default_rng(21)
    x = rng.normal(size=(4000, 48))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    spark.sparkContext.setJobGroup("walk", "walk")
    try:
        got = search(vectors, vectors.where("vec_id % 100 = 0"), k=12, sample=6, cell=64, beam=12)
        got = got.collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("walk"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 4000, 100):
        s = u[q] @ u.T
        s[q] = -9
        hit += len(set(np.argsort(-s)[:5]) & {r.vec_id for r in got if r.query_id == q})
    assert hit >= 0.9 * 5 * 40
    assert jobs <= 100


def test_neighbours_of_several_shards(spark):
    from barloom.llm.neighbours import search

    rng = np.random.default_rng(22)
    x = rng.normal(size=(2500, 32))
    x[1000:1600] = x[1000] + 0.01 * rng.normal(size=(600, 32))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = search(vectors, vectors.where("vec_id % 50 = 0"), cell=64, beam=24, shard=400).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 2500, 50):
        s = u[q] @ u.T
        s[q] = -9
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and all(abs(r.score - s[r.vec_id]) < 1e-9 for r in mine)
        hit += len(set(np.argsort(-s)[:5]) & {r.vec_id for r in mine})
    assert hit >= 0.9 * 5 * 50


# --- toxicity ---


def test_toxicity(spark):
    from barloom.llm.toxicity import fit, score

    rng = np.random.default_rng(11)
    rows = []
    for i in range(240):
        words = " ".join(rng.choice(CLEAN, 3)).split()
        if i % 4 == 0:
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(["idiot", "moron", "worthless", "clown"])))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.where("doc_id % 5 <> 0").select("doc_id", "toxic")
    model = fit(docs, labels)
    got = score(docs.where("doc_id % 5 = 0"), model).collect()
    assert all((r.score >= 0.3) == bool(r.toxic) for r in got)
    other = odd(spark, [None, "", "x" * 5000, "what an idiiot", "an id.iot", "the quiet morning", TOXIC, TOXIC + " river" * 30_000])
    got = sorted(score(other, model, score_col="p").collect(), key=lambda r: r.doc_id)
    p = [r.p for r in got]
    assert all(0 <= x <= 1 for x in p)
    assert p[0] == p[1] and p[0] < 0.3 and p[5] < 0.3
    assert min(p[3], p[6], p[7]) >= 0.3
    assert fit(docs, labels.limit(0)) is None and fit(docs, labels.where("toxic = 0")) is None and fit(docs.limit(0), labels) is None
    assert [r.score for r in score(docs.limit(2), None).collect()] == [0.0, 0.0]


# --- shared helpers and the pipeline ---


def test_components(spark):
    from barloom.llm.common import Scratch, connected_components

    rng = np.random.default_rng(12)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900 + i) for i in range(50)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert {r.id: r.component for r in got} == {x: find(x) for x in parent if x not in loops}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def test_pipeline_judges_texts_of_one_id_apart(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (5, c), (5, c), (5, b + " more"), (6, None), (6, ""), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sum(x == (5, b) or x == (5, b + " more") for x in got) == 1
    assert sorted(x for x in got if x[1] and "b1" not in x[1]) == [(1, a), (5, c)]
    assert {x[1] for x in got if x[0] == 6} == {None, ""} and len(got) == 5


def test_pipeline_cuts_passages_of_short_words(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    passage = " ".join("abcdefghijklmnopqrstuvwxyz"[i * i % 26] for i in range(50))
    docs = spark.createDataFrame([(1, f"first text {passage} end"), (2, f"other one {passage} tail")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, docs, "").collect()}
    assert passage in got[1] and passage not in got[2]


def test_pipeline(spark, tmp_path):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    rng = np.random.default_rng(13)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(900)]
    passage = " ".join(rng.choice(words, 70))
    rows, labels = [], []
    for i in range(120):
        t = " ".join(rng.choice(words, 80))
        if i % 6 == 0:
            t = f"{t} idiot {t[:40]} moron"
        if i in (31, 41, 51):
            t = f"{t[:100]} {passage} {t[100:]}"
        rows.append([i, t, "en", ["a", "b", None][i % 3], len(t), "x"])
        labels.append((i, 1, int(i % 6 == 0)))
    rows[70][1] = rows[71][1]
    rows += [[None, "no id here", None, "a", None, "x"], [200, None, None, None, None, None], [201, "", "en", "b", 0, "x"], rows[71]]
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, taken string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, str(tmp_path))
        left.write.parquet(str(tmp_path / name))
        left = spark.read.parquet(str(tmp_path / name))
        seen[name] = left.collect()
        if name != "pieces":
            assert left.columns == docs.columns
    assert not {r.doc_id for r in seen["toxicity"]} & {i for i in range(0, 120, 6)}
    assert len(seen["toxicity"]) == len(rows) - 20
    kept = [r.doc_id for r in seen["near_dedup"]]
    assert kept.count(71) == 0 and kept.count(70) == 1 and kept.count(None) == 1 and len(kept) == len(seen["toxicity"]) - 2
    texts = {r.doc_id: r for r in seen["suffix_dedup"]}
    assert passage in texts[31].text and passage not in texts[41].text and passage not in texts[51].text
    assert texts[41].n_chars == len(texts[41].text) and texts[5].text == rows[5][1]
    before = sum(len((r.text or "").split()) for r in seen["suffix_dedup"])
    assert abs(sum(len((r.text or "").split()) for r in seen["mixing"]) / before - 1.5) < 0.05
    assert len(seen["pieces"]) == len(seen["mixing"]) and all(r.n_pieces == len(r.ids) for r in seen["pieces"])


# --- parts of operators, and the registered queries ---


def test_multikey_sort():
    from barloom.llm.suffix_dedup import multikey_sort

    rng = np.random.default_rng(21)
    for n, width in ((0, 10), (1, 10), (7, 3), (5000, 9), (20_000, 60)):
        rows = rng.integers(0, 3, (n, width)).astype(np.uint8)
        rows[::3] = rows[:1]
        order, group = multikey_sort(rows)
        data = [r.tobytes() for r in rows]
        assert [data[i] for i in order] == sorted(data)
        names = {x: i for i, x in enumerate(sorted(set(data)))}
        assert group.tolist() == [names[x] for x in sorted(data)]


def test_runs_over_chunk_borders(monkeypatch):
    import pyarrow as pa

    from barloom.llm import suffix_dedup as D

    rng = np.random.default_rng(22)
    texts = ["".join(rng.choice(list("abcd"), n)) for n in (700, 20, 49, 50, 3000, 0, 260)]
    block = D.Block(pa.table({"id": list(range(len(texts))), "text": texts}), "id", "text")
    whole = D.Runs(block, 50, 16)
    monkeypatch.setattr(D, "_CHUNK", 97)
    cut = D.Runs(block, 50, 16)
    # Chunks may divide a run, but no window and no anchor changes.
    spread = lambda r: {p: a for s, e, a in zip(r.start, r.end, r.anchor, strict=True) for p in range(s, e + 1)}
    assert spread(whole) == spread(cut)
    assert len(spread(whole)) == sum(max(0, len(t) - 49) for t in texts)


def test_shingles_of_long_texts(monkeypatch):
    from barloom.llm import near_dedup as N

    rng = np.random.default_rng(23)
    texts = [" ".join("".join(rng.choice(list("abé"), int(rng.integers(1, 9)))) for _ in range(n)).encode() for n in (0, 1, 400, 900)]
    texts += [b"x" * 5000, b"  \t ", b"a" * 300 + b" " + b"B" * 900 + b" tail"]
    whole = N.shingle_sets(texts, 2)
    monkeypatch.setattr(N, "CHUNK", 64)
    for a, b in zip(whole, N.shingle_sets(texts, 2), strict=True):
        assert np.array_equal(a, b)


def test_pieces_in_parts_and_caches(monkeypatch):
    import public_tokenizers
    import sentencepiece

    from barloom.llm import pieces as P

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(24)
    text = "".join(rng.choice(list("ab the  ▁\n éς漢.")) for _ in range(4000)) + "x" * 3000
    monkeypatch.setattr(P, "PART", 200)
    monkeypatch.setattr(P, "CACHE_BYTES", 40_000)
    monkeypatch.setattr(P, "CACHE_PAIRS", 200)
    model = P.Pieces(path)
    for _ in range(2):
        got = model.encode([text, "", text[:100]])
        assert [np.frombuffer(x, "<i4").tolist() for x in got] == [library.encode(t) for t in (text, "", text[:100])]
    for i in range(300):
        model.encode([f"w{i}a w{i}b w{i}c"])
        held = sum(200 + 6 * len(w) for w in (*model.cache.young, *model.cache.old))
        assert held <= 2 * 40_000 and len(model.stable.young) + len(model.stable.old) <= 2 * 200
    assert P.Surfaces(path).decode(np.array(library.encode(text), np.int32)).decode() == text.replace("▁", " ")


def test_idle_workers_give_their_model_back(monkeypatch):
    import time

    from barloom.llm import common as C

    made = []

    @C.tidy
    def user(batches):
        model = C.held_model("m", lambda: made.append(1) or [len(made)])
        for b in batches:
            yield model[0] + b

    @C.tidy
    def other(batches):
        yield from batches

    def gone():
        until = time.monotonic() + 20
        while C._MODEL and time.monotonic() < until:
            list(other([1]))  # tasks of other operators don't hold it
            time.sleep(0.02)
        return not C._MODEL

    monkeypatch.setattr(C, "IDLE", 0.3)
    C._MODEL.clear()
    assert list(user([1, 2])) == [2, 3] and gone()
    # A task that comes soon finds the model, and one that lasts longer than IDLE keeps it.
    list(user([1]))
    running = user([1, 2])
    assert next(running) == 3
    time.sleep(0.6)
    assert C._MODEL and len(made) == 2
    assert list(running) == [4] and gone()
    # Failed and abandoned tasks hold nothing either.
    running = user([1, 2])
    next(running)
    running.close()
    assert gone() and len(made) == 3


def test_idle_spark_workers_hold_no_pieces(spark):
    import time

    import public_tokenizers

    from barloom.llm.pieces import encode

    path = public_tokenizers.path("piece_bpe_32k.model")
    assert encode(odd(spark, base()).repartition(4), path).count() == len(base())
    time.sleep(3)

    def held(batches):
        import pyarrow as pa

        from barloom.llm import common

        for _ in batches:
            time.sleep(0.5)
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(common._MODEL)], pa.int64())})

    rows = spark.range(4, numPartitions=4).mapInArrow(held, "n long").collect()
    assert [r.n for r in rows] == [0] * 4


def test_subsequence_kernel():
    from itertools import combinations

    from barloom.llm.toxicity import DECAY, ORDER, _codes, kernel

    def brute(s, t):
        total = 0.0
        for a in combinations(range(len(s)), ORDER):
            for b in combinations(range(len(t)), ORDER):
                if [s[i] for i in a] == [t[j] for j in b]:
                    total += DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    words = ["^idiot", "^id.iot", "^idi", "^moron", "^clown", "^mooron", "^aaaa", "^abcabc"]
    for s in words:
        got = kernel(np.broadcast_to(_codes([s, *words])[:1], _codes([s, *words])[1:].shape), _codes([s, *words])[1:])
        assert np.allclose(got, [brute(s, t) for t in words], rtol=1e-4)


@pytest.mark.parametrize("shards", [2, 5])
def test_shards_are_leaves_of_the_tree(spark, shards):
    """The tree by hand: the widest dimension, and the rows up to the weighted quantile to the left."""
    from barloom.llm.sharding import kd_shards, text_dimensions

    rng = np.random.default_rng(25)
    texts = ["".join(rng.choice(list("ab 12é"), int(rng.integers(0, 90)))) for _ in range(160)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select("doc_id", F.octet_length("text") + 1, F.xxhash64("text"), F.array(*text_dimensions(F.col("text")))).collect()
    rows = [(tuple(r[3]), r[2], r[0], r[1]) for r in rows]
    wide = [max(1, max(r[0][d] for r in rows) - min(r[0][d] for r in rows)) for d in range(4)]
    want = {}

    def divide(part, first, n):
        if n == 1:
            want.update(dict.fromkeys((r[2] for r in part), first))
            return
        spread = [(max(r[0][d] for r in part) - min(r[0][d] for r in part)) / wide[d] for d in range(4)]
        d = spread.index(max(spread))
        part = sorted(part, key=lambda r: (r[0][d], r[1], r[2]))
        need, total, cut = sum(r[3] for r in part) * (n // 2) / n, 0, 0
        for i, r in enumerate(part):
            total += r[3]
            cut = i + 1 if total - r[3] / 2 <= need else cut
        divide(part[:cut], first, n // 2)
        divide(part[cut:], first + n // 2, n - n // 2)

    divide(rows, 0, shards)
    got = {r.doc_id: r.shard for r in kd_shards(docs, shards=shards, slack=0.0).collect()}
    assert got == want


def test_tiff_files_that_lie(spark):
    import struct

    from barloom.llm.tiff import read_pages, write_gray

    def tiff(*tags, data=b"\1" * 100):
        body = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0\0\0\0"
        return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + body

    size = [(256, 4, 1, 10), (257, 4, 1, 10), (258, 3, 1, 8)]
    strip = [(273, 4, 1, 8), (278, 4, 1, 10), (279, 4, 1, 100)]
    files = [
        tiff(*size, *strip), tiff((256, 4, 0, 10), *size[1:], *strip), tiff(*size, (322, 4, 1, 0), (323, 4, 1, 8), (324, 4, 1, 8), (325, 4, 1, 64)),
        tiff((256, 2, 1, 65), *size[1:], *strip), tiff((256, 4, 1, 1 << 20), (257, 4, 1, 1 << 20), (258, 3, 1, 8), (273, 4, 1, 8), (278, 4, 1, 1 << 20), (279, 4, 1, 100)),
        tiff(*size), tiff(*size, (273, 4, 1, 900), *strip[1:]), tiff(*size, (273, 4, 1, 8), (278, 4, 1, 0), (279, 4, 1, 100)), tiff(*size, (277, 3, 1, 0), *strip),
        tiff((256, 4, 1, 10), (257, 4, 1, 10), (258, 3, 1, 8), (259, 3, 1, 8), *strip), write_gray([np.zeros((4, 4), np.uint8)])[:60],
    ]
    got = sorted(read_pages(spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "id int, media binary")).collect(), key=lambda r: r.id)
    assert [r.id for r in got] == list(range(len(files)))
    assert bytes(got[0].pixels) == b"\1" * 100 and got[0].error is None
    assert all(r.page is None and r.pixels is None and r.error for r in got[1:])


def test_neighbours_of_mixed_lengths_and_ties(spark):
    from barloom.llm.neighbours import search

    rows = [(0, [1.0, 0.0, 0.0, 0.0]), (1, [3.0, 4.0, 0.0, 0.0]), (2, [3.0, 0.0, 4.0, 0.0]), (3, [3.0, 0.0, 0.0, 4.0]), (4, [0.0, 1.0, 0.0, 0.0]), (5, [1.0, 2.0, 3.0]), (6, [1.0] * 5), (7, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in search(vectors, vectors.where("vec_id in (0, 5)"), top=4).collect()}
    # Three different vectors at the same cosine come by id.
    assert [got[0, i] for i in (1, 2, 3, 4)] == [(1, 0.6), (2, 0.6), (3, 0.6), (4, 0.0)]
    assert {q for q, _ in got} == {0}


def test_registered_queries_keep_their_contracts(spark, tmp_path):
    import hashlib

    from barloom.llm import queries as Q

    texts = [*base(), "é" * 70_000, "you idiot", "<|endoftext|>"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    run = lambda f: sorted(f(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    data = [(t or "").encode() for t in texts]
    for r, d in zip(run(Q.op2_tiff), data, strict=True):
        padded = d + b"\0" * (-len(d) % 64 or (0 if d else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(d), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:]) and r.media_bytes > 0 and len(r.media_sha256) == 64 and r.feature
    assert all((r.n_bytes, r.over_limit) == (len(d), r.n_tokens > 2048) for r, d in zip(run(Q.op3_token_count), data, strict=True))
    for r, d in zip(run(Q.op4_sharding), data, strict=True):
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(d) + 1, zlib.crc32(d), "bytes", None) and 0 <= r.shard < 8
    for r in run(Q.op6_toxicity):
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
