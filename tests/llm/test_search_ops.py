"""Hard negatives, byte-level BPE and spelling variants against brute force, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("lodepanel.llm")

import numpy as np  # noqa: E402

from lodepanel.llm import byte_bpe, hard_negatives, spelling  # noqa: E402

SF = "/root/testdata/sf0.001"


# --- hard negatives ---


def brute_negatives(rows, anchor, k=5, scale=256):
    sound = [(r, i, lab, [math.floor(scale * x) for x in v]) for r, (i, v, lab) in enumerate(rows) if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    big = float("inf")
    out = []
    for r, i, lab, v in sound:
        if not anchor(i):
            continue
        scored = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w, strict=False)))), big if j is None else j, lab2, s) for s, j, lab2, w in sound if s != r]
        scored.sort(key=lambda x: (-x[0], x[1], x[3]))
        none = lambda j: None if j == big else j
        for ps, pid, _, _ in [x for x in scored if x[2] == lab][:k]:
            fits = [x for x in scored if x[2] != lab and 80 * ps <= 100 * x[0] <= 100 * ps][:k]
            out += [(i, none(pid), n + 1, none(j), ps, s) for n, (s, j, _, _) in enumerate(fits)]
    return out


def mined(spark, rows, anchors="vec_id % 10 = 0", kind="double"):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, row int, anchor string")
    got = hard_negatives.hard_negatives(df, anchors)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return [tuple(r) for r in got.collect()]


def by_key(rows):
    return sorted(rows, key=lambda r: [(-1 if x is None else x) for x in r])


def test_hard_negatives_against_brute_force(spark):
    rng = random.Random(3)
    centre = [[rng.gauss(0, 1) for _ in range(9)] for _ in range(3)]
    rows = []
    for i in range(300):
        c = rng.randrange(3)
        rows.append((i, [a + rng.gauss(0, 0.6) for a in centre[c]], c if rng.random() < 0.7 else rng.randrange(3)))
    rows += [(400 + i, list(centre[0]), i % 2) for i in range(40)]  # ties
    rows += [(1000, None, 1), (1010, [float("nan")] + [0.0] * 8, 1), (1020, [1.0, None] + [0.0] * 7, 1), (1030, [float("inf")] * 9, 1), (1040, list(centre[1]), None)]
    rows += [(None, list(centre[1]), 1), (None, list(centre[2]), 2), (1050, list(centre[2])[:4], 2), (1060, [], 0), (2000, [3 * x for x in centre[0]], 7), (2000, [3 * x for x in centre[0]], 7), (2001, [3 * x for x in centre[0]], 8)]
    got = mined(spark, rows)
    assert by_key(got) == by_key(brute_negatives(rows, lambda i: i is not None and i % 10 == 0))
    assert len(got) > 100 and any(r[3] is None for r in got) and any(r[0] == r[1] == 2000 for r in got)


def test_hard_negatives_of_any_size(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1e12, -3e11, 0.5, 2e3]) for _ in range(3)], i % 2) for i in range(60)]
    assert by_key(mined(spark, rows)) == by_key(brute_negatives(rows, lambda i: i % 10 == 0))
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(10, [1.0], 1), (20, [0.5], 2)]) == []
    assert mined(spark, [(10, [1.0], 1), (11, [1.0], 1), (12, [0.9], 2)], kind="float") == [(10, 11, 1, 12, 65536, 256 * 230)]


def test_bounds_hold_for_every_row():
    rng = np.random.default_rng(1)
    import pyarrow as pa

    vectors = np.floor(rng.normal(0, 40, (500, 7)))
    edges = np.quantile(vectors[:100], [k / 16 for k in range(1, 16)], axis=0, method="lower").T
    rows = pa.table({"id": list(range(500)), "row": list(range(500)), "label": [0] * 500, "vector": (vectors / 256).tolist()})
    part = hard_negatives.Part(rows, hard_negatives.Cells(edges), 256)
    for anchor in part.vectors[:20]:
        low, high = part.bounds(anchor, part.codes)
        score = part.vectors @ anchor
        assert (low <= score).all() and (score <= high).all()
        assert (high - low).mean() < np.ptp(score)  # they rule out something


# --- byte-level BPE ---


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers as tokenizers

    return byte_bpe.pieces_of(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


def listed(ids):
    return np.frombuffer(ids, dtype=np.int32).tolist()


def test_encoding_equals_the_library(library, pieces):
    rng = random.Random(1)
    letters = ["ab", "aeiou tn", "0123456789 ", "!@#$%^&*()_+-= ", "äöüß éÀ", "日本語中文。、", "\n\t  \r  \x85\xa0\x1c", "\U0001f600\U0001f468‍", "the in er on re an at'll's"]
    for _ in range(4000):
        some = rng.choice(letters) if rng.random() < 0.7 else "".join(letters)
        text = "".join(rng.choice(some) for _ in range(rng.randrange(60)))
        assert listed(pieces.ids(text)) == library.encode_ordinary(text), text
    for text in ("", " ", "  a", "a ", "<|endoftext|>", "a" * 20000, " " * 999 + "x", "=-" * 5000, "don't  we'll\n\n I've"):
        assert listed(pieces.ids(text)) == library.encode_ordinary(text)


def test_pieces_of_any_bytes(library, pieces):
    rng = random.Random(2)
    bpe = pieces.bpe
    for k in range(3000):
        piece = bytes(rng.choice(b"abcdeinorst ") if k % 2 else rng.randrange(256) for _ in range(rng.randrange(1, 40)))
        ids = bpe.encode(piece)
        assert b"".join(bpe.tokens[i] for i in ids) == piece
        assert ids == library._encode_single_piece(piece)


def test_time_is_linear(pieces):
    import time

    took = []
    for n in (100_000, 400_000):
        began = time.process_time()
        pieces.bpe.encode(b"abcabdab" * (n // 8))
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_encode_and_decode_through_spark(spark, library):
    import public_tokenizers as tokenizers

    texts = ["Hello  world's\n", None, "", "日本 x", "a" * 300_000, "same", "same"]
    docs = spark.createDataFrame([(k if k else None, t, "keep", [k]) for k, t in enumerate(texts)], "doc_id long, text string, kept string, body array<int>")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode_texts(docs, path, tokenizers.PATTERN, keep=("doc_id", "kept", "body"))
    both = byte_bpe.decode_ids(coded, path).collect()
    assert len(both) == len(texts)
    for r in both:
        text = texts[r.doc_id or 0] or ""
        assert (r.ids, bytes(r.decoded), r.kept, r.body) == (library.encode_ordinary(text), text.encode(), "keep", [r.doc_id or 0])
    odd = spark.createDataFrame([(1, [0, 99_999_999]), (2, None), (3, []), (4, [0, None, 1])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in byte_bpe.decode_ids(odd, path).collect()} == {1: None, 2: bytearray(), 3: bytearray(), 4: None}
    assert byte_bpe.encode_texts(docs.limit(0), path, tokenizers.PATTERN).count() == 0


def test_op12_digests(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = byte_bpe.op12_byte_bpe(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


# --- spelling ---


def brute_counts(docs):
    counts = Counter()
    for key, text in docs:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", text):
            if key is not None and (h := zlib.crc32(f"{key}:{run}".encode())) % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return counts


def brute_forms(counts):
    near, alike = defaultdict(set), defaultdict(list)
    for w in counts:
        for i in range(len(w)):
            alike[w[:i], w[i + 1 :]].append(w)
            if (shorter := w[:i] + w[i + 1 :]) in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    for same in alike.values():
        for w in same:
            near[w].update(x for x in same if x != w)
    form = {w: min(near[w], key=lambda x: (-counts[x], x)) for w in counts if near[w]}
    form = {w: f for w, f in form.items() if counts[f] >= 5 * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, n, len(near[w]), form.get(w), counts[form[w]] if w in form else None, root(w)) for w, n in counts.items()}


def forms(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = [tuple(r) for r in spelling.spelling_forms(df).select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(got) == len(counts)
    return set(got)


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 64, 200):
        values = rng.permutation(n)
        tree = spelling.WaveletTree(values)
        ends = np.sort(rng.integers(0, n + 1, (50, 2)), axis=1)
        spans = np.sort(rng.integers(0, n + 1, (50, 2)), axis=1)
        ask, value = tree.report(ends[:, 0], ends[:, 1], spans[:, 0], spans[:, 1])
        got = defaultdict(list)
        for a, v in zip(ask.tolist(), value.tolist(), strict=True):
            got[a].append(v)
        for k in range(50):
            want = sorted(v for v in values[ends[k, 0] : ends[k, 1]].tolist() if spans[k, 0] <= v < spans[k, 1])
            assert sorted(got[k]) == want


@pytest.mark.parametrize("hot", [1 << 15, 3])
def test_forms_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(spelling, "HOT", hot)
    rng = random.Random(hot)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(6, 10))) for _ in range(700)}
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "aabaaa", "ÿ" * 6, "ÿ" * 7, "z" * 3000, "z" * 3001, "z" * 2999 + "y"}
    counts = {w: 5 * 6 ** rng.randrange(5) + rng.randrange(2) for w in words}
    assert forms(spark, counts) == brute_forms(counts)


def test_long_chains_have_one_root(spark):
    counts, word = {}, list("abcdefgh")
    for k in range(8):
        counts["".join(word)] = 5 * 5**k
        word[k] = "z"
    got = {r[0]: r[5] for r in forms(spark, counts)}
    assert set(got.values()) == {"zzzzzzzh"}


def test_counts_of_odd_documents(spark):
    rows = [(1, "Wörter, WÖRTER wörter × don't"), (None, "wörter null id"), (2, None), (3, ""), (4, "..."), (5, "x" * 50_000 + " " + "Wort " * 3000)]
    rows += [(k, "letters of Several words in MANY rows") for k in range(10, 300)] + [(10, "letters again")] * 2
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = {r.word: r.n for r in spelling.word_counts(docs).collect()}
    want = brute_counts(rows)
    assert {w: n for w, n in got.items() if w} == {w: n for w, n in want.items() if w}
    assert any(zlib.crc32(f"{i}:letters".encode()) % 199 == 0 for i, _ in rows)  # a letter was lost somewhere
    assert spelling.word_counts(docs.limit(0)).count() == 0
    assert spelling.spelling_forms(docs.limit(0).select("word", "n")).count() == 0


def test_op13_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    words = {w: n for w, n in brute_counts(docs).items() if len(w) >= 6 and n >= 5}
    got = {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.op13_spelling(spark, SF).collect()}
    assert got == brute_forms(words)
