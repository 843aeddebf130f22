"""Vector join, cross-tokenizer alignment and ranked search against brute force and SQL, with edge cases."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

from weblens.llm import cross_align, lexical_search, vector_join

SF = "/root/testdata/sf0.001"


# --- vectors -----------------------------------------------------------------------------------------

def _by_all_pairs(rows, least):
    """{row: (links, component)} of (id, vector) rows, by place."""
    fine = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v, float)
            v = v / np.abs(v).max()
            fine[k] = v / np.linalg.norm(v)
    links = defaultdict(set)
    for a in fine:
        for b in fine:
            if a < b and len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] >= least:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        out[k] = len(links[k]), min((rows[n][0] for n in seen if rows[n][0] is not None), default=None)
    return out


def _families(rng, count, size, spread):
    """Vectors around centres, from copies to just beyond the threshold."""
    out = []
    for _ in range(count):
        centre = rng.normal(size=size)
        centre /= np.linalg.norm(centre)
        for _ in range(int(rng.integers(1, 30))):
            out.append((centre + rng.uniform(0, spread) * rng.normal(size=size) / np.sqrt(size)).astype(np.float32).tolist())
    return out


@pytest.mark.parametrize("size, least, tile", [(16, 0.9, 1 << 12), (3, 0.95, 1 << 11), (64, 0.9, 1 << 20), (1, 0.5, 1 << 20), (7, 0.99, 1 << 11)])
def test_vector_join_equals_all_pairs(spark, size, least, tile):
    rng = np.random.default_rng(size)
    vectors = _families(rng, 25, size, 0.7) + [[2.0] * size] * 40 + [[x * 3 for x in v] for v in _families(rng, 3, size, 0.01)]
    rows = list(enumerate(vectors))
    rng.shuffle(rows)
    rows = [(int(i), v) for i, v in rows]
    want = _by_all_pairs(rows, least)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_join.near_vectors(frame, least, tile=tile).collect()}
    assert got == {i: (*want[k], want[k][1] == i) for k, (i, _) in enumerate(rows)}


def test_a_dense_group_is_settled_by_its_tiles(spark, monkeypatch):
    """Near copies in many tiles: all are linked, and most pairs of tiles are told by their summaries."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    vectors = [(centre + 0.02 * rng.normal(size=16)).tolist() for _ in range(900)] + rng.normal(size=(300, 16)).tolist()
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    want = _by_all_pairs(list(enumerate(vectors)), 0.9)
    settled = []
    original = vector_join._settled
    monkeypatch.setattr(vector_join, "_settled", lambda tiles, pairs: settled.append(pairs.count()) or original(tiles, pairs))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_join.near_vectors(frame, tile=1 << 12).collect()}
    assert got == want and settled[0] > 20


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1e-3]), (2, [1.0, 0.0]), (None, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [-0.0, 1.0]),
            (7, [0.0, 2.0]), (8, [1.0, None]), (9, [nan, 1.0]), (10, [inf, 1.0]), (11, [1.0, 0.0, 0.0]), (12, [1e-300, 0.0]), (13, [1e300, 1e290]),
            (None, None), (None, [0.0, 0.0, 1.0])]
    schema = "vec_id long, embedding array<double>, id int, key string, vector int, point int, copies int, links string, `again` int, root int"
    frame = spark.createDataFrame([(*r, 1, "k", 2, 3, 4, "l", 5, 6) for r in rows], schema)
    want = _by_all_pairs(rows, 0.9)
    got = sorted(((r.vec_id or -1, r.n_links, r.component_id or -1) for r in vector_join.near_vectors(frame).collect()))
    assert got == sorted((i or -1, want[k][0], want[k][1] or -1) for k, (i, _) in enumerate(rows))
    assert vector_join.near_vectors(frame.limit(0)).collect() == []
    with pytest.raises(ValueError):
        vector_join.near_vectors(frame, 0)


# --- alignment ----------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def paths():
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def by_hand(paths):
    """Aligns one text by walking along both token lists, with the libraries' own encodings."""
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(paths[0])
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    letters = cross_align._byte_of_letter()

    def align(text):
        if not text:
            return [], [], [], []
        a, b = library.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        a_bytes = [bytes(letters[c] for c in library.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in a]
        b_bytes = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + text).encode()
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            return [], [], [], []
        groups, links, left, right, i, j = [], [], [], [], 0, 0
        x, y = len(a_bytes[0]), len(b_bytes[0])
        while True:
            links.append((a[i], b[j]))
            ended_a, ended_b = x <= y, y <= x
            if ended_a:
                left.append(a[i])
            if ended_b:
                right.append(b[j])
            if ended_a and ended_b:
                groups.append((left, right))
                left, right = [], []
            if ended_a:
                i += 1
            if ended_b:
                j += 1
            if i == len(a) or j == len(b):
                return a, b, groups, links
            x, y = x + (len(a_bytes[i]) if ended_a else 0), y + (len(b_bytes[j]) if ended_b else 0)
    return align


def _want(texts, align):
    found = [(i, *align(t)) for i, t in texts]
    counts = Counter(link for *_, links in found for link in links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = []
    for i, a, b, groups, links in found:
        written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        rows.append((i, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
                     hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return rows


def _sorted(rows):
    return sorted(rows, key=repr)


TEXTS = [
    (1, "plain words, twice."), (1, "plain words, twice."), (2, None), (3, ""), (4, " "), (5, "  two  blanks "), (6, "\n\n\ttabs\n"), (7, "<s>special</s> <|endoftext|>"),
    (8, "é 中文 😀 \U0010ffff"), (9, "▁ already ▁marked"), (None, "no id"), (10, "x" * 30_000), (11, "word " * 20_000), (12, "a\x00b\x7f"), (13, "ﬁ ligature Å"),
    (14, "日本語のテキスト" * 300), (15, "1234567890 3.14159"), (16, "​zero‍ width"), (17, "ЁЖ ñandú straße"),
]


@pytest.mark.parametrize("head", [1_000_000, 3])
def test_alignment_equals_a_walk_by_hand(spark, paths, by_hand, monkeypatch, head):
    """Also where almost no pair travels with the tasks, so that the join tells their counts."""
    monkeypatch.setattr(cross_align, "HEAD", head)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    texts = TEXTS + [(r.doc_id + 100, r.text) for r in docs.collect()]
    frame = spark.createDataFrame([(*t, "r", 2, "p") for t in texts], "doc_id long, text string, row string, pairs int, id string").repartition(3)
    got = [tuple(r) for r in cross_align.aligned_documents(frame, *paths).collect()]
    assert _sorted(got) == _sorted(_want(texts, by_hand))


def test_alignment_of_no_documents(spark, paths):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert cross_align.aligned_documents(empty, *paths).collect() == []
    assert [tuple(r)[1:] for r in cross_align.aligned_documents(spark.createDataFrame([(1, None)], "doc_id long, text string"), *paths).collect()] == [
        (0, 0, 0, 0, 0, 0, "")]


def test_groups_are_the_intersection_of_ends(spark, paths, by_hand):
    frame = spark.createDataFrame(TEXTS, "doc_id long, text string")
    rows = {r.doc_id: r for r in cross_align.alignments(frame, *paths).collect()}
    for i, text in TEXTS:
        _, _, groups, _ = by_hand(text)
        r = rows[i]
        at = list(zip([0, *r.a_ends], r.a_ends, [0, *r.b_ends], r.b_ends))
        assert [(r.a_ids[a:b], r.b_ids[c:d]) for a, b, c, d in at] == groups
        assert not groups or r.byte_ends[-1] == len((" " + text).encode())


@pytest.mark.parametrize("seed", range(4))
def test_cuts_of_random_ends(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        a, b, a_stops, b_stops, base = [], [], [], [], 0
        for _ in range(int(rng.integers(1, 6))):
            size = int(rng.integers(1, 400))
            for ends, stops in ((a, a_stops), (b, b_stops)):
                inner = np.flatnonzero(rng.random(size - 1) < rng.random()) + 1
                ends.extend((base + inner).tolist() + [base + size])
                stops.append(len(ends) - 1)
            base += size
        a, b = np.array(a), np.array(b)
        cut_a, cut_b = cross_align.common_ends(a, b, np.array(a_stops), np.array(b_stops))
        common = np.intersect1d(a, b)
        assert a[cut_a].tolist() == common.tolist() and b[cut_b].tolist() == common.tolist()


def test_the_quick_encoder_equals_the_library(paths):
    """On every character that it may meet, and on random strings."""
    tools = cross_align.encoder(*paths)
    assert tools.quick is not None
    rng = np.random.default_rng(1)
    letters = [chr(c) for c in range(0x370)]
    texts = [f"a{c}1{c}{c}!{c} {c}b" for c in letters] + ["".join(rng.choice(letters, 12)) for _ in range(3000)]
    texts += ["".join(rng.choice(["a", "the", " ", "  ", "'re", "ing", "<s>", "<|endoftext|>", "\n", "12", "..."], 9)) for _ in range(3000)]
    library = [e.ids for e in tools.library.encode_batch(texts, add_special_tokens=False)]
    assert [tools.quick.encode_ordinary(t) for t in texts] == library == tools.a(texts)


# --- search -------------------------------------------------------------------------------------------

def _by_definition(docs, items, k=20):
    """Each item's best documents, straight from the definition of the score."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    counted = [(i, Counter(term.findall((t or "").translate(lower)))) for i, t in docs]
    filled = sum(bool(c) for _, c in counted)
    words = sum(c.total() for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        asked, scores = Counter(term.findall((text or "").translate(lower))), []
        for i, c in counted:
            score = 0
            for w, times in asked.items():
                if c[w]:
                    weight = int(np.floor(1000 * np.log((2.0 * filled + 2) / (2.0 * df[w] + 1))))
                    m = 75 + (25 * c.total() * filled) // words
                    score += times * weight * ((1_000_000_000 * c[w]) // (1000 * c[w] + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("chunk, block", [(200_000, 20_000), (50, 7)])
def test_search_equals_the_definition(spark, monkeypatch, chunk, block):
    """Also over chunks of a few documents and blocks of a few queries."""
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    rng = np.random.default_rng(4)
    vocabulary = np.array([f"w{k}" for k in range(60)] + ["Größe", "中文", "İ"])
    share = 1 / np.arange(1, len(vocabulary) + 1)
    draw = lambda n: " ".join(rng.choice(vocabulary, n, p=share / share.sum()))
    docs = [(int(i), draw(int(rng.integers(0, 40)))) for i in rng.permutation(300)] + [(5, "w1 w2 w2"), (5, "w1 w2 w2"), (None, "w1 w2 w2"), (None, None), (6, ""), (7, "W1-w2,W59 " * 3000)]
    items = [(i, draw(int(rng.integers(1, 12)))) for i in range(12)] + [(3, "w1 w2"), (3, "w1 w2"), (None, "w3 w3 w3"), (20, None), (21, ""), (22, "absent"), (23, "?!")]
    frame = spark.createDataFrame([(*d, "c", 1, "q") for d in docs], "doc_id long, text string, chunk string, rank int, query string").repartition(4)
    queries = spark.createDataFrame([(*q, 1, "s") for q in items], "item_id long, text string, doc_id int, score string")
    got = [tuple(r) for r in lexical_search.search(frame, queries, chunk=chunk).collect()]
    assert _sorted(got) == _sorted(_by_definition(docs, items))
    assert lexical_search.ranked_documents(frame.limit(0), queries).collect() == []
    assert lexical_search.ranked_documents(frame, queries.limit(0)).collect() == []


def test_search_equals_sql(spark):
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    docs, items = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "benchmark"))
    got = sorted(tuple(r) for r in lexical_search.ranked_documents(docs, items).collect())
    assert got == sorted(duck.execute(lexical_search.SQL).fetchall()) and len(got) == 800


def test_no_new_accumulators_once_they_could_not_reach_the_kth_score():
    """Documents that only hold the last, common term are not scored when k others are ahead of them."""
    import pyarrow as pa

    n, k = 400, 5
    terms = [[1, 9] if i < 10 else [9] for i in range(n)]
    ends = np.cumsum([len(t) for t in terms])
    postings = lexical_search.Postings(
        pa.array(range(n)), np.full(n, 10), ends, np.concatenate(terms), np.ones(len(np.concatenate(terms)), np.int64), n, 10 * n)
    impact = postings.impact
    places, scores = postings.best(np.array([1, 9]), np.array([5000, 3]), k)
    assert places.tolist() == [0, 1, 2, 3, 4] and (scores == impact[0] * 5003).all()
    places, scores = postings.best(np.array([1, 9]), np.array([3, 5000]), k)  # the common term decides: all stay open
    assert places.tolist() == [0, 1, 2, 3, 4] and (scores == impact[0] * 5003).all()
