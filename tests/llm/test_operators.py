"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from weblens.llm import (
    decontaminate, language, line_dedup, mixing, ngram_join, prefix_tokens, quality, sharding, url_filter, warc,
)
from weblens.llm.graph import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def _linked(texts, n, percent):
    sets = {}
    for i, text in texts.items():
        words = WORD.findall((text or "").translate(ASCII_LOWER))
        sets[i] = {tuple(words[k:k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join_equals_brute_force(docs, texts):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_documents(docs).collect()}
    assert found == _linked(texts, 4, 85)


def test_ngram_join_of_edited_copies(spark):
    """Families of copies with a few words changed, near the threshold on both sides."""
    rng = np.random.default_rng(5)
    texts = {}
    for family in range(6):
        base = [f"w{family}x{k}" for k in rng.integers(0, 400, 120)]
        for copy in range(25):
            words = list(base)
            for at in rng.integers(0, len(words), rng.integers(0, 5)):
                words[at] = f"c{rng.integers(0, 10**9)}"
            texts[family * 100 + copy] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_documents(docs).collect()}
    assert found == _linked(texts, 4, 85)


def test_packed_slots_round_trip():
    rng = np.random.default_rng(1)
    for size, top in ((0, 10), (1, 1), (500, 600), (500, 1 << 19)):
        slots = np.sort(rng.integers(0, top, size)).astype(np.uint32)
        assert (ngram_join._unpacked(ngram_join._packed(slots)) == slots).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({roots[i] for i in range(61)}) == 1 and len({roots[i] for i in range(100, 140)}) == 1
    assert roots[0] != roots[100] and 200 not in roots


def test_repeated_blocks_are_cut(docs, texts):
    least = line_dedup.LEAST_WORDS
    found = {r.doc_id: set(r.deleted_lines) for r in line_dedup.deduplicated_documents(docs).collect()}
    seen: set = set()
    for i in sorted(texts):
        lines = [(line.strip(" \t\r\x0b\x0c"), len(WORD.findall(line)), k) for k, line in enumerate((texts[i] or "").split("\n")) if WORD.search(line)]
        shortest, all_runs = set(), set()
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += lines[b][1]
                run = tuple(x[0] for x in lines[a:b + 1])
                numbers = {x[2] for x in lines[a:b + 1]}
                if total >= least or len(run) == len(lines):
                    all_runs.add(run)
                    if run in seen:
                        shortest |= numbers
        assert found[i] == shortest, i
        seen |= all_runs


def test_patience_diff_aligns_in_order():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (rng.integers(0, 8, rng.integers(0, 14)).tolist() for _ in range(2))
        pairs = line_dedup.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_moved_blocks_are_cut():
    one, two = list(range(10)), list(range(20, 30))
    assert line_dedup.common_blocks(one + two, [5] * 20, two + one, [(0, 4), (10, 14)], 20) == set(range(20))


def test_shards_are_even_and_stable(docs):
    rows = sharding.sharded_documents(docs).collect()
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.sharded_documents(docs.repartition(5)).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}


def test_flow_keeps_rows_at_home_while_there_is_room():
    _, owners = sharding.ring(8)
    counts = np.random.default_rng(2).integers(0, 50, len(owners))
    counts[3] += 3000  # one arc with a hot key
    pieces = sharding.flow(counts, owners, 8)
    placed = Counter()
    for arc, first, stop, shard, _ in pieces:
        placed[shard] += stop - first
    assert sum(placed.values()) == counts.sum() and max(placed.values()) - min(placed.values()) <= 1
    at_home = sum(stop - first for arc, first, stop, shard, _ in pieces if owners[arc] == shard)
    room = counts.sum() // 8
    assert at_home >= sum(min(room, counts[owners == s].sum()) for s in range(8))


def test_targets_share_out_what_is_too_much():
    sizes, weights = np.array([10.0, 1000.0, 500.0]), np.array([1.0, 2.0, 3.0])
    goal = mixing.targets(sizes, weights, sizes.sum())
    assert goal[0] == 30 and abs(goal.sum() - sizes.sum()) < 1e-6 and abs(goal[1] / goal[2] - 2 / 3) < 1e-9


def test_mix_equals_the_sorted_queue(docs, texts):
    rows = mixing.mixed_documents(docs).collect()
    total = sum(r.size for r in rows)
    taken = sum(r.taken for r in rows)
    assert {r.doc_id: r.size for r in rows} == {i: len(WORD.findall(t or "")) for i, t in texts.items()}
    assert taken <= total and total - taken < max(r.size for r in rows)
    by_source: dict = {}
    for r in rows:
        key = (r.source_size, r.target)
        by_source.setdefault(key, []).append(r)
    for (_, target), own in by_source.items():
        assert abs(sum(r.taken for r in own) - target) <= 1.5 * max(r.size for r in own)


def test_language_of_held_out_rows(docs):
    known = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.identified_documents(docs).collect()
    held = [r for r in rows if r.held_out and known[r.doc_id]]
    assert sum(r.lang_pred == known[r.doc_id] for r in held) / len(held) > 0.95


def test_quality_counts_equal_brute_force(spark, docs, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for r in quality.judged_documents(docs, labels).collect():
        text = texts[r.doc_id] or ""
        words = WORD.findall(text)
        windows = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
        inside = {k + j for k in range(len(words) - 4) if windows[tuple(words[k:k + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(words) < 10 or 100 * len(inside) > 20 * len(words))


def test_viterbi_finds_the_best_sequence():
    rng = np.random.default_rng(4)
    field = quality.Field(np.zeros((len(quality.FEATURES), 2)), rng.normal(size=(2, 2)))
    for _ in range(50):
        scores = rng.normal(size=(6, 2))

        def value(labels):
            return sum(scores[k][x] for k, x in enumerate(labels)) + sum(field.transition[a][b] for a, b in zip(labels, labels[1:]))

        every = [[n >> k & 1 for k in range(6)] for n in range(64)]
        assert abs(value(field.best(scores.tolist())) - max(map(value, every))) < 1e-9


def test_leaks_are_found_also_when_edited(spark, docs, texts):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in benchmark.collect()}
    exact = {(d, i) for d, t in texts.items() for i, s in items.items() if s in (t or "")}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()} >= exact
    item = max(items, key=lambda i: len(items[i]))
    words = items[item].split()
    words[4::9] = ["other"] * len(words[4::9])
    edited = spark.createDataFrame([(1, "before it " + " ".join(words) + " after it"), (2, "nothing of the kind here")], "doc_id long, text string")
    found = decontaminate.leaks(edited, benchmark).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, item)] and 0.5 < found[0].score < 1


@pytest.mark.parametrize("share", [1 / 3, 0.75])
def test_leaks_are_found_however_many_documents_hold_them(spark, share):
    rng = np.random.default_rng(9)
    total, leaked = 3200, round(3200 * share)
    # Three items of different lengths; the other words are of no item.
    items = {i: [f"w{i}x{k}" for k in range(n)] for i, n in enumerate((15, 18, 40))}
    rows = []
    for d in range(total):
        words = [f"other{k}" for k in rng.integers(0, 5000, 60)]
        for i, item in items.items():
            copy = list(item)
            if d >= leaked:  # an edited copy, words replaced or left out
                for k in rng.permutation(len(copy))[:round(len(copy) * (0.2, 0.25, 0.3)[d % 3])]:
                    copy[k] = "" if d % 2 and k % 4 == 0 else "changed"
            if d < leaked or d % 8 == 0:
                at = int(rng.integers(0, 60))
                words[at:at] = copy
        rows.append((d, " ".join(words)))
    number = {}
    coded = {d: np.array([number.setdefault(w, len(number)) for w in text.split()]) for d, text in rows}
    expected = {}
    for i, item in items.items():
        x = np.array([number[w] for w in item])
        for d, y in coded.items():
            points = decontaminate.align(x, y)[0]
            if points >= len(x):
                expected[d, i] = points / (2 * len(x))
    assert len(expected) > 3 * leaked + 100
    benchmark = spark.createDataFrame([(i, " ".join(item)) for i, item in items.items()], "item_id long, text string")
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), benchmark).collect()
    assert {(r.doc_id, r.item_id): r.score for r in found} == expected


def test_items_of_one_or_two_words_are_found_in_longer_documents(spark):
    benchmark = spark.createDataFrame([(1, "zebra"), (2, "green zebra"), (3, "one two three four")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "far off a Green Zebra stood"), (2, "a zebra"), (3, "zebra"), (4, "green zebra"), (5, "green"), (6, "so it ends in green"),
        (7, "zebra then one two three four"), (8, "one two"), (9, ""), (10, None)], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): (r.first_word, r.words, r.score) for r in decontaminate.leaks(docs.coalesce(1), benchmark).collect()}
    assert found == {(1, 1): (4, 1, 1), (1, 2): (3, 2, 1), (2, 1): (1, 1, 1), (3, 1): (0, 1, 1), (4, 1): (1, 1, 1),
                     (4, 2): (0, 2, 1), (7, 1): (0, 1, 1), (7, 3): (2, 4, 1), (8, 3): (0, 2, 0.5)}


def _all_pairs(rows, items):
    """Scores of all documents aligned with all items, without seeds."""
    number: dict[str, int] = {}
    code = lambda text: np.array([number.setdefault(w, len(number)) for w in text.split()])
    coded = [(d, code(t)) for d, t in rows]
    found = {(d, i): decontaminate.align(x, y)[0] / (2 * len(x)) for i, x in ((i, code(t)) for i, t in items) for d, y in coded}
    return {k: s for k, s in found.items() if s >= 0.5}


def _equal_all_pairs(spark, rows, items):
    expected = _all_pairs(rows, items)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), benchmark).collect()
    assert {(r.doc_id, r.item_id): r.score for r in found} == expected
    return expected


def test_items_that_share_a_template_are_all_found(spark):
    """30 items with 14 words in common; documents with the template, or with most of it and own words."""
    template = [f"t{k}" for k in range(14)]
    items = [(i, " ".join(template[:7] + [f"i{i}x{k}" for k in range(6)] + template[7:])) for i in range(30)]
    rows = [(2 * i, " ".join(["before", *template[:7], *(f"d{i}x{k}" for k in range(6)), *template[7:], "after"])) for i in range(30)]
    rows += [(2 * i + 1, " ".join([*template[:6], f"i{i}x0", "new", *(f"d{i}x{k}" for k in range(4)), *template[7:]])) for i in range(30)]
    assert len(_equal_all_pairs(spark, rows, items)) >= 900


@pytest.mark.parametrize("how", ["replace", "insert", "delete", "mixed"])
def test_edited_copies_are_found_at_every_score(spark, how):
    """Words replaced, put in or left out one by one, down to the least score and below; also every third word replaced."""
    rng = np.random.default_rng(12)
    vocabulary = [f"v{k}" for k in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate((3, 4, 5, 9, 15, 22, 30, 59))]
    rows = []
    for _, text in items:
        for share in np.linspace(0, 0.7, 15):
            words = text.split()
            for k in sorted(rng.permutation(len(words))[:round(share * len(words))], reverse=True):
                act = how if how != "mixed" else ("replace", "insert", "delete")[int(rng.integers(3))]
                words[k:k + 1] = {"replace": ["other"], "insert": [words[k], rng.choice(vocabulary)], "delete": []}[act]
            around = [list(rng.choice(vocabulary, 40)) for _ in range(2)]
            rows.append((len(rows), " ".join([*around[0], *words, *around[1]])))
        words = text.split()
        words[2::3] = ["third"] * len(words[2::3])
        rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), " between ".join(text.split())))
    assert len(_equal_all_pairs(spark, rows, items)) > 80


def test_no_alignment_scores_more_than_the_bound():
    rng = np.random.default_rng(10)
    for _ in range(300):
        item, text = rng.integers(0, 12, rng.integers(1, 12)), rng.integers(0, 12, rng.integers(1, 9))
        assert decontaminate.align(item, text)[0] <= decontaminate.most_points(item, text)
    assert decontaminate.most_points(np.arange(3), np.arange(5, 9)) == 0


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(6)
    for _ in range(100):
        a, b = rng.integers(0, 5, 9), rng.integers(0, 5, 14)
        h = np.zeros((10, 15), int)
        for i in range(1, 10):
            for j in range(1, 15):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


def test_urls_equal_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    expected = sorted(duck.execute(url_filter.SQL).fetchall(), key=repr)
    assert sorted(map(tuple, url_filter.judged_pages(spark.read.parquet(f"{SF}/pages.parquet")).collect()), key=repr) == expected


def test_pages_come_back_from_archives(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    rows = warc.archived_pages(pages).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest) for r in rows} == {i: (len(h), warc.digest(h)) for i, h in html.items()}


def test_damage_costs_only_the_records_it_touches():
    made = [warc.record(i, "http://x", f"page {i} ".encode() * 50) for i in range(20)]
    archive, starts = bytearray(), []
    for member in made:
        starts.append(len(archive))
        archive += member + b"\0"
    rng = np.random.default_rng(8)
    for _ in range(150):
        k = int(rng.integers(20))
        broken = bytearray(archive)
        broken[starts[k] + int(rng.integers(len(made[k])))] ^= 1 << int(rng.integers(8))
        found = list(warc.salvage(bytes(broken)))
        whole = {int(r.headers["warc-record-id"][10:-1]) for r in found if isinstance(r, warc.Record)}
        gaps = [r for r in found if not isinstance(r, warc.Record)]
        assert whole >= set(range(20)) - {k}
        assert k in whole or (len(gaps) == 1 and gaps[0][0] == starts[k])
    plain = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [type(r).__name__ for r in warc.salvage(plain[:20] + plain + made[0])] == ["tuple", "Record", "Record"]


def test_stored_prefixes_answer_as_the_library_does(spark, docs, texts, monkeypatch):
    """Truncation and counts of prefixes from the stored columns alone, on whole documents."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    budgets, lengths = [1, 64, 1024], [0, 1, 7, 100, 10**6]
    kept = prefix_tokens.stored(prefix_tokens.with_prefixes(docs.select("doc_id", "text"), path).drop("text"), "prefixes")
    monkeypatch.setattr(prefix_tokens, "counter", None)  # nothing is encoded from here on
    rows = prefix_tokens.counts_at(prefix_tokens.cut(kept, budgets), lengths).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        whole = library.encode(text, add_special_tokens=False)
        assert r.n_tokens == len(whole.ids)
        for budget in budgets:
            ends = [e for _, e in whole.offsets[:budget]]
            covered = len(text[:ends[-1]].encode()) if ends else 0
            # A budget may end inside a character of several bytes; the library's offsets then take the whole character.
            assert 0 <= covered - r[f"bytes_{budget}"] <= 3
            if text.isascii() or budget >= len(whole.ids):
                assert covered == r[f"bytes_{budget}"]
        for n in lengths:
            assert r[f"tokens_{n}"] == len(library.encode(text[:n], add_special_tokens=False).ids), (r.doc_id, n)


@pytest.mark.parametrize("seed", range(3))
def test_every_prefix_has_the_count_of_its_own_encoding(seed):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, tokens, rng = Tokenizer.from_file(path), prefix_tokens.counter(path), np.random.default_rng(seed)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'re", "'s", "'ll", "'", "!!", "é", "中", "😀", "12", "<|endoftext|>", "<|", "x" * 9, "　", "\xa0", "=="]
    for _ in range(200):
        text = "".join(rng.choice(parts, rng.integers(0, 9)))
        n, steps, sizes = tokens.table(text)
        counts = np.cumsum(prefix_tokens.prefix_steps(steps)).tolist()
        assert counts == [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)], text
        assert n == len(sizes) // 2 and int(np.frombuffer(sizes, "<u2").sum()) == len(text.encode())


def test_tokens_of_a_long_piece_are_looked_up_only_where_one_may_end(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens, rng, looked_up = prefix_tokens.counter(path), np.random.default_rng(5), []

    class Counted(set):
        def __contains__(self, token):
            looked_up.append(token)
            return super().__contains__(token)

    monkeypatch.setattr(tokens, "whole", Counted(tokens.whole))
    piece = "".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 200))
    counts, last = tokens.prefix_counts(piece.encode())
    assert counts[-1] == len(Tokenizer.from_file(path).encode(piece, add_special_tokens=False).ids)
    assert b"".join(last[1:2]) == piece[:1].encode() and len(looked_up) < 6 * len(piece)


def test_tokens_are_not_looked_up_again_in_new_pieces_of_known_parts(monkeypatch):
    """A new piece costs a step per byte: the tokens that may end behind known bytes are known."""
    import public_tokenizers

    tokens, rng, looked_up = prefix_tokens.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json")), np.random.default_rng(6), []

    class Counted(set):
        def __contains__(self, token):
            looked_up.append(token)
            return super().__contains__(token)

    monkeypatch.setattr(tokens, "whole", Counted(tokens.whole))
    words = [" " + "".join(rng.choice(["ver", "en", "lich", "ä", "ung", "be"], 6)) for _ in range(2000)]
    for word in words[:1000]:
        tokens.piece(word)
    first = len(looked_up)
    new = set(words[1000:]) - set(words[:1000])
    for word in new:
        tokens.piece(word)
    assert len(new) > 500 and len(looked_up) - first < len(new)
    assert first < 20_000


def test_both_patterns_cut_the_same_pieces():
    import public_tokenizers

    tokens, rng = prefix_tokens.counter(public_tokenizers.path("byte_bpe_50k.json")), np.random.default_rng(7)
    plane = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x10000))]
    for text in ("".join(plane), " ".join(plane), "a".join(plane), "\n\n".join(plane), " '".join(plane)):
        assert tokens._plane.findall(text) == tokens.pattern.findall(text)
    parts = ["a", "'s", "'S", "'ll", "'", " ", "\t", "\x1c", "\x85", "\u2028", "1", "½", "Ⅷ", "_", "-", "é", "e\u0301", "中", "\u200b", "\ufeff"]
    for _ in range(500):
        text = "".join(rng.choice(parts, rng.integers(0, 12)))
        assert tokens._plane.findall(text) == tokens.pattern.findall(text), text
        assert (tokens._plane_run.search(text) is None) == (prefix_tokens._RUN.search(text) is None), text
