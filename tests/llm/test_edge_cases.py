"""NULLs in any column, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import public_tokenizers
import pytest

import corpus_pipeline
from weblens.llm import (
    decontaminate, language, line_dedup, mixing, ngram_join, prefix_tokens, quality, sharding, url_filter, warc,
)

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, shard string, size string, "
          "verdict string, score string, node int, row int, has_letter string, letter int, __text int, key string, h1 string, "
          "id string, `a.b` int, point int, query int, rank string")
WORDS = "these are plain words of an ordinary sentence that goes on for a while and then it ends here."


def _row(doc_id, text, lang="en", source="a"):
    return doc_id, text, lang, source, 0, "x", "y", "z", "s", 1, 2, "n", 3, 4, "k", "h", "i", 5, 6, 7, "r"


ROWS = [
    _row(1, WORDS), _row(1, WORDS), _row(2, WORDS), _row(3, None), _row(4, ""), _row(5, " \n\t "), _row(None, WORDS + " more"),
    _row(None, None, None, None), _row(6, "word " * 60_000), _row(7, "x" * 300_000), _row(8, "one two", None, None),
    _row(9, "\u00e9\u4e2d\U0001f600 ## 12", "de", "b"), _row(10, WORDS.upper(), "de", ""), _row(11, "short", "en", "c"),
]
BENCHMARK = [(1, "ordinary sentence that goes on for a while"), (2, None), (3, ""), (None, "one two"), (5, "ordinary sentence that goes on for a while")]
LABELS = [(1, 1, 0), (1, 1, 0), (6, 0, 0), (None, 1, 0), (9, None, None)]


@pytest.fixture(scope="module", params=["rows", "none"])
def docs(spark, request):
    return spark.createDataFrame(ROWS if request.param == "rows" else [], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(BENCHMARK, "item_id long, text string")


def test_line_dedup(docs):
    rows = line_dedup.without_repeats(docs, least_words=10).collect()
    assert len(rows) == docs.count()
    if rows:
        left = {(r.doc_id, r.text) for r in rows}
        assert (1, WORDS) in left and (2, "") in left and (3, None) in left and (5, " \n\t ") in left


def test_sharding(docs):
    rows = sharding.shard(docs, 4).collect()
    counts = [sum(r.shard == s for r in rows) for s in range(4)]
    assert sum(counts) == docs.count() and max(counts) - min(counts) <= 1
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_mixing(docs):
    rows = mixing.mixed_documents(docs).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    assert mixing.mixture(docs).columns == docs.columns
    mixing.mixture(docs).collect()


def test_ngram_join(docs):
    rows = ngram_join.linked_documents(docs).collect()
    assert len(rows) == docs.count()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    if rows:
        assert found[2][1] == 1 and found[10][1] == 1 and found[3] == (0, 3) and found[8] == (1, 8) and found[6][0] == 1
    kept = ngram_join.one_of_each_group(docs, 5, 80)
    assert kept.columns == docs.columns
    if rows:
        assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 4, 5, 6, 7, 8, 9, 11]


def test_language(docs):
    rows = language.identified_documents(docs).collect()
    assert len(rows) == docs.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert all(0 <= r.score <= 1 for r in rows)
    assert language.accepted_documents(docs).columns == docs.columns


def test_added_columns_leave_all_others_alone(spark, docs):
    """The names that the operators use inside are no names to them if the rows have them."""
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rows = sorted((r.asDict() for r in docs.collect()), key=str)
    for made, added in ((language.identify(docs, language.fit(docs)), {"lang_pred", "score", "rejected"}),
                        (quality.judge(docs, quality.fit(docs, labels)), {"kept"}),
                        (prefix_tokens.with_counts(docs, public_tokenizers.path("byte_bpe_50k.json")), {"n_tokens"})):
        assert added < set(made.columns)
        shared = [c for c in docs.columns if c not in added]
        got = sorted(({c: r[c] for c in shared} for r in made.collect()), key=str)
        assert got == sorted(({c: r[c] for c in shared} for r in rows), key=str)


def test_quality(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.judged_documents(docs, labels).collect()}
    if rows:
        assert rows[3].base_failed and not rows[3].kept and rows[6].n_repeat_words == 60_000 and rows[7].n_words == 1
    quality.judge(docs, quality.fit(docs, labels.limit(0))).collect()


def test_decontamination(docs, benchmark):
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert found == ({(1, 1), (2, 1), (None, 1), (10, 1), (8, None)} if docs.count() else set())
    assert decontaminate.clean_documents(docs, benchmark.limit(0)).count() == docs.count()
    assert decontaminate.clean_documents(docs, benchmark).columns == docs.columns


def test_token_counts(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in prefix_tokens.with_counts(docs, path).collect():
        text = r.text or ""
        assert r.n_tokens == len(library.encode(text, add_special_tokens=False).ids) and r.n_bytes == len(text.encode())


PAGES = [
    (1, "http://A.Example.org/en/12?x#y", "h", "z"), (1, "http://A.Example.org/en/12?x#y", "h", "z"), (2, None, None, None), (None, "no scheme", "", "z"),
    (3, "https://example.org", "h" * 200_000, "z"), (4, "x://com/de/", "H", "z"), (5, "://x.com?/fr/", "h", "z"), (6, "http://.org/", "", "z"),
    (7, "http://" + "a." * 3000 + "org/" + "p" * 5000, "WARC/1.1\r\n\r\n", "z"),
]


def test_urls(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, verdict string")
    rows = {r.page_id: r for r in url_filter.judged_pages(pages).collect()}
    assert (rows[1].host, rows[1].path, rows[1].rule, rows[1].verdict) == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert (rows[2].host, rows[2].path, rows[2].rule, rows[2].verdict) == ("", "", None, "allow")
    assert rows[3].rule is None and rows[4].verdict == "block" and rows[5].rule is None and rows[6].rule == "org/" and rows[7].rule == "org/"
    assert url_filter.judged_pages(pages.limit(0)).count() == 0
    more = pages.selectExpr("*", "1 AS url_key", "2 AS key", "3 AS labels", "4 AS rule", "5 AS row", "6 AS h")
    rules = spark.createDataFrame(list(url_filter.RULES), "host string, path string, verdict string")
    judged = url_filter.judge(more, rules)
    assert {(r.url_key, r.key, r.labels, r.row, r.h) for r in judged.collect()} == {(1, 2, 3, 5, 6)}
    assert sorted((r.url or "", r.verdict) for r in judged.collect()) == sorted((u or "", rows[i].verdict) for i, u, *_ in PAGES)


def test_warc(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, verdict string")
    rows = warc.archived_pages(pages).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in rows) == sorted(
        [(0, "revisit", 6), (1, "revisit", 5), (1, "revisit", 5), (2, "revisit", 6), (3, "response", 0), (4, "response", 0),
         (5, "response", 0), (6, "response", 0), (7, "response", 0)])
    assert all(r.payload_digest == warc.digest((h or "").encode()) for r in rows for i, _, h, _ in PAGES if i == r.page_id)
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, benchmark, tmp_path):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), stage(spark, now, str(tmp_path)).schema)
        assert [c for c in docs.columns if c not in now.columns] == [], name
