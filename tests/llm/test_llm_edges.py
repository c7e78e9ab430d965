"""Nulls, empty and long texts, ties and repeated rows, empty tables, clashing columns."""
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sieve.llm import binpack, bpe, components, imatch, langid, packing, passages, pii, simhash, urlfilter, vecdedup

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["fp", "component", "component_id", "node", "a", "b", "cls", "length", "piece", "sequence_id", "_bucket", "spans", "_spans", "_row", "_judged", "rejected", "score",
         "signatures", "_terms", "ids", "words", "key", "first", "rule", "host", "verdict", "vector", "many", "held_out", "lang_pred", "_key", "_range", "_next", "_doc"]

LONG = "der lange text und nicht kurz " * 30_000
ROWS = [(1, "plain words of a text", "en", "s", 21), (1, "plain words of a text", "en", "s", 21), (2, None, None, None, None), (3, "", "en", None, 0), (None, "no id here", "en", "s", 10),
        (None, None, None, None, None), (4, LONG, "de", "s", len(LONG)), (5, "  \n ", None, "s", 4), (6, "plain words of a text", "en", "s", 21), (7, "1234 !!", "de", "s", 7), (8, "ein text mail a@b.de", "de", "s", 20)]

DOCS = {
    "packing": lambda d: packing.pack_documents(d, WORD_BPE),
    "pii": lambda d: pii.digests(pii.find(d)),
    "redact": pii.redact,
    "simhash": lambda d: simhash.digests(simhash.dedup(d)),
    "keep_first": simhash.keep_first,
    "imatch": lambda d: imatch.digests(imatch.compare(d)),
    "langid": langid.identify,
    "keep_known": langid.keep_known,
    "bpe": lambda d: bpe.encode(d, BYTE_BPE, public_tokenizers.PATTERN),
    "matrices": lambda d: binpack.digests(binpack.pack_matrices(d, WORD_BPE)),
    "passages": passages.find,
    "remove": passages.remove,
}


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, COLUMNS)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.mark.parametrize("name", sorted(DOCS))
def test_odd_documents(spark, odd, name):
    out = DOCS[name](odd)
    rows = out.collect()
    ids = sorted((r.doc_id for r in rows if "doc_id" in out.columns), key=lambda x: (x is None, x))
    every = [1, 1, 2, 3, 4, 5, 6, 7, 8, None, None]
    by = {r.doc_id: r for r in rows} if "doc_id" in out.columns else {}
    if name in ("pii", "simhash", "imatch", "langid", "bpe", "redact"):
        assert ids == every
    if name == "packing":
        assert {r.doc_id for r in rows if r.length == 1} == {2, 3, 5, None} and len([r for r in rows if r.doc_id == 4]) > 10
    if name == "simhash":
        assert by[2].fingerprint == "0" * 16 and by[2].component_id == by[3].component_id == by[5].component_id == 2 and by[6].component_id == 1
    if name == "keep_first":
        assert sorted(out.columns) == sorted(odd.columns) and ids == [1, 2, 4, 7, 8, None]
    if name == "imatch":
        assert by[2].n_chars == 0 and by[1].fingerprint == by[6].fingerprint
    if name == "langid":
        assert {r.doc_id for r in rows if r.lang_pred == "und"} >= {2, 3, 5, 7} and by[4].lang_pred == "de"
    if name == "keep_known":
        assert sorted(out.columns) == sorted(odd.columns) and not {2, 3, 5, 7} & set(ids)
    if name == "redact":
        assert by[8].text == "ein text mail [EMAIL]" and by[8].n_chars == 21 and by[2].text is None and sorted(out.columns) == sorted(odd.columns)
    if name == "remove":
        assert ids == every and sorted(out.columns) == sorted(odd.columns)
    if name == "passages":
        assert rows == []


@pytest.mark.parametrize("name", sorted(DOCS))
def test_no_documents(spark, name):
    assert DOCS[name](spark.createDataFrame([], COLUMNS)).collect() == []


def test_single_document_is_its_own_next(spark):
    r = imatch.compare(spark.createDataFrame([(5, "abcdef", "en", "s", 6)], COLUMNS)).first()
    assert r.near_next == 1.0 and r.n_chars == 6


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in CLASH})
    got = {r.vec_id: (r.n_links, r.component_id) for r in vecdedup.dedup(df).collect()}
    assert got[1] == (2, 1) and got[8] == (2, 1) and all(got[i] == (0, i) for i in (2, 3, 4, 5, 6, 7, 9)) and got[None] == (0, None)
    assert vecdedup.dedup(df.limit(0)).collect() == []


PAGES = "page_id long, url string, html string"


def test_url_rules_and_aliases(spark):
    canon = '<html><LINK href="{}" rel=canonical></html>'
    rows = [(1, "https://A.example.com/en/x?q#f", None), (2, "http://www.example.com/en/y", ""), (3, "http://foo.net/es/1", canon.format("http://mirror.org/one")),
            (4, "https://mirror.org/one#top", None), (5, None, None), (6, "nonsense", "x"), (7, "http://a.org", '<meta http-equiv="refresh" content="0; url=/two">'), (8, "http://a.org/two", None),
            (9, "http://b.org/z?utm_source=q", canon.format("//foo.net/fr/9")), (10, "http://c.org/z", canon.format("http://b.org/z")), (11, "http://c.org/z", canon.format("http://ok.com/")),
            (12, "http://net", None), (13, "http://d.org/p/q", canon.format("r")), (14, "http://d.org/p/r", None)]
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit(1) for c in CLASH if c not in ("host",)})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df).collect()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[2] == ("www.example.com", "/en/y", "www.example.com/en/", "allow")
    assert got[3][3] == "block" and got[4] == ("mirror.org", "/one", None, "block") and got[5] == got[6] == ("", "", None, "allow")
    # c.org/z is the alias of an explicitly allowed page and of a blocked one: allow goes first
    assert got[9][3] == got[10][3] == got[11][3] == "allow" and got[8][2:] == (None, "allow") and got[12] == ("net", "", None, "allow")
    assert urlfilter.judge(df.limit(0)).collect() == []
    extra = spark.createDataFrame([("http://a.org/two", "http://x.net/es/")], "url string, target string")
    assert {r.page_id for r in urlfilter.judge(df, extra).collect() if r.verdict == "block"} >= {7, 8}


def test_two_texts_under_one_doc_id(spark):
    """Neither dedup nor passage removal mixes up texts that share a doc_id."""
    passage = " ".join(f"common{i}" for i in range(60))
    rows = [(1, "text a with words of its own", "en", "s", 1), (1, "quite another thing is said here", "en", "s", 1), (2, "text a with words of its own", "en", "s", 1),
            (3, f"{passage} end", "en", "s", 1), (4, f"begin {passage} stop", "en", "s", 1), (4, "short text here", "en", "s", 1), (4, "ab cd", "en", "s", 1), (3, "a third one", "en", "s", 1),
            (None, "text a with words of its own", "en", "s", 1), (None, "nobody owns this text", "en", "s", 1), (None, "nobody owns this text", "en", "t", 1)]
    docs = spark.createDataFrame(rows, COLUMNS)
    kept = sorted((str(r.doc_id), r.text) for r in simhash.keep_first(docs).collect())
    assert kept == sorted({(str(r[0]), r[1]) for r in rows} - {("2", rows[0][1]), ("None", rows[0][1])})
    left = [(r.doc_id, r.text) for r in passages.remove(docs).collect()]
    assert len(left) == len(rows) and sum("common5 " in t for _, t in left) == 1
    assert {(4, "short text here"), (4, "ab cd"), (3, "a third one"), (1, rows[1][1])} <= set(left)


def test_components_of_chains_stars_and_cycles(spark):
    import random

    rnd = random.Random(2)
    chain = [(i, i + 1) for i in range(300)]
    star = [(5000, 1000 + i) for i in range(300)]
    ring = [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(2000, 2000), (None, 2001)]
    links = chain + star + ring + [(9000, 9001), (9001, 9000)]
    rnd.shuffle(links)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(300)) and got[5000] == 1000
    assert all(got[2000 + i] == 2000 for i in range(50)) and got[9001] == 9000 and None not in got


def test_pipeline_stages_compose(spark, tmp_path):
    passage = " ".join(f"alpha{i} beta" for i in range(40))
    rows = [(i, f"the house number {i} and the river of place {i * 7} " + " ".join(f"word{i}x{j}" for j in range(60)), "en", "s", 0) for i in range(30)]
    rows += [(100, rows[0][1], "en", "s", 0), (101, f"{passage} first of them", "en", "s", 0), (102, f"another start {passage} and mail me@x.org", "en", "s", 0), (103, None, None, "s", 0)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append({r.doc_id for r in docs.collect()})
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept[0] == {r[0] for r in rows} - {103} and kept[1] == kept[0] - {100} and kept[2] == kept[1] == kept[3] == kept[4]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    assert sum("alpha5 beta" in t for t in texts.values()) == 1 and "[EMAIL]" in texts[102] and all(texts[r[0]] == r[1] for r in rows[:30])
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert run.count() == docs.count() and {r.doc_id for r in run.collect()} == kept[4]
