"""The operators' queries against SQL, brute force, round trips and held-out accuracy."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken

import __spark_entry__ as contract
import corpus_pipeline
from almanac.llm import byte_bpe, decontaminate, html_extract, jaccard_join, language_id, license_scan, quality, token_store, topk_search, url_filter
from tools.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, label string, n bigint, a string"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def source(name, *columns):
    return pq.read_table(f"{SF}/{name}.parquet", columns=list(columns) or None).to_pylist()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named like the operators' own."""
    long = "The long text of many words and no end, " * 20_000
    texts = [None, "", " \n\t", "one", "same text here for all of us", "same text here for all of us", long, "x" * 100_000, "12 34"]
    data = [(i, t, None, None, None, "mine", 7, "b") for i, t in enumerate(texts)] + [(None, "no id here", "en", None, None, None, None, None)]
    return spark.createDataFrame(data + [data[4]], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("key", ["op1_url_filter", "op2_decontaminate", "op3_topk_search"])
def test_sql(spark, key):
    assert compare(spark, connect(SF), SF, key).startswith("ok")


def test_url_rules_and_odd_urls(spark):
    urls = [None, "nothing", "http://a.org/fr/x", "https://A.B.EXAMPLE.NET/en/1?q", "http://net", "http://x.net/?a", "http://notexample.com/de/", "http://..net/"]
    df = spark.createDataFrame([(i, u, "kept", "old") for i, u in enumerate(urls)] + [(2, urls[2], "kept", "old")], "page_id int, url string, extra string, rule string")
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "block"), ("org", "/fr/", "allow"), (None, "/", "block")], "host string, path string, action string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict, r.extra) for r in url_filter.filter_urls(df, rules).orderBy("page_id").collect()]
    assert got == [
        (0, "", "", None, "allow", "kept"), (1, "", "", None, "allow", "kept"),
        (2, "a.org", "/fr/x", "org/fr/", "block", "kept"), (2, "a.org", "/fr/x", "org/fr/", "block", "kept"),
        (3, "a.b.example.net", "/en/1", "example.net/en/", "allow", "kept"), (4, "net", "", None, "allow", "kept"),
        (5, "x.net", "/", "net/", "block", "kept"), (6, "notexample.com", "/de/", None, "allow", "kept"), (7, "..net", "/", "net/", "block", "kept"),
    ]
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, rules.limit(0)).collect()} == {"allow"}


def test_leaks_have_the_same_spans_in_any_number_of_blocks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one, many = (rows(decontaminate.find_leaks(docs, bench, block_bytes=b).select("doc_id", "text", "leak")) for b in (1 << 22, 3000))
    assert one == many
    for r in one.values():
        w = words(r.text)
        for s in r.leak.spans:
            assert words(r.text[s.start : s.end]) == w[s.first_word : s.last_word + 1]


def test_leaks_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "ONE"), (None, "34"), (2, None), (2, "  "), (1, "one")], "item_id int, text string")
    got = rows(decontaminate.find_leaks(odd, bench))
    assert [(got[i].leak.n_words, got[i].leak["items"]) for i in (0, 3, 8)] == [(0, []), (1, ["1"]), (2, ["null"])]
    assert decontaminate.find_leaks(odd, bench.limit(0)).where("leak.n_hit > 0").count() == 0
    assert decontaminate.drop_leaks(none, bench).count() == 0


def test_search_with_ties_and_odd_vectors(spark):
    data = [(i, [float(i % 3), 1.0]) for i in range(0, 120)] + [(200, None), (201, [None, 1.0]), (202, [float("nan"), 1.0]), (203, [2.0]), (None, [1.0, 1.0]), (204, [])]
    df = spark.createDataFrame(data + [data[7]], "vec_id bigint, embedding array<float>")
    v = topk_search.quantised(df)
    flat = [(i, np.floor(256 * np.array(x + [0.0] * (2 - len(x)))).astype(int)) for i, x in data + [data[7]] if i is not None and x is not None and all(c is not None and c == c for c in x)]
    want = {}
    for q, x in flat:
        if q % 50 == 0:
            want[q] = sorted((-int(x @ y), i) for i, y in flat if i != q)[:4]
    for slices in (20_000, 7):
        got = {}
        for r in topk_search.search(v, v.where("id % 50 = 0"), k=4, pivots=5, groups=2, slice_rows=slices).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert got == want
    assert topk_search.search(v.limit(0), v).count() == 0 and topk_search.search(v, v.limit(0)).count() == 0


def test_license_places(spark, odd, none):
    got = rows(contract.queries()["op4_license_scan"](spark, SF))
    for d in source("documents", "doc_id", "text"):
        w, r = words(d["text"]), got[d["doc_id"]]
        at = [(i, label) for _, label, p in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    text = license_scan.TEMPLATES[0][2].split()
    changed = " ".join(text[:9] + ["really"] + text[9:16] + text[17:])
    df = odd.union(spark.createDataFrame([(50, changed, None, None, None, None, None, None), (51, " ".join(text[:8]), None, None, None, None, None, None)], DOCS))
    spans = rows(license_scan.scan(df))
    assert [s.template for s in spans[50].spans] == ["mit-grant"] and spans[51].spans is None
    assert license_scan.scan(df).count() == df.count() and license_scan.scan(none).count() == 0


def test_bpe_equals_tiktoken(spark, odd):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = byte_bpe.read_ranks(f.read())
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(contract.queries()["op5_byte_bpe"](spark, SF))
    for d in source("documents", "doc_id", "text"):
        ids = codec.encode_ordinary(d["text"] or "")
        want = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest()
        assert (got[d["doc_id"]].ids_sha256, got[d["doc_id"]].decoded_sha256) == want
    own = byte_bpe.Codec(ranks, public_tokenizers.PATTERN, kept=20)
    rng = np.random.default_rng(3)
    letters = list("ab 'st1\n\t\r\x0b\x0c\x1c\x1f\x85\xa0 ​ 　é漢😀²٣!%_́")
    for _ in range(2000):
        text = "".join(rng.choice(letters, rng.integers(0, 12)))
        assert own.encode(text) == codec.encode_ordinary(text) and own.decode(own.encode(text)).decode() == text
    assert all(own.whole.find(k) == v for k, v in itertools.islice(ranks.items(), 500)) and own.whole.find(b"not a token at all") == -1
    coded = odd.select("doc_id", byte_bpe.encode(odd.text, spark, path, public_tokenizers.PATTERN).alias("ids"))
    assert [len(rows(coded)[i].ids) for i in (0, 1)] == [0, 0]


def test_token_files(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, start = rows(contract.queries()["op6_token_store"](spark, SF)), 0
    for d in sorted(source("documents", "doc_id", "text"), key=lambda d: d["doc_id"]):
        ids = [*t.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        r = got[d["doc_id"]]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    path = str(tmp_path / "t")
    found = token_store.stored(odd, public_tokenizers.path("byte_bpe_50k.json"), path, shard_ids=50).collect()
    encoded = lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]
    assert sorted((str(r.doc_id), r.ids) for r in found) == sorted((str(r.doc_id), encoded(r.text)) for r in odd.collect())
    special = spark.createDataFrame([(1, "a<|endoftext|>b"), (2, "<|endoftext|>")], "doc_id long, text string")
    whole = token_store.stored(special, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "s")).collect()
    assert {r.doc_id: r.ids for r in whole} == {1: encoded("a<|endoftext|>b"), 2: encoded("<|endoftext|>")} and len(encoded("<|endoftext|>")) == 2
    for row in spark.read.parquet(path).collect():
        for n, key in enumerate(row.doc_ids):
            assert any(list(token_store.read_document(row.asDict(), n)) == r.ids for r in found if r.doc_id == key)
    assert token_store.stored(none, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "e")).count() == 0


def test_re_pair_is_lossless():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 3000):
        ids = rng.choice(np.array([1, 2, 3], np.uint32), n)
        ends = np.unique(np.append(rng.integers(0, n, 3), n))
        rules, lengths, symbols, at = token_store.compress(ids, ends, 1000, rules=3)
        assert list(token_store.expand(symbols, rules, lengths, 1000)) == list(ids) and at[-1] == len(symbols)
    ids = np.tile(np.arange(100, dtype=np.uint32), 5_000)
    rules, lengths, symbols, _ = token_store.compress(ids, np.array([len(ids)]), 1000)
    assert lengths.max() > 64 and len(rules) + len(symbols) < 1_000  # a long passage that repeats becomes few symbols
    assert list(token_store.expand(symbols, rules, lengths, 1000)) == list(ids)


def test_re_pair_sorts_only_pairs_that_may_be_frequent(monkeypatch):
    rng, sizes, unique = np.random.default_rng(3), [], np.unique
    ids = np.concatenate([rng.integers(0, 100_000, 50_000), np.tile([7, 8, 9], 100)]).astype(np.uint32)
    monkeypatch.setattr(np, "unique", lambda x, **kw: sizes.append(len(x)) or unique(x, **kw))
    rules, lengths, symbols, _ = token_store.compress(ids, np.array([len(ids)]), 1 << 17)
    assert sizes[0] < len(ids) / 10 and list(token_store.expand(symbols, rules, lengths, 1 << 17)) == list(ids)
    assert (7, 8) in map(tuple, rules.tolist()) or (8, 9) in map(tuple, rules.tolist())


def test_html(spark):
    page = '<html><head><title>t</title><style>x</style></head><body><nav><a>menu</a></nav><div class="top-banner">ad</div><article><h1>A &amp; b</h1><p>one<br>two <i>three</i><p>four&nbsp; five<script>var t="</p>"</script><section class="comments"><p>nice</p></section></article><footer>f</footer>'
    data = [(1, "http://a/1", page, "old"), (2, None, None, "old"), (3, "u", "", "old"), (4, "http://b/", "plain &lt; text < 3", "old")]
    data += [(10 + i, f"http://c/{i}", f"<body><div class=q>hint</div><div class=z><p>text {i}</p></div>", "old") for i in range(6)]
    df = spark.createDataFrame(data + data[:1], "page_id int, url string, html string, text string")
    got = rows(html_extract.extract_text(df), "page_id")
    assert [got[i].text for i in (1, 2, 3, 4)] == ["A & b\none two three\nfour five", "", "", "plain < text < 3"]
    assert [got[10 + i].text for i in range(6)] == [f"text {i}" for i in range(6)]  # the same text in one slot of all pages
    assert html_extract.extract_text(df.limit(0)).count() == 0


def test_html_classes_decide_inside_articles_too(spark):
    def page(i):
        return f'<body class="has-sidebar"><div class=x>Hint</div><article class="comment-open"><p>Told {i} and more of it here</p><p>Join us</p></article><div class=more><p>Outside {i}</p></div></body>'

    data = [(i, f"http://a/{i}", page(i)) for i in range(6)]
    # five copies of a page are one page: no template
    data += [(10 + i, f"http://b/{i}", "<body><div class=z><p>A whole text without article</p></div></body>") for i in range(5)]
    # near copies: most of the article is on all pages and stays
    data += [(20 + i, f"http://c/{i}", f"<article><p>A long passage that all of them have</p><p>number {i}</p></article>") for i in range(5)]
    # blocks in another order on another page: no valid class
    data += [(30 + i, f"http://d/{i}", f"<body><p>{('one', 'two')[i % 2]}</p><p>{('two', 'one')[i % 2]}</p><p>x {i}</p></body>") for i in range(6)]
    got = rows(html_extract.extract_text(spark.createDataFrame(data, "page_id int, url string, html string")), "page_id")
    assert [got[i].text for i in range(6)] == [f"Told {i} and more of it here\nOutside {i}" for i in range(6)]
    assert [got[10 + i].text for i in range(5)] == ["A whole text without article"] * 5
    assert [got[20 + i].text for i in range(5)] == [f"A long passage that all of them have\nnumber {i}" for i in range(5)]
    assert [got[30 + i].text for i in range(2)] == ["one\ntwo\nx 0", "two\none\nx 1"]


def test_html_copies_make_no_template_and_names_in_parts_keep_the_article(spark):
    whole = "<body><div class=z><p>A text without article</p></div></body>"
    data = [(i, f"http://b/{i}", whole) for i in range(7)]  # one page, however often it stands on the host
    data += [(10, "http://e/", '<body class="has-sidebar no-comments"><div class="with-menu"><article class="comment-open"><p>Told</p></article></div></body>')]
    data += [(11, "http://f/", '<body class="has-sidebar"><div class="top-banner">ad</div><p>Told</p></body>')]
    got = rows(html_extract.extract_text(spark.createDataFrame(data, "page_id int, url string, html string")), "page_id")
    assert [got[i].text for i in range(7)] == ["A text without article"] * 7 and [got[i].text for i in (10, 11)] == ["Told", "Told"]


def brute_components(docs):
    sets = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_joined_documents(spark):
    want = brute_components([(d["doc_id"], d["text"]) for d in source("documents", "doc_id", "text")])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in contract.queries()["op8_jaccard_join"](spark, SF).collect()}
    assert got == want


def test_small_sets_and_chains(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(40)]
    docs = []
    for i in range(120):
        n = int(rng.integers(0, 40))
        w = base[:n]
        for k in rng.integers(0, max(1, n), int(rng.integers(0, 2))) if n else []:
            w = w[: int(k)] + ["new"] + w[int(k) + 1 :]
        docs.append((i, " ".join(w)))
    found = jaccard_join.classes(spark.createDataFrame(docs, "doc_id int, text string"))
    assert {r.id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(docs)


def test_bounds_of_links():
    for n in range(1, 80):
        for m in range(jaccard_join.least_partner(n), n + 1):
            o = jaccard_join.required(n, m)
            if m >= o:
                assert 100 * o >= 75 * (n + m - o) and 100 * (o - 1) < 75 * (n + m - o + 1)
                shared = jaccard_join.least_shared(m)
                assert jaccard_join.prefix_length(n) >= n - o + shared and jaccard_join.prefix_length(m) >= m - o + shared
                assert jaccard_join.required(m, m) in jaccard_join.subset_sizes(n) and jaccard_join.required(m, m) <= o


def test_lists_make_one_row_for_a_pair_that_may_link(spark):
    base = np.arange(400)
    docs = [(i, " ".join(map(str, np.concatenate([base[: 300 if i < 60 else 400], i * 1_000 + 1_000 + np.arange(200 if i < 60 else 4)])))) for i in range(64)]
    df = spark.createDataFrame(docs, "id int, text string")
    sets = jaccard_join.Shingler()([text for _, text in docs])
    entries = [(int(k), i, len(s), i) for i, s in enumerate(sets) for k in s.view(np.int64)]
    lists = spark.createDataFrame(entries, "key long, a long, n long, label long")
    merged = jaccard_join._merged(lists).cache()
    assert merged.count() < 64 * 5 and merged.groupBy("a").agg({"w": "sum"}).first()[1] >= 296  # 396 lists in common, but few kinds
    shingles = spark.createDataFrame([(i, len(s), jaccard_join.sketch(s).tolist()) for i, s in enumerate(sets)], "a long, n long, s array<long>")
    met = jaccard_join._met(merged.withColumn("label", merged.a), shingles, 75)
    assert sorted((r.u, r.v) for r in met.collect()) == list(itertools.combinations(range(60, 64), 2))  # not those of 300 shared words
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(df, id_col="id").collect()}
    assert got == brute_components(docs)


def test_some_steps_give_labels_of_the_same_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    some = jaccard_join.components(edges, steps=1).collect()
    assert len({r.node for r in some}) == len(some) and all(r.label < r.node and (r.label < 100) == (r.node < 100) for r in some)


def test_join_of_odd_rows(spark, odd, none):
    got = jaccard_join.classes(odd).collect()
    assert sorted((r.id, r.component_id) for r in got if r.id in (0, 1, 4, 5)) == [(0, 0), (1, 1), (4, 4), (4, 4), (5, 4)]
    assert [r.component_id for r in got if r.id is None] == [None]
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 1, 2, 3, 4, 6, 7, 8]
    assert jaccard_join.classes(none).count() == 0 and jaccard_join.keep_one(none).count() == 0


def test_join_of_near_copies_without_ids(spark):
    def text(start, swapped=()):
        return " ".join("new" if i in swapped else f"w{start + i}" for i in range(60))

    docs = [(None, text(0)), (None, text(0, [1])), (None, text(0, [1])), (None, text(1000))]  # near copies, none with an id
    docs += [(7, text(2000)), (None, text(2000, [20])), (5, text(2000, [20, 40]))]  # 5 and 7 link only with the row between them
    docs += [(None, f"{w} b c d e f g h i") for w in ("a", "a", "z")]  # small sets
    df = spark.createDataFrame(docs, "doc_id int, text string")
    want = brute_components(enumerate(t for _, t in docs))
    groups = {}
    for n, (i, t) in enumerate(docs):
        groups.setdefault(want[n][1], set()).add((i, t))
    assert max(map(len, groups.values())) == 3
    found = jaccard_join.classes(df).collect()
    texts = {}
    for r, (i, t) in zip(sorted(found, key=lambda r: (r.set_id, r.id or 0)), sorted(docs, key=lambda d: (jaccard_join._digest(jaccard_join.Shingler()([d[1]])[0])[0], d[0] or 0)), strict=True):
        texts.setdefault(r.label, set()).add((i, t))
    assert sorted(map(sorted, ([str(x) for x in g] for g in texts.values()))) == sorted(map(sorted, ([str(x) for x in g] for g in groups.values())))
    assert {r.component_id for r in found if r.id} == {5}
    assert jaccard_join.keep_one(df).count() == len(groups)


def test_one_id_with_two_texts_keeps_both_components(spark):
    docs = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "only here and in no other row at all"), (3, "h i j k l m"), (4, "h i j k l m"), (4, None)]
    kept = jaccard_join.keep_one(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(1, docs[0][1]), (2, docs[2][1]), (3, docs[3][1]), (4, "")]


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where("doc_id % 3 > 0"))
    test = quality.score(docs.where("doc_id % 3 = 0"), model).join(quality.grades(labels), "doc_id").select("grade", quality.selected().alias("keep")).toPandas()
    assert test[test.grade == 2].keep.mean() > 0.97 and test[test.grade == 1].keep.mean() < 0.5


def test_toxic_rows_are_sampled_and_removed(spark):
    assert quality.quotas({0: 400, 1: 9_000, 2: 90_000}, 12_000) == {0: 400, 1: 5_800, 2: 5_800}
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where("doc_id % 3 > 0"))
    test = quality.score(docs.where("doc_id % 3 = 0"), model).join(quality.grades(labels), "doc_id").select("grade", quality.selected(model.cut).alias("keep")).toPandas()
    kept = [test[test.grade == g].keep.mean() for g in range(3)]
    assert kept[2] > 0.97 and kept[1] < 0.05 and kept[0] < 0.22, kept


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 0), (8, 0, 0), (8, 1, 1), (4, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert rows(quality.grades(labels)) == {3: (3, 2), 8: (8, 0)}
    got = quality.score(odd, quality.train(odd, labels)).collect()
    assert len(got) == odd.count() and all(r.quality.expected_grade == 0 for r in got if r.doc_id in (0, 1, 2))
    assert quality.train(odd, labels.limit(0)) is None and quality.score(none, None).count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_gradients():
    net = language_id.Network(["a", "b"], hidden=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    block, n = language_id._padded([b"abc", b"z", b"hello"])
    target = np.array([0, 1, 1])

    def loss():
        p = net.probabilities(block, n)
        live = np.arange(block.shape[1])[:, None] < n
        return -(np.log(p[:, np.arange(3), target]) * live).sum() / live.sum()

    g = net.gradients(block, n, target)
    for name, at in (("xf", (97, 1)), ("xb", (108, 7)), ("hf", (1, 5)), ("hb", (2, 8)), ("cf", (4,)), ("o", (3, 1)), ("p", (0,))):
        old, e = net.w[name][at], 1e-3
        net.w[name][at] = old + e
        up = loss()
        net.w[name][at] = old - e
        down = loss()
        net.w[name][at] = old
        assert abs((up - down) / 2 / e - g[name][at]) < 1e-3


def test_languages(spark, odd, none):
    got = contract.queries()["op10_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    lang = {d["doc_id"]: d["lang"] for d in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    held = got[got.held_out]
    assert list(got.held_out) == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]
    assert np.mean([lang[i] == p for i, p in zip(held.doc_id, held.lang_pred)]) > 0.98
    found = {r.doc_id: r for r in language_id.identify(odd).collect()}
    assert [found[i].lang_pred for i in (0, 1, 2, 8)] == ["und"] * 4 and len(found) == 10
    assert language_id.identify(none).count() == 0 and language_id.keep_languages(odd).columns == odd.columns


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.schema == docs.schema and after.join(docs, "doc_id", "left_anti").count() == 0
        docs = after
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == kept
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert all(i == c for i, (n, c) in brute_components(texts).items() if n)
