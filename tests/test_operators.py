"""Operators on hand-made tables, against brute force where SQL cannot say it."""

import datetime as dt
import io
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from almanac.functions import wordlists as W
from almanac.functions.fuzzy import partial_ratio
from almanac.operators import answers, job, runlog, spelling
from almanac.operators import documents as D, ordering as O, quality as Q, questions as QU, registry as G, reshape as R
from almanac.operators import vectors as V, warehouse as WH
from almanac.operators.grid import header_promote
from almanac.session import shared_dir
from almanac.sources import fact_store, landing, reading, silver_store
from almanac.sources.workbook import cells_of, read_workbook_grid, scan_workbooks


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- order, rank, keys ---------------------------------------------------------------------


def test_rank_of_a_hot_group_with_ties_and_nulls(spark):
    rng = random.Random(3)
    data = [("hot", rng.choice([1.0, 1.0, 2.0, 1e300, rng.random(), None])) for _ in range(3000)]
    data += [("cold", 5.0), (None, 7.0), (None, 8.0)]
    df = spark.createDataFrame(data, "k string, v double")
    got = rows(O.rank_values(df, ["k"], "v", "r").where("k = 'hot'").select(F.coalesce("v", F.lit(-1.0)).alias("v"), "r"), "v", "r")
    values = sorted((-1.0 if v is None else v for k, v in data if k == "hot"), reverse=True)
    want = sorted((v, 1 + values.index(v)) for v in values)
    assert got == want
    assert rows(O.rank_values(df, ["k"], "v", "r").where("k IS NULL"), "v", "r") == [(7.0, 2), (8.0, 1)]


def test_row_numbers_of_a_hot_group(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("k"), (-F.col("id")).alias("o"))
    got = rows(O.number_rows(df, ["k"], [F.col("o")], "n"), "k", "o", "n")
    for k in "ab":
        mine = sorted((r for r in got if r[0] == k), key=lambda r: r[1])
        assert [r[2] for r in mine] == list(range(1, len(mine) + 1))


def test_top_ranks_keep_all_ties(spark):
    data = [("a", v) for v in [5.0] * 40 + [4.0] * 3 + [3.0]] + [("b", 1.0), ("b", None)]
    df = spark.createDataFrame(data, "k string, v double")
    for n in (2, 41, 2000):
        want = O.rank_values(df, ["k"], "v", "r").where(f"r <= {n}")
        got = O.rank_top(df, ["k"], "v", n, "r")
        assert rows(got.fillna(-1.0), "k", "v", "r") == rows(want.fillna(-1.0), "k", "v", "r")


def test_keys_are_dense_and_the_same_on_both_paths(spark):
    df = spark.range(500).select(F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("a"), F.col("id").cast("string").alias("b"))
    small = rows(O.assign_keys(df, ["a", "b"], "k", 10, n_rows=500), "a", "b", "k")
    large = rows(O.assign_keys(df, ["a", "b"], "k", 10), "a", "b", "k")
    assert small == large and sorted(r[2] for r in small) == list(range(11, 511))


def test_new_indicators_continue_the_keys(spark):
    old = spark.createDataFrame([(4, "s", "A", "a")], "indicator_sk int, source_system string, indicator_code string, indicator_name string")
    silver = spark.createDataFrame([("s", "A", "a"), ("s", "B", "z"), ("s", "B", "b")], "source_code string, indicator_code string, indicator_name string")
    assert rows(WH.new_indicators(silver, old), "indicator_sk", "indicator_code", "indicator_name") == [(5, "B", "b")]


def test_loading_twice_changes_nothing(spark):
    new = spark.createDataFrame([(1, 1, 1, 1, 2, 9.0), (1, 1, 1, 1, 1, 8.0), (1, 1, 1, 2, 1, 7.0)], "report_id int, location_sk int, indicator_sk int, date_id int, ord int, value double")
    none = new.limit(0)
    once = WH.insert_ignore(none, new, WH.FACT_KEY, ["ord"])
    assert rows(once, "date_id", "value") == [(1, 8.0), (2, 7.0)]
    assert WH.insert_ignore(once, new, WH.FACT_KEY, ["ord"]).count() == 0


# --- layouts ----------------------------------------------------------------------------------


def test_nested_json_edges(spark):
    doc = """{"indicators": {"X": {"label": null}, "Y": {"label": "why"}},
      "values": {"X": {"PRT": {"2000": 1, "2001": null}, "ADVEC": {"2000": 2}, "ESP": null}, "Y": null, "Z": {"DEU": {"1999": 3.5}}}}"""
    df = spark.createDataFrame([(1, doc), (2, "no json")], "file_id int, content string")
    got = R.reshape_nested_json(df)
    assert rows(got.fillna(-1.0, ["value"]), "location_code", "indicator_code", "year", "value") == [
        ("DEU", "Z", 1999, 3.5), ("PRT", "X", 2000, 1.0), ("PRT", "X", 2001, -1.0),
    ]
    assert Q.clean_long(R.conform(got)).count() == 2


def test_wide_layout_skips_meta_columns(spark):
    df = spark.createDataFrame(
        [(1, "2020.0", "PRT", "p", "e", "1.5", "x", "1", "2", "3"), (1, None, "ESP", "s", "e", "1", "1", "1", "2", "3")],
        ["file_id", "Unnamed: 0", "Unnamed: 1", "Unnamed: 2", "Unnamed: 3", " score ", "b", "A RANK", "data.1", "Rank"],
    )
    assert rows(R.reshape_wide_unnamed(df), "location_code", "indicator_code", "year", "value") == [("PRT", "score", 2020, 1.5)]
    with pytest.raises(ValueError):
        R.reshape_wide_unnamed(df.drop("Unnamed: 0", "Unnamed: 2", "Unnamed: 3"))


def grid(spark, table, file_id=1):
    cells = [(file_id, "S", r, c, str(x)) for r, line in enumerate(table) for c, x in enumerate(line) if x is not None]
    return spark.createDataFrame(cells, "file_id int, sheet string, r int, c int, text string")


def test_country_names_need_no_exact_spelling(spark):
    table = [["COMPONENT SCORES"], ["Country", "Region", "Law"], ["  PORTUGAL ", "E", 1], ["Côte d'Ivoire", "A", 2], ["Nowhere", "X", 3]]
    names = spark.createDataFrame([("Portugal", "PRT"), ("Cote d'Ivoire", "CIV")], "name string, location_code string")
    assert rows(R.reshape_country_names(grid(spark, table), names), "location_code", "year", "value") == [("CIV", 2026, 2.0), ("PRT", 2026, 1.0)]


def test_header_promotion(spark):
    got = header_promote(grid(spark, [["note"], ["a", "b"], [1, 2], [None, 3]]), 1)
    assert rows(got, "r", "title", "text") == [(2, "a", "1"), (2, "b", "2"), (3, "b", "3")]


def test_melt_needs_its_columns(spark):
    df = spark.createDataFrame([(1, "PRT", 2.0)], ["file_id", "ISO", "air.x.RAW.2001"])
    assert rows(R.reshape_regex_melt(df), "location_code", "indicator_code", "year", "value") == [("PRT", "AIR", 2001, 2.0)]
    with pytest.raises(ValueError):
        R.reshape_regex_melt(df.drop("ISO"))


def test_reshape_then_clean_is_idempotent(spark):
    rows_ = [(1, "PRT", "x", None, 2000, 1.0), (1, "PRT", "x", None, 2000, 1.0), (1, "PRT", "x", "x", 2000, 1.0), (1, None, "x", "x", 2000, 1.0)]
    df = spark.createDataFrame(rows_, "file_id int, location_code string, indicator_code string, indicator_name string, year int, value double")
    once = Q.clean_long(df)
    assert once.count() == 2  # the copies differ in the name until it is filled
    assert Q.clean_long(Q.clean_long(once)).count() == 1


def test_missing_columns_fail_before_any_job(spark):
    with pytest.raises(ValueError, match="indicator_name"):
        Q.require_columns(spark.createDataFrame([(1,)], "location_code int"))


def test_registry_takes_new_extractors():
    R.register_extractor("mine", lambda df: df)
    assert "mine" in R.extractor_names() and R.extractor("imf") is R.reshape_nested_json
    with pytest.raises(ValueError):
        R.register_extractor("_hidden", lambda df: df)


# --- gates ---------------------------------------------------------------------------------------


def test_gate_limit_of_iso_codes(spark):
    data = [(f, i, "PRT" if i < good else "xx") for f, good in ((1, 24), (2, 23)) for i in range(30)]
    df = spark.createDataFrame(data, "file_id int, ord int, location_code string").select(
        "*", F.lit("a").alias("indicator_code"), F.lit("a").alias("indicator_name"), F.lit("2000").alias("year"), F.lit("1").alias("value")
    )
    assert rows(Q.dq_gate(df, ["ord"]), "file_id", "ok") == [(1, True), (2, False)]
    assert rows(Q.extractor_contract(df, ["ord"]), "file_id", "valid") == [(1, True), (2, True)]


# --- sources -------------------------------------------------------------------------------------


def test_formats(spark):
    cases = [
        ("x.CSV?a=1", b"", "csv"), ("", b"PK\x03\x04..", "zip"), ("", b"\xd0\xcf\x11\xe0", "excel"),
        ("", b"  {", "json"), ("", b"\n<a>", "xml"), ("", b"a;b\n1;2\n", "csv"), ("", b"plain words", "unknown"),
        ("", b"\xff\xfe", "unknown"), ("", b"a" * 511 + "é".encode(), "unknown"), ("", b"[" + b"a" * 510 + "é".encode(), "json"),
        ("", b"one two\nthree\n", "unknown"),
    ]
    df = spark.createDataFrame([(i, u, c) for i, (u, c, _) in enumerate(cases)], "i int, url string, content binary")
    got = [r["format"] for r in landing.sniff_format(df).orderBy("i").collect()]
    assert got == [w for *_, w in cases]
    quick = [r[0] for r in df.orderBy("i").select(landing.quick_format(F.col("content"))).collect()]
    assert quick[1:5] == ["excel", "excel", "json", "xml"] and quick[6] == "csv"


def test_pdf_heads(spark):
    heads = [b"%PDF-1.4", b" " * 1020 + b"%PDF", b" " * 1021 + b"%PDF", b"<html>"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, content binary")
    assert [r[0] for r in landing.pdf_magic_filter(df).orderBy("i").select("is_pdf").collect()] == [True, True, False, False]
    assert [r[0] for r in landing.pdf_magic_filter(df, window=4).orderBy("i").select("is_pdf").collect()] == [True, False, False, False]


def workbook():
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="A" r:id="r1"/><sheet name="Dataset" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><x Id="r1" Target="worksheets/a.xml"/><x Id="r2" Target="/xl/worksheets/b.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r></si></sst>")
        z.writestr("xl/worksheets/a.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>1</v></c><c r="AB3"><v>2.5</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/b.xml", f'<worksheet {main}><sheetData><row><c r="B2" t="s"><v>0</v></c><c r="C2"/></row></sheetData></worksheet>')
    return out.getvalue()


def test_workbooks(spark):
    assert list(cells_of(workbook())) == [("A", 0, 0, "two"), ("A", 2, 27, "2.5")]
    df = spark.createDataFrame([(7, workbook())], "file_id int, content binary")
    assert rows(read_workbook_grid(df, "Dataset"), "file_id", "sheet", "r", "c", "text") == [(7, "Dataset", 1, 1, "one")]
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("x.csv", "a")
    assert list(cells_of(plain.getvalue())) == []


def test_silver_keeps_other_files_and_prunes(spark):
    df = spark.createDataFrame([(1, "PRT", "a", "a", 2000, 1.0), (2, "ESP", "a", "a", 2000, 2.0)], "file_id int, location_code string, indicator_code string, indicator_name string, year int, value double")
    path = shared_dir(spark, "silver-test")
    silver_store.write_silver(df, path)
    silver_store.write_silver(df.where("file_id = 2").withColumn("value", F.lit(9.0)), path)
    assert rows(silver_store.scan_silver(spark, path), "file_id", "value") == [(1, 1.0), (2, 9.0)]
    plan = silver_store.scan_silver(spark, path, [2])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    import pathlib

    folders = {f.parent.name for f in pathlib.Path(path).rglob("*.parquet") if "rows" in f.parts}
    assert all(f.startswith("bucket=") for f in folders)  # files share folders
    assert rows(silver_store.scan_silver(spark, path, [2, 77]), "file_id", "value") == [(2, 9.0)]


# --- documents and vectors ---------------------------------------------------------------------------


def test_page_order_and_blank_parts(spark):
    parts = [("s", 0, 1, "table", None, [["a", None], ["b ", "c"]]), ("s", 0, 2, "text", " body ", None), ("s", 1, 0, "text", " ", None)]
    df = spark.createDataFrame(parts, "source string, page int, ord int, kind string, text string, cells array<array<string>>")
    assert rows(D.page_assemble(df), "page", "text") == [(0, "body\n\n[TABELA]\na | \nb | c")]


def test_both_exact_paths_and_the_lists(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(400, 8))
    corpus = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    queries = corpus.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    want = sorted((q, p + 1, int(v)) for q in range(0, 400, 40) for p, v in enumerate(np.argsort(1 - unit @ unit[q], kind="stable")[:5]))
    scanned = V.vector_topk(queries, corpus)
    assert rows(scanned, "query_id", "position", "vec_id") == want
    assert rows(V.vector_topk(queries, corpus, broadcast_numbers=0), "query_id", "position", "vec_id") == want
    listed = V.vector_topk_ivf(queries, corpus, lists=10, probes=4)
    share = V.recall(listed, scanned).first()["recall"]
    assert 0.6 <= share <= 1.0
    index = V.build_index(corpus, lists=10)
    everything = V.vector_topk_ivf(queries, corpus, probes=10, exact=True, index=index)
    assert rows(everything, "query_id", "position", "vec_id") == want
    assert V.recall(V.vector_topk_ivf(queries, corpus, index=index), scanned).first()["recall"] >= 0.9


def test_an_index_of_few_and_odd_vectors(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, [1.0, 1.0, 0.0])], "vec_id long, embedding array<float>")
    queries = corpus.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), "embedding")
    found = rows(V.vector_topk_ivf(queries, corpus.where("vec_id <> 3"), lists=2, probes=1), "query_id", "position", "vec_id")
    assert found == [(1, 1, 1), (1, 2, 4), (1, 3, 2), (2, 1, 2), (2, 2, 4), (2, 3, 1)]  # further lists until five, or all, are found
    assert {r["vec_id"] for r in V.build_index(corpus).rows.collect()} == {1, 2, 3, 4}
    assert V.vector_topk_ivf(queries, corpus.limit(0)).collect() == []


# --- questions -----------------------------------------------------------------------------------------


def classify(question):
    """The rules as plain regular expressions."""
    hit = re.search(W.CONTEXT_PREFIX, question)
    new = question[hit.end() :] if hit else question
    low = new.lower()
    years = re.findall(W.YEAR, new)
    for p, what in W.META_SIGNALS:
        if re.search(p, low):
            return f"meta:{what}"
    if any(re.search(p, low) for p in W.COMPARISON_SIGNALS):
        return "comparison"
    if any(re.search(p, low) for p in W.EXISTENCE_SIGNALS):
        return "existence" if len(years) == 1 else "existence_inferred"
    if any(re.search(p, low) for p in W.COMPLEX_SIGNALS) or re.search(W.YEAR + ".*" + W.YEAR, new):
        return "complex"
    return {0: "simple_inferred", 1: "simple"}.get(len(years), "uncertain")


def test_router_equals_the_rules_in_every_script(spark):
    texts = [
        "Qual a média de água em Portugal?", "Portugal é maior que Espanha?", "últimos 5 anos", "água e ética",
        "ou acima de tudo", "ou talvez", "há dados de 2001?", "contém 2001 e 2002", "Dados\n2001\nou\n2002", "quais países",
        'Contexto anterior: "quantos países". E em 2005?', 'antes\nContexto anterior: "x". "y".  Valor 1999', "evolução histórica",
        "é menor", "ação1999", "1999", "",
    ]
    turns = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("text").collect()]
    texts += turns
    df = spark.createDataFrame(list(enumerate(texts)), "q_id int, question string")
    got = [r["tier"] for r in QU.q_classify(df).orderBy("q_id").collect()]
    assert got == [classify(t) for t in texts]


def test_alias_paths_agree_and_the_longest_wins(spark):
    df = spark.createDataFrame([(1, "Guiné e Niger, depois Nigéria ou nigeria"), (2, "nada"), (3, "África do Sul")], "q_id int, question string")
    aliases = QU.country_aliases(spark)
    one = QU.alias_hits(df, "q_id", "question", aliases)
    two = QU.alias_hits(df, "q_id", "question", aliases, small=0)
    columns = ["q_id", "alias", "name", "place", "pos"]
    assert rows(one, *columns) == rows(two, *columns)
    assert rows(QU.q_country_first(one), "q_id", "country") == [(1, "Nigeria"), (3, "South Africa")]
    assert rows(QU.q_countries(one).where("q_id = 1"), "q_id", "countries") == [(1, ["Nigeria"])]


def test_indicator_match_paths_agree(spark):
    names = spark.createDataFrame([("rule of law", "A"), ("press freedom", "B"), ("press fredom", "C")], "name string, place string")
    texts = spark.createDataFrame([("what about the rul of law",), ("press freedom in 2001",), ("zzz",)], "text string")
    one = rows(QU.fuzzy_indicator_join(texts, names), "text", "name")
    two = rows(QU.fuzzy_indicator_join(texts, names, small=1), "text", "name")
    assert one == two == [("press freedom in 2001", "press freedom"), ("what about the rul of law", "rule of law")]


@pytest.mark.parametrize("threshold", [72.0, 45.0, 100.0])
def test_indicator_match_equals_all_pairs(spark, threshold):
    """Long and short texts and names, of every length at which single characters decide, worn in many ways."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcde fé") for _ in range(n))
    names = list({word(n) for n in [1, 2, 3, 4, 4, 5, 7, 8, 9, 16, 17, 30, 33, 70]})
    texts = {"", "a", "abcd", *names, *(word(rng.randrange(1, 60)) for _ in range(30))}
    for name in names:
        for _ in range(4):
            worn = [c for c in name if rng.random() > 0.2]
            for _ in range(rng.randrange(4)):
                worn.insert(rng.randrange(len(worn) + 1), rng.choice("xyz"))
            texts.add(word(rng.randrange(90)) + "".join(worn) + word(rng.randrange(90)))
    listed = [(n, f"{i:02d}") for i, n in enumerate(names)]
    got = QU.fuzzy_indicator_join(
        spark.createDataFrame([(t,) for t in texts] + [(None,), ("a",)], "text string"),
        spark.createDataFrame([*listed, ("", "99"), (None, "98"), (names[0], "97")], "name string, place string"), threshold,
    )
    want = {}
    for t in texts - {""}:
        s, place, name = min((-partial_ratio(n, t), p, n) for n, p in listed)
        if -s >= threshold:
            want[t] = (name, round(-s, 6))
    found = [(r["text"], (r["name"], round(r["score"], 6))) for r in got.collect()]
    assert len(found) == len(want) and dict(found) == want


def test_codes_are_tried_in_upper_case(spark):
    inds = spark.createDataFrame([("GDPPC", "income of persons"), ("LAW", "justice")], "indicator_code string, indicator_name string")
    df = spark.createDataFrame([(1, "valor de gdppc em 2001"), (2, "xyz?")], "q_id int, question string")
    got = QU.q_indicator(df, inds)
    assert [(r["q_id"], r["indicator_code"]) for r in got.orderBy("q_id").collect()] == [(1, "GDPPC"), (2, None)]


# --- plans ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("key", ["star_join", "snapshot", "dq_gate", "chunk_fixed", "q_classify", "top_n_ranked"])
def test_plans_stay_inside_spark(spark, key):
    import __spark_entry__ as contract

    plan = contract.queries()[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "CartesianProduct", "NestedLoop"):
        assert word not in plan
    if key == "star_join":
        assert plan.count("SortMergeJoin") == 0
    if key == "top_n_ranked":
        assert "WindowGroupLimit" in plan


def test_null_urls_are_no_duplicates(spark):
    payload = spark.createDataFrame(
        [(0, "s", "f", "", "2001-01-01"), (1, "s", "g", None, "2001-01-01"), (2, "", "h", "u", "2001-01-01"), (3, "s", "i", "u", "2001-01-01"), (4, "s", "j", "u", "2001-01-01")],
        "index int, source_code string, file_name string, report_url string, publication_date string",
    )
    registry = spark.createDataFrame([("v",)], "report_url string")
    accepted, errors = G.batch_ingest_split(payload, registry)
    assert [r[0] for r in rows(accepted, "index")] == [0, 1, 3]
    assert rows(errors, "index", "error") == [(2, "source_code, file_name e publication_date são obrigatórios"), (4, "URL duplicado")]


def test_keys_are_not_shown(spark):
    from almanac.operators.analytics import project_exclude_keys

    df = spark.createDataFrame([(1, 2, "x", 3.0)], "indicator_sk int, report_id int, name string, value double")
    assert project_exclude_keys(df).columns == ["name", "value"]


def test_positions_have_one_type_at_every_n(spark):
    from almanac.operators.ordering import top_n_per_key

    df = spark.range(3000).selectExpr("id % 2 AS k", "id AS v")
    small, large = (top_n_per_key(df, ["k"], [F.col("v")], n, "n") for n in (1000, 1001))
    assert small.dtypes == large.dtypes and large.count() - small.count() == 2


def test_null_aliases_are_ignored_however_many_there_are(spark):
    from almanac.operators.questions import alias_hits

    texts = spark.createDataFrame([(1, "from Peru to Chile")], "q_id int, q string")
    aliases = spark.createDataFrame([("peru", "Peru", 0), (None, "none", 1), ("chile", "Chile", 2)], "alias string, name string, place int")
    few, many = (sorted(map(tuple, alias_hits(texts, "q_id", "q", aliases, small).collect())) for small in (1000, 0))
    assert few == many and len(few) == 2


def test_joined_errors_are_one_row_per_file(spark):
    from almanac.operators.runlog import errors_concat

    logs = spark.range(25).selectExpr("'f' AS file_id", "id", "id AS log_time", "concat('m', id) AS error_message")
    got = [errors_concat(logs, part_size=n).collect() for n in (1000, 4)]
    assert got[0] == got[1] and got[0][0].n_errors == 25 and got[0][0].errors.endswith("m23; m24")


def test_an_empty_star_has_no_latest_year(spark):
    from almanac.operators.questions import q_year_resolve

    df = spark.createDataFrame([([], [], False)], "years array<string>, all_years array<string>, has_context boolean")
    assert df.select(q_year_resolve(None).alias("y")).first().y is None


def test_no_local_folder_on_a_cluster(spark):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Cluster.conf)

    with pytest.raises(ValueError):
        shared_dir(Cluster, "x")


# --- objects that can't be read --------------------------------------------------------------------------


def test_broken_objects_are_error_rows(spark):
    """Good and bad objects of every format side by side; nulls, bytes that are no text, plain archives, unknown formats."""
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("a.txt", "no workbook")
    parts = io.BytesIO()
    with zipfile.ZipFile(parts, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", "<oops")
    objects = [
        (1, "json", b'{"a": 1}'), (2, "json", b'{"a": '), (3, "json", b"\xff\xfe"), (4, "json", b"[1, 2]"),
        (5, "xml", b"<r><row><a>1</a></row></r>"), (6, "xml", b"<r><row><a>1</row></r>"), (7, "xml", b""), (8, "xml", b"\xff"),
        (9, "csv", b"a,b\n1,2\n"), (10, "csv", b" \n"), (11, "csv", b"\xff\xff"),
        (12, "excel", b"PK\x03\x04 cut"), (13, "excel", plain.getvalue()), (14, "excel", parts.getvalue()), (15, "excel", None),
        (16, "unknown", b"?"), (17, None, b"?"), (18, "pdf", None),
    ]
    df = spark.createDataFrame([(i, f, bytearray(c) if c is not None else None) for i, f, c in objects], "file_id int, format string, content binary")
    found = {r["file_id"]: r["error"] for r in reading.read_errors(df).collect()}
    assert set(found) == {2, 3, 6, 7, 8, 10, 11, 12, 14, 15, 16, 17, 18}
    assert "UTF-8" in found[3] and "XML mal formado" in found[6] and "BadZipFile" in found[12] and "'pdf'" in found[18]


def test_xml_rows_have_types_and_errors(spark):
    fields = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    docs = [(1, "<x><row><a>1</a><b>é</b></row><row><a>2</a></row><other/></x>"), (2, "<x><row>"), (3, "<x/>"), (4, "<x><row><a>n/a</a><b>t</b></row></x>")]
    df = spark.createDataFrame([(i, bytearray(d.encode())) for i, d in docs], "file_id int, content binary")
    got = sorted(((r["file_id"], r["a"], r["b"], r["error"] is None) for r in reading.read_xml(df, fields).collect()), key=str)
    assert [g for g in got if g[0] < 4] == [(1, 1, "é", True), (1, 2, None, True), (2, None, None, False)]


def test_chunks_leave_in_small_batches(spark, monkeypatch):
    """A worker holds the chunks of some characters, whatever the rows of its batch; long texts are in several batches."""
    from almanac.functions.splitting import split_text
    from almanac.operators import documents as D

    monkeypatch.setattr(D, "HELD", 900)
    texts = [("a", 1, "wort " * 700), (None, None, "x" * 1300 + "\n\né"), ("a", 1, ""), ("b", 2, None), ("a", 1, "kurz")]
    df = spark.createDataFrame(texts, "source string, page int, text string").coalesce(1)
    chunks = D.chunk_recursive(df)
    got = sorted((tuple(r) for r in chunks.collect()), key=str)
    want = [(s, p, i, c) for s, p, x in texts if x for i, c in enumerate(split_text(x))]
    assert got == sorted(want, key=str)
    assert "MapInArrow" in chunks._jdf.queryExecution().executedPlan().toString()


def test_workbooks_are_written_from_cells_in_any_order(spark):
    from almanac.plans.arrivals import _books_of

    cells = [(1, "S", r, c, f"{r}<&>{c}é") for r in (11, 0, 2) for c in (10, 2, 0)] + [(2, "S", 0, 0, "x")]
    df = spark.createDataFrame(cells, "file_id int, sheet string, r int, c int, text string")
    books = {r["file_id"]: bytes(r["content"]) for r in _books_of(df).collect()}
    assert [c[1:] for c in cells_of(books[1])] == sorted(c[2:] for c in cells if c[0] == 1)
    assert list(cells_of(books[2])) == [("Sheet1", 0, 0, "x")]


def test_sheets_are_read_the_same_in_one_go_and_in_rows(spark, monkeypatch):
    from almanac.plans.arrivals import _book
    from almanac.sources import workbook

    book = _book("".join(f'<row r="{r}"><c r="AB{r}"><v>{r}</v></c><c r="B{r}"/><c r="C{r}" t="inlineStr"><is><t>é</t></is></c></row>' for r in (1, 7)))
    whole = list(cells_of(book))
    monkeypatch.setattr(workbook, "_SMALL", 0)
    assert whole == list(cells_of(book)) == [("Sheet1", 0, 27, "1"), ("Sheet1", 0, 2, "é"), ("Sheet1", 6, 27, "7"), ("Sheet1", 6, 2, "é")]


def test_long_xml_is_parsed_in_pieces(spark):
    """A fault in the last piece drops the rows of all pieces; objects may share a number or have none."""
    fields = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    body = "".join(f"<!-- <row> --><row><a>{i}</a><b><![CDATA[</row>é{i}]]></b></row><other><row><a>-1</a></row></other>" for i in range(200))
    docs = [
        (1, f"<?xml version='1.0' encoding='ISO-8859-1'?><x:é k='v'>{body}</x:é>"), (1, f"<x>{body}</y>"), (None, f"<x>{body}"), (2, f"<x>{body}</x>"),
        (3, f"<!DOCTYPE x [<!ELEMENT x ANY>]><x>{body}</x>"), (4, "<x/>"),
    ]
    assert len(list(reading._pieces_of(docs[0][1].encode(), 300))) > 20 and len(list(reading._pieces_of(docs[4][1].encode(), 300))) == 1
    df = spark.createDataFrame([(i, bytearray(d.encode())) for i, d in docs], "file_id int, content binary")
    got = [tuple(r) for r in reading.read_xml(df, fields, piece=300).collect()]
    whole = [tuple(r) for r in reading.read_xml(df, fields).collect()]
    assert sorted(got, key=str) == sorted(whole, key=str)
    assert sorted(g[2:] for g in got if g[0] == 1 and g[1] is None) == [(i, f"</row>é{i}") for i in range(200)]
    assert sorted((g[0] or 0) for g in got if g[1] is not None and g[0] != 3) == [0, 1]
    assert sorted((r["file_id"] or 0) for r in reading.xml_errors(df, piece=300).collect() if r["file_id"] != 3) == [0, 1]


def test_cells_of_a_workbook_that_breaks_off_are_left_out(spark):
    """The error comes after a batch of cells has left the task."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def book(sheet):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("[Content_Types].xml", "<Types/>")
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="S" r:id="a"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="s.xml"/></Relationships>')
            z.writestr("xl/s.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}')
        return bytearray(out.getvalue())

    rows_ = "".join(f'<row r="{r}"><c r="A{r}"><v>{r}</v></c></row>' for r in range(1, 8))
    df = spark.createDataFrame([(1, book(rows_ + "</sheetData></worksheet>")), (2, book(rows_ + "<row>"))], "file_id int, content binary")
    scanned = scan_workbooks(df, rows_per_batch=3).collect()
    assert [r["file_id"] for r in scanned if r["error"]] == [2] and sum(r["file_id"] == 2 for r in scanned) > 1
    assert {r["file_id"] for r in read_workbook_grid(df, rows_per_batch=3).collect()} == {1}


# --- the fact store ----------------------------------------------------------------------------------------

FACTS = "report_id int, location_sk int, indicator_sk int, date_id int, ord int, value double"


def offered(spark, keys, value, ord_=0):
    return spark.createDataFrame([(r, l, 1, d, ord_, value) for r, l, d in keys], FACTS)


def test_loads_are_first_write_wins_and_replays_change_nothing(spark):
    path = shared_dir(spark, "facts-test")
    rng = random.Random(5)
    want, sizes = {}, []
    for batch in range(5):
        keys = [(rng.randrange(40), rng.randrange(3), rng.randrange(2)) for _ in range(60)]
        new = {k for k in keys if k not in want}
        rows_ = offered(spark, keys, float(batch)).union(offered(spark, keys, -1.0, 1)).union(offered(spark, [(None, 1, 1)], 9.0))
        for _ in range(2):  # each batch runs twice
            assert fact_store.load_facts(rows_, path, ["ord"], batch, buckets=3, bits=1 << 16) == len(new)
        want |= {k: float(batch) for k in new}
        sizes.append(len(new))
    got = {(r["report_id"], r["location_sk"], r["date_id"]): r["value"] for r in fact_store.read_facts(spark, path).collect()}
    assert got == want and fact_store.read_facts(spark, path).count() == len(want)
    assert fact_store.load_facts(offered(spark, want, 7.0), path, ["ord"], buckets=3, bits=1 << 16) == 0
    assert fact_store.load_facts(offered(spark, [], 7.0), path, ["ord"], buckets=3, bits=1 << 16) == 0
    early = fact_store.read_facts(spark, path, before=2)
    assert early.count() == sizes[0] + sizes[1]


def test_new_keys_read_no_facts_and_old_ones_only_their_folders(spark):
    path = shared_dir(spark, "facts-test")
    for batch in range(3):
        fact_store.load_facts(offered(spark, [(i, batch, i % 4) for i in range(400)], 1.0), path, ["ord"], batch, buckets=4)
    keyed = lambda df: df.withColumn("bucket", fact_store.bucket_of(4)).select(*fact_store.FACT_KEY, "bucket")
    parts = [(d, b) for d in range(4) for b in range(4)]
    filters = fact_store.newest_filters(spark, path, parts, None)
    assert fact_store.maybe_stored(keyed(offered(spark, [(i, 9, i % 4) for i in range(400)], 1.0)), filters).count() <= 4
    old = keyed(offered(spark, [(i, 1, i % 4) for i in range(400)], 1.0))
    assert rows(fact_store.maybe_stored(old, filters), "report_id") == [(i,) for i in range(400)]  # none is missing
    # each date and bucket has one filter that counts, however many batches wrote it
    assert filters.groupBy("date_id", "bucket", "no").count().where("count > 1").isEmpty()
    one = keyed(offered(spark, [(8, 1, 0)], 1.0))
    wanted = fact_store._pairs(fact_store.maybe_stored(one, filters))
    assert len(wanted) == 1
    plan = fact_store._only(fact_store.read_facts(spark, path), wanted)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*date_id[^\]]*= 0", plan) and "bucket" in plan.split("PartitionFilters")[1]


def test_a_batch_that_broke_off_is_not_read(spark):
    path = shared_dir(spark, "facts-test")
    fact_store.load_facts(offered(spark, [(1, 1, 1)], 1.0), path, ["ord"], 0)
    offered(spark, [(2, 2, 2)], 2.0).drop("ord").withColumn("bucket", F.lit(0)).write.partitionBy("date_id", "bucket").parquet(f"{path}/facts/batch=000000001")
    assert rows(fact_store.read_facts(spark, path), "report_id") == [(1,)]
    assert fact_store.load_facts(offered(spark, [(2, 2, 2)], 3.0), path, ["ord"], 1) == 1
    assert rows(fact_store.read_facts(spark, path), "report_id", "value") == [(1, 1.0), (2, 3.0)]


# --- names that are written differently -------------------------------------------------------------------


def test_nearest_names_equal_comparing_all(spark):
    rng = random.Random(11)
    known = [("Germany", "DEU"), ("Ghana", "GHA"), ("Guyana", "GUY"), ("Niger", "NER"), ("Nigeria", "NGA"), ("Österreich", "AUT"), ("Ελλάδα", "GRC"), ("Iran", "IRN"), ("Iraq", "IRQ"), ("New Zealand", "NZL"), ("Côte d'Ivoire", "CIV"), ("Togo", "TGO"), ("togo ", "TGA")]
    asked = {"germany", "Gèrmany", "Germani", "Grmany", "Nigera", "Nigeri", "Iram", "iran", "Osterreich", "ελλαδα", "Neu Sealand", "New  ZEALAND", "cote d’ivoire", "", " ", "Togo", "Tog", "Atlantis", "Ｇｈａｎａ"}
    for name, _ in known:
        for _ in range(6):
            letters = list(name)
            for _ in range(rng.randrange(1, 4)):
                k = rng.randrange(len(letters))
                letters[k : k + 1] = rng.choice([[], ["x"], [letters[k], "y"]])
                letters = letters or ["z"]
            asked.add("".join(letters))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    codes = {}
    for name, code in known:
        key = spelling._fold(name)
        codes[key] = min(code, codes.get(key, code))
    want = {}
    for name in asked:
        key, near = spelling._fold(name), {}
        for k, code in codes.items():
            d, n = distance(key, k), min(len(key), len(k))
            if key and d <= (0 if n < 5 else 1 if n < 9 else 2):
                near.setdefault(d, set()).add(code)
        if near and len(near[min(near)]) == 1:
            want[name] = (near[min(near)].pop(), min(near))
    got = spelling.nearest_names(spark.createDataFrame([(a,) for a in asked] + [(None,), ("iran",)], "name string"), spark.createDataFrame([*known, (None, "X"), ("Y", None)], "name string, code string"))
    found = {r["name"]: (r["code"], r["distance"]) for r in got.collect()}
    assert found == want
    assert found["Germani"] == ("DEU", 1) and "Nigera" not in found and "Iram" not in found and found["ελλαδα"][0] == "GRC" and found["Ｇｈａｎａ"] == ("GHA", 0)


# --- the job -----------------------------------------------------------------------------------------------


def test_delimited_files_with_different_titles(spark):
    texts = [(1, 'Unnamed: 0,Unnamed: 1,GDP,"Rank, all"\n2000.0,PRT,1.5,"7"\n2001.0,ESP,"2,5",8\n'), (2, "Unnamed: 0,Unnamed: 1,LAW\r\n1999.0,FRA,3\r\n"), (3, " ")]
    objects = spark.createDataFrame([(i, bytearray(x.encode())) for i, x in texts], "file_id int, content binary")
    wide = job.read_table(objects)
    got = rows(R.reshape_wide_unnamed(wide.drop("Rank, all")), "file_id", "location_code", "indicator_code", "year", "value")
    assert got == [(1, "PRT", "GDP", 2000, 1.5), (2, "FRA", "LAW", 1999, 3.0)]


def test_a_run_without_files_changes_nothing(spark):
    path = shared_dir(spark, "job-test")
    files = spark.createDataFrame([(1, 1, "done"), (2, 9, "bronze")], "file_id int, report_id int, pipeline_status string")
    reports = spark.createDataFrame([(1, "S")], "report_id int, source_code string")
    objects = spark.createDataFrame([], "file_id int, format string, content binary")
    mapping = spark.createDataFrame([], "source_code string, extract_function string, ai_extract_function string")
    places = spark.createDataFrame([("PRT", 1, "Portugal")], "location_code string, location_sk int, name string")
    dates = spark.createDataFrame([(1, 2000)], "date_id int, year int")
    known = spark.createDataFrame([], "indicator_sk int, source_system string, indicator_code string, indicator_name string")
    for indicators in (known, None):
        out = job.run_job(files, reports, objects, mapping, places, dates, indicators, f"{path}/s", f"{path}/f", F.current_timestamp(), buckets=1, bits=1 << 16)
        assert rows(out.files, "file_id", "pipeline_status") == [(1, "done"), (2, "bronze")]  # the report of file 2 is unknown
        assert out.logs.collect() == [] and out.n_facts == 0


def test_files_without_object_or_rows_fail_alone(spark):
    path = shared_dir(spark, "job-test")
    files = spark.createDataFrame([(i, 1, "bronze") for i in range(1, 5)], "file_id int, report_id int, pipeline_status string")
    doc = '{"indicators": {"GDP": {"label": "Income"}}, "values": {"GDP": {"PRT": {"2000": %s}, "ESP": {"2000": 2}}}}'
    texts = {1: doc % "1.5", 2: "[]", 3: doc % "7"}
    objects = spark.createDataFrame([(i, "json", bytearray(x.encode())) for i, x in texts.items()], "file_id int, format string, content binary")
    mapping = spark.createDataFrame([("S", "imf", "manual")], "source_code string, extract_function string, ai_extract_function string")
    reports = spark.createDataFrame([(1, "S")], "report_id int, source_code string")
    places = spark.createDataFrame([("PRT", 1, "Portugal"), ("ESP", 2, "Spain")], "location_code string, location_sk int, name string")
    dates = spark.createDataFrame([(1, 2000)], "date_id int, year int")
    out = job.run_job(files, reports, objects, mapping, places, dates, None, f"{path}/s", f"{path}/f", F.current_timestamp(), buckets=1, bits=1 << 16)
    assert rows(out.files, "file_id", "pipeline_status") == [(1, "done"), (2, "failed"), (3, "done"), (4, "failed")]
    assert rows(out.logs, "file_id", "step", "error_message") == [("2", "silver", job.EMPTY), ("4", "silver", job.NO_OBJECT)]
    # the same keys come from two files: the first file's values stay
    assert rows(fact_store.read_facts(spark, f"{path}/f"), "location_sk", "value") == [(1, 1.5), (2, 2.0)] and out.n_facts == 2


@pytest.mark.parametrize("key", ["snapshot", "point_lookup", "existence_count", "threshold_filter", "top_n_overall"])
def test_point_queries_prune_dates_and_names_before_facts(spark, key):
    import __spark_entry__ as contract

    df = contract.queries()[key](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SubqueryBroadcast dynamicpruning" in plan
    assert "indicator_name" in plan and "SortMergeJoin" not in plan  # names decide in the dimension, whose keys are sent to the facts


def test_aliases_reach_the_texts_and_only_hits_are_shuffled(spark, monkeypatch):
    """Equal rows for few and many aliases, in one block and in several."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcd é") for _ in range(n))
    listed = [(a, f"n{i % 7}", i) for i, a in enumerate(sorted({word(rng.randrange(1, 6)) for _ in range(400)}))]
    texts = [(i, word(rng.randrange(0, 60)).upper()) for i in range(30)] + [(30, None), (31, "")]
    want = sorted((i, a, n, p, t.lower().index(a) + 1) for i, t in texts if t for a, n, p in listed if a in t.lower())
    df = spark.createDataFrame(texts, "q_id int, question string")
    aliases = spark.createDataFrame([*listed, (None, "x", 9)], "alias string, name string, place int")
    for small, block in ((1_000, 100_000), (10, 100_000), (10, 150)):
        monkeypatch.setattr(QU, "ALIAS_BLOCK", block)
        hits = QU.alias_hits(df, "q_id", "question", aliases, small)
        assert rows(hits, "q_id", "alias", "name", "place", "pos") == want
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    many = spark.createDataFrame([(f"zz{i}", "n", i) for i in range(10_000)] + listed, "alias string, name string, place int")
    assert rows(QU.alias_hits(df, "q_id", "question", many), "q_id", "alias", "name", "place", "pos") == want


def test_an_empty_warehouse_has_nothing_to_list(spark):
    places = spark.createDataFrame([("Portugal",), ("Spain",)], "name string")
    codes = spark.createDataFrame([("GDP", "Income", "S")], "indicator_code string, indicator_name string, source_system string")
    full = {r["tier"]: r["listing"] for r in answers.list_sentences(places, codes).collect()}
    assert full["meta:list_countries"].endswith("Portugal, Spain.") and "Income" in full["meta:list_indicators"]
    empty = {r["tier"]: r["listing"] for r in answers.list_sentences(places.limit(0), codes.limit(0)).collect()}
    assert empty == {"meta:list_countries": answers.NO_LIST, "meta:list_indicators": answers.NO_LIST}


def test_a_run_report_has_its_lines_in_order(spark):
    files = spark.createDataFrame([(1, "http://a", "silver"), (2, None, "failed"), (3, "http://c", "failed"), (4, "http://d", "pending")], "file_id int, file_url string, pipeline_status string")
    day = dt.datetime(2024, 1, 5)
    logs = [(1, "3", "bronze", "gone", day), (2, "3", "bronze", "gone again", day), (3, "1", "gold", None, day), (4, "2", "silver", "old", dt.datetime(2024, 1, 4))]
    logs = spark.createDataFrame(logs, "id long, file_id string, step string, error_message string, log_time timestamp_ntz")
    start = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    path = shared_dir(spark, "report-test")
    silver_store.write_run_report(runlog.run_funnel(files, logs, start), path, runlog.run_report(files, logs, start))
    lines = [r["value"] for r in spark.read.text(path).coalesce(1).collect()]
    body = [x for x in lines if not x.startswith("[")]
    assert len(lines) - len(body) == 4 and body == [
        "  OK        file_id=1  URL=http://a",
        "  UPLOAD    file_id=2  [ficheiro carregado via upload — ja no MinIO]",
        "  ERRO      file_id=3  URL=http://c",
        "            Erro: gone again",
        "  OK        file_id=1  -> 1.parquet",
        "  FAILED    file_id=2",
        "            Erro: —",
        "  OK        file_id=1",
        "  ERRO      step=gold  file_id=1",
        "            Erro: ",
    ]
