"""Guards: ties, nulls, ambiguity, empty tables, unsafe input."""

import json

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftdocs.functions import forms as N
from weftdocs.functions import text as X
from weftdocs.functions import values as U
from weftdocs.operators import diff, evidence, formula, joins, lines, scoring, search, stats
from weftdocs.sources import files
from weftdocs.streaming import events


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, X.search_tokens("t"), t="T-19 予測 a load_ratio") == ["t-19", "load_ratio", "予測", "予測"]
    assert one(spark, X.search_tokens("t"), t="学習データ") == ["学習データ", "学習", "習デ", "デー", "ータ"]
    assert one(spark, X.search_tokens("t"), t="Flag_x. -y ab- 「金」を") == ["flag_x", "ab", "金", "を"]
    assert X.tokens_of("T-19 予測 予測 金") == ["t-19", "予測", "金"] and X.tokens_of("か\u3099き") == ["がき"]
    assert one(spark, X.token_count("t").cast("string"), t="T-19 予測x金 学習データ ab-") == "10"
    # pairs go across what stands between; an underscore belongs to a word
    assert one(spark, X.bag_tokens("t"), t="A_b 金a銀") == ["a_b", "a", "金銀", "金", "銀"]
    assert one(spark, X.bag_tokens("t"), t="金") == ["金"] and one(spark, X.bag_tokens("t"), t="") == []
    strong, weak = X.strong_weak("t")
    assert one(spark, strong, t="Ab_1 x 予測値 金") == ["ab_1", "予測値"]
    assert one(spark, weak, t="Ab_1 x 予測値 金") == ["予測", "測値"]
    assert one(spark, weak, t="予測モデル") == ["予測モ", "測モデ", "モデル", "予測", "測モ", "モデ", "デル"]
    assert one(spark, X.composed("t"), t="か\u3099") == "が"
    assert one(spark, X.search_tokens("t"), t="") == []
    assert one(spark, X.trigrams("t"), t="ab") == []


@pytest.mark.parametrize("cell,want", [("1,234", 1234.0), ("12.5%", 12.5), ("1,23", None), ("", None), (None, None), ("-7", -7.0), ("T12", None)])
def test_parse_numeric(spark, cell, want):
    assert one(spark, X.parse_numeric("c"), c=cell) == want


def test_versions_and_dates(spark):
    got = [one(spark, X.version_rank("n"), n=n) for n in ("a_old.csv", "a.csv", "a_v2.csv", "a 改訂-3.csv", "a_final.csv")]
    assert got == sorted(got) and len(set(got)) == 5
    assert one(spark, X.version_base("n"), n="Report_v2.pdf") == one(spark, X.version_base("n"), n="report.pdf")
    assert str(one(spark, X.iso_date("c"), c="期限は2024年5月6日")) == "2024-05-06"
    assert one(spark, X.iso_date("c"), c="2024-13-40") is None


def test_half_up(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (None,)], "v double").select(X.half_up("v", 0).cast("int").alias("x"))
    assert [r.x for r in df.collect()] == [3, -3, None]


def test_carried_context_and_fill(spark):
    d = spark.createDataFrame([(1, "a\n[page2]\nb\n\n[sheet1]\nc"), (2, "")], "id int, text string")
    c = lines.carried_context(lines.lines(d, "id", "text"), "id").select("line_no", "marker", "marker_no")
    assert rows(c) == [(1, None, None), (2, "page", 2), (3, "page", 2), (5, "sheet", 1), (6, "sheet", 1)]
    f = spark.createDataFrame([(1, 1, "x", False), (1, 2, None, False), (1, 3, None, True), (1, 4, None, False)], "g int, o int, v string, clear boolean")
    assert [r.v_filled for r in lines.forward_fill(f, ["g"], ["o"], "v", F.col("clear")).orderBy("o").collect()] == ["x", "x", None, None]


def test_gap_clusters(spark):
    d = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 2, 9, 10, 30])], "g int, i int, v double")
    assert [r.cluster for r in lines.gap_clusters(d, ["g"], "v", "i", 5).orderBy("i").collect()] == [0, 0, 1, 1, 2]


def test_unique_right_refuses_two(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    right = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    assert rows(joins.join_unique(left, right, ["k"])) == [("a", None), ("b", 3), (None, None)]


def test_compare_and_crosstab(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (4, None)], "k int, v string")
    assert rows(joins.compare(a, b, ["k"], "v")) == [(2, "y", "z", "modify"), (3, None, None, "remove"), (4, None, None, "add")]
    assert rows(joins.crosstab(a, "k", "v", ["x", "q"])) == [(1, 1, 0), (2, 0, 0), (3, 0, 0)]


def test_ties_give_nothing(spark):
    d = spark.createDataFrame([("g", "a", 2), ("g", "b", 2), ("h", "c", 1), ("h", "d", None)], "g string, k string, v int")
    assert [r.k for r in stats.unique_best(d, ["g"], "v").collect()] == ["c"]
    votes = spark.createDataFrame([("q", "x"), ("q", "x"), ("q", "y"), ("q", "y"), ("r", "z"), ("r", "z"), ("s", "w")], "g string, v string")
    assert rows(scoring.majority(votes, ["g"], "v", 2)) == [("r", "z", 2)]


def test_histogram_edges(spark):
    d = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (None,)], "v double")
    h = stats.histogram(d, "v", 10).orderBy("bin").collect()
    assert [r.n for r in h] == [1, 1, 0, 0, 0, 0, 0, 0, 0, 1]
    assert stats.histogram(d.filter("v = 1"), "v", 10).count() == 0
    assert stats.histogram(d.limit(0), "v", 10).count() == 0


def test_correlation_of_constant_is_null(spark):
    d = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0)], "y double, x double, c double")
    r = {r["column"]: r["r"] for r in stats.correlations(d, "y", ["x", "c"]).collect()}
    assert r["x"] == pytest.approx(1) and r["c"] is None


def test_least_squares(spark):
    d = spark.createDataFrame([(float(3 + 2 * i - k), float(i), float(k)) for i in range(6) for k in range(3)], "y double, a double, b double")
    fit = stats.least_squares(d, "y", ["a", "b"])
    assert fit["intercept"] == pytest.approx(3) and fit["a"] == pytest.approx(2) and fit["b"] == pytest.approx(-1)
    assert stats.least_squares(d.limit(2), "y", ["a", "b"]) is None


def test_f1_takes_lower_threshold_on_tie(spark):
    d = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (0.5, 0), (0.1, 0), (3.0, 1)], "s double, y int")
    brute = []
    data = [(r.s, r.y) for r in d.collect()]
    for t in {s for s, _ in data}:
        tp = sum(y for s, y in data if s >= t)
        n = sum(s >= t for s, _ in data)
        brute.append((2 * tp / (n + 3), -t))
    best = max(brute)
    got = stats.f1_sweep(d, "s", "y").first()
    assert (got.f1, got.threshold) == (round(best[0], 8), -best[1])


def test_spearman_against_ranks(spark):
    d = spark.createDataFrame([("g", 1.0, 3.0), ("g", 2.0, 2.0), ("g", 2.0, 5.0), ("g", 9.0, 9.0), ("h", 1.0, 1.0), ("h", 1.0, 2.0)], "g string, x double, y double")
    r = {r.g: r.rho for r in stats.spearman(d, ["g"], "x", "y").collect()}
    assert r["h"] is None and r["g"] == pytest.approx(0.6324555)


def test_thresholds(spark):
    d = spark.createDataFrame([("a", 0.9, 1.0), ("a", 0.5, -1.0), ("a", 0.4, 1.0), ("b", 0.9, -1.0)], "g string, c double, p double")
    got = {r.g: (r.threshold, r.ev, r.committed) for r in scoring.best_threshold(d, "c", F.col("p"), ["g"]).collect()}
    assert got == {"a": (0.9, 1.0, 1), "b": (None, 0.0, 0)}


def test_certificate(spark):
    u = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "k string, ok boolean")
    s = spark.createDataFrame([("a",)], "k string")
    r = evidence.certificate(u, "k", F.col("ok"), s, s).first()
    assert (r.total, r.applicable, r.scanned, r.unsupported, r.hits, r.complete) == (3, 2, 1, 1, 1, False)


def test_exclude_any_require_all(spark):
    d = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, []), (4, None)], "k int, t array<string>")
    assert [r.k for r in evidence.exclude_any_require_all(d, "t", ["b"], ["a"]).collect()] == [2]


@pytest.mark.parametrize("spec", [{"op": "eval", "args": [{"const": 1}]}, {"ref": "secret"}, {"const": "1"}, {"const": True}, {"op": "add", "args": []}, [], {"__import__": "os"}])
def test_unsafe_formulas_are_refused(spec):
    with pytest.raises(ValueError):
        formula.to_column(spec, {"a"})


def test_formula_agrees_with_fractions(spark):
    d = spark.createDataFrame([(1.5, 4.0), (2.5, 0.0), (None, 1.0)], "a double, b double")
    for spec in [{"op": "div", "args": [{"ref": "a"}, {"ref": "b"}]}, {"op": "round", "args": [{"ref": "a"}, {"const": 0}]}, {"op": "percent_change", "args": [{"ref": "b"}, {"ref": "a"}]}, {"op": "mean", "args": [{"ref": "a"}, {"ref": "b"}, {"const": 3}]}]:
        for r in d.select(formula.to_column(spec, {"a", "b"}).alias("x"), formula.exact_value(spec, ["a", "b"]).alias("y")).collect():
            assert (r.x is None) == (r.y is None) and (r.x is None or r.x == pytest.approx(r.y))


def test_slash_zip(spark):
    d = spark.createDataFrame([("a/b", "1/2"), ("a/b", "1")], "l string, v string")
    got = d.select(formula.slash_zip(F.col("l"), F.col("v")).alias("z")).collect()
    assert [tuple(p) for p in got[0].z] == [("a", "1"), ("b", "2")] and got[1].z is None


def test_diversify_caps_then_fills(spark):
    d = spark.createDataFrame([(1, "f", "x", 9.0), (2, "f", " x", 8.0), (3, "f", "y", 7.0), (4, "g", "z", 1.0)], "id int, doc string, text string, score double")
    assert [r.id for r in search.diversify(d, "id", "doc", "text", 1, 3).collect()] == [1, 4, 3]


def test_cosine_without_direction_is_null(spark):
    d = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<float>, b array<float>")
    assert [r.c for r in d.select(search.cosine("a", "b").alias("c")).collect()] == [None, 1.0]


def test_changed_and_moved_lines(spark):
    docs = spark.createDataFrame([(1, "a\nb\nb\nc"), (2, "b\n c\nd")], "id long, text string")
    pairs = spark.createDataFrame([(1, 2)], "old long, new long")
    c = diff.moved(diff.changed_lines(pairs, docs, "id", "text"), ["old", "new"]).select("line", "change", "times", "moved")
    assert rows(c) == [(" c", "add", 1, True), ("a", "remove", 1, False), ("b", "remove", 1, False), ("c", "remove", 1, True), ("d", "add", 1, False)]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.lists(st.sampled_from(["a", "b", "c", "", "d e"]), min_size=1, max_size=9)] * 2), min_size=1, max_size=6))
def test_edit_blocks_turn_one_text_into_the_other(spark, versions):
    data = [(2 * k + side, "\r\n".join(v[side]) if k % 2 else "\n".join(v[side])) for k, v in enumerate(versions) for side in (0, 1)]
    docs = spark.createDataFrame(data, "id long, text string")
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(len(versions))], "old long, new long")
    found = diff.edit_blocks(pairs, docs, "id", "text").collect()
    for k, (a, b) in enumerate(versions):
        if not all("\n".join(v) for v in (a, b)):
            continue  # empty texts give no block
        out, at = [], 0
        for r in sorted((r for r in found if r.old == 2 * k), key=lambda r: (r.old_from, r.new_from)):
            assert (r.op == "insert") == (r.old_from == r.old_to) and (r.op == "delete") == (r.new_from == r.new_to)
            out += a[at : r.old_from] + b[r.new_from : r.new_to]
            at = r.old_to
        assert out + a[at:] == b


def test_files(spark, tmp_path):
    (tmp_path / "00.plan").mkdir()
    (tmp_path / "00.plan" / "a.txt").write_bytes("予測 ok".encode("cp932"))
    (tmp_path / "00.plan" / "~$a.txt").write_bytes(b"x")
    (tmp_path / "b.md").write_text("é", encoding="utf-8")
    (tmp_path / "t.csv").write_text('k,v\na,"1,200"\nb,\n')
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": [{"cell_type": "code", "source": ["1+", "1"], "outputs": [{"text": ["2"]}]}, {"cell_type": "markdown", "source": ["# x"]}]}))
    found = {r.rel: r for r in files.walk(spark, str(tmp_path)).collect()}
    assert set(found) == {"00.plan/a.txt", "b.md", "t.csv", "n.ipynb"} and found["00.plan/a.txt"].folder_no == "00"
    assert {r.rel: r.text for r in files.texts(spark, str(tmp_path)).collect()} == {"00.plan/a.txt": "予測 ok", "b.md": "é"}
    df, numbers = files.numeric_where_whole(files.delimited(spark, str(tmp_path / "t.csv")))
    assert numbers == ["v"] and rows(df) == [("a", 1200.0), ("b", None)]
    assert rows(files.notebook_cells(spark, str(tmp_path / "n.ipynb"))) == [("n.ipynb", 1, "code", "1+1", "2"), ("n.ipynb", 2, "markdown", "# x", "")]


def test_versions_of_a_table(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    assert files.read_latest(spark, folder, schema).count() == 0
    for v in ("a", "b"):
        files.write_version(spark.createDataFrame([(1, v)], schema), folder, ["k"])
    assert rows(files.read_latest(spark, folder, schema)) == [(1, "b")]
    assert files.read_latest(spark, folder, T.StructType([T.StructField("z", T.LongType())])).count() == 0


def test_ledger_keeps_last_record(spark, tmp_path):
    import datetime as dt

    for n, data in enumerate([[(1, dt.datetime(2024, 1, 1), 7, "a", 1.0, ""), (2, dt.datetime(2024, 1, 2), 7, "b", 2.0, "")], [(3, dt.datetime(2024, 1, 3), 7, "c", 3.0, ""), (4, dt.datetime(2024, 1, 1), 8, "d", 4.0, "")]]):
        spark.createDataFrame(data, events.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(events.EVENTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    events.upsert_ledger(stream, ["user_id"], "event_id", f"{tmp_path}/out", f"{tmp_path}/state")
    ledger = events.read_ledger(spark, f"{tmp_path}/out", events.EVENTS)
    assert rows(ledger.select("user_id", "event_id")) == [(7, 3), (8, 4)]
    # a batch rewrites the buckets of its keys only
    assert len(list((tmp_path / "out" / "batch=000000").glob("bucket=*"))) == 1 and len(list((tmp_path / "out" / "batch=000001").glob("bucket=*"))) == 2
    assert events.read_ledger(spark, f"{tmp_path}/none", events.EVENTS).count() == 0


def test_batch_windows(spark):
    import datetime as dt

    e = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 5), 1, "a", 1.0, None), (1, dt.datetime(2024, 1, 1, 0, 5), 1, "a", 1.0, None), (2, dt.datetime(2024, 1, 1, 3), 1, "a", None, None)], events.EVENTS)
    assert events.once(e).count() == 2
    assert events.hourly(e).count() == 2 and events.sliding(e).count() == 4
    assert sorted(r.n for r in events.sessions(e).collect()) == [1, 2]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\u3000。", max_size=400))
def test_chunks_have_their_properties(text):
    spans = N.chunk_spans(text, 40, 8)
    assert all(0 < e - s <= 40 and not text[s].isspace() and not text[e - 1].isspace() for s, e in spans)
    covered = set().union(*[range(s, e) for s, e in spans]) if spans else set()
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)
    for (s, e), (s2, e2) in zip(spans, spans[1:], strict=False):
        assert s < s2 and e <= e2 and s2 >= e - 8  # blanks may be left out between them
        half = text[s + 20 : s + 40]
        if "\n" not in half and not text[s + 39].isspace():
            assert e == s + 40 or e2 == len(text.rstrip()) or e - s > 20


def test_chunks_of_columns(spark):
    d = spark.createDataFrame([(None,), ("",), (" \n ",), ("x" * 25 + "\n" + "y" * 90,)], "t string")
    got = [None if r.c is None else [(x.start, x.end) for x in r.c] for r in d.select(N.chunk_starts("t", 40, 8).alias("c")).collect()]
    assert got == [None, [], [], [(0, 25), (17, 57), (49, 89), (81, 116)]]


def test_all_evidence_of_a_line(spark):
    text = "佐藤部長と田中さん、山田様子 3,000円から12,000円、5%と7.5 %以上\nABC（Alpha社） EXT: 123 内線456\nID | item | owner\n【太字箇所】x / y\nT1 | a | 佐藤さん達"
    d = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    got: dict = {}
    for r in evidence.extract(lines.lines(d, "id", "text"), ["id"]).collect():
        got.setdefault(r.ev_type, []).append((r.ev_key, r.ev_value))
    assert sorted(got["person"]) == [("佐藤", "佐藤部長"), ("田中", "田中さん")]
    assert [v for _, v in got["amount"]] == ["3,000", "12,000"] and [v for _, v in got["rate"]] == ["5", "7.5"]
    assert got["condition"] == [("以上", "以上")] and got["alias"] == [("ABC", "Alpha社")] and got["ext"] == [("123", "123"), ("456", "456")]
    assert got["column"] == [("ID", "ID"), ("item", "item"), ("owner", "owner")] and got["bold"] == [("x", "x"), ("y", "y")]


def test_empty_universe_is_not_complete(spark):
    u = spark.createDataFrame([("c", False)], "k string, ok boolean")
    assert not evidence.certificate(u, "k", F.col("ok"), u, u).first().complete


def test_percentiles_and_ranks_against_numpy(spark):
    rng = np.random.default_rng(2)
    values = [float(v) for v in rng.integers(0, 40, 500)] + [1e9, -5.0]
    d = spark.createDataFrame([(v, None if i % 7 == 0 else v * 2) for i, v in enumerate(values)], "a double, b double")
    got = {(r["column"], r["pct"]): r["value"] for r in stats.percentiles(d, ["a", "b"]).collect()}
    for name, x in (("a", values), ("b", [v * 2 for i, v in enumerate(values) if i % 7])):
        for p in stats.PERCENTS:
            assert got[name, p] == pytest.approx(np.percentile(x, p))
    ranks = {r.a: r["rank"] for r in stats.average_ranks(d.withColumn("g", F.lit(1)), ["g"], "a").collect()}
    assert all(ranks[v] == sum(w < v for w in values) + (values.count(v) + 1) / 2 for v in set(values))
    assert stats.percentiles(d.limit(0), ["a"]).count() == 0


def test_every_asked_vector_gets_its_list(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 5)).round(3)
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(100, None), (101, [0.0] * 5), (102, [float("nan")] * 5), (103, [1.0, 2.0])]
    d = spark.createDataFrame(data, "id long, v array<float>").repartition(5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for block in (100, 4):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        got: dict = {}
        for r in search.nearest_all(d, "id", "v", F.col("id") % 10 == 0, 3).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append(r.id)
        assert set(got) == {0, 10, 20, 30, 40, 50}
        assert all(ids == list(np.argsort(-(u @ u[q]), kind="stable")[:3]) for q, ids in got.items())


def test_rows_that_share_rare_tokens(spark, monkeypatch):
    rng = np.random.default_rng(8)
    bags = [(i, sorted({f"t{j}" for j in rng.integers(0, 30, 6)})) for i in range(70)]
    bags += [(100, None), (101, []), (5, ["t1", "t2", "t3"])]  # key 5 stands in two rows
    d = spark.createDataFrame(bags, "id long, tokens array<string>").repartition(5)
    weight = {f"t{j}": 4 + j / 7 for j in range(20)}  # the other tokens weigh nothing
    asked = [(i, t) for i, b in bags if i % 10 == 0 and b for t in b if t in weight]
    want: dict = {}
    for q, t in asked:
        for i, b in bags:
            if b and t in b:
                want.setdefault(q, {})[i] = want.get(q, {}).get(i, 0.0) + weight[t]
    wanted = spark.createDataFrame([(q, t, weight[t]) for q, t in asked], "query long, token string, weight double")
    for block, part, many in ((100, 512, 2048), (100, 2, 3), (3, 2, 3)):
        for name, value in (("QUERY_BLOCK", block), ("SLICE", part), ("ROWS", many)):
            monkeypatch.setattr(search, name, value)
        got: dict = {}
        for r in search.sharing_all(d, "id", "tokens", wanted, 4).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append((r.id, r.score))
        assert got == {q: [(i, round(s, 6)) for i, s in sorted(of.items(), key=lambda x: (-round(x[1], 6), x[0]))[:4]] for q, of in want.items()}
    assert search.sharing_all(d, "id", "tokens", wanted.limit(0), 4).count() == 0


def test_no_pair_of_a_search_is_shuffled(spark):
    n = 400  # one token in all rows of a half: pairs of queries and rows grow with the square
    d = spark.createDataFrame([(i, [f"w{i % 2}"]) for i in range(n)], "id long, tokens array<string>").repartition(2)
    asked = spark.createDataFrame([(q, f"w{q % 2}", 1.0) for q in range(n)], "query long, token string, weight double")
    found = search.sharing_all(d, "id", "tokens", asked, 1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and found.count() == n


def test_streams_keep_late_rows(spark, tmp_path):
    import datetime as dt

    days = [(20, 1), (1, 1), (20, 2), (1, 2), (2, 9)]  # files out of time order, weeks apart
    for n, (day, hour) in enumerate(days):
        spark.createDataFrame([(n, dt.datetime(2024, 1, day, hour), 7, "a", 1.0, "")], events.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = events.read_stream(spark, f"file://{tmp_path}/in", 1)
    got = events.run_to_version(events.hourly(stream, None), f"file://{tmp_path}/out")
    assert got.count() == 5 and got.agg(F.sum("n")).first()[0] == 5


def test_forms(spark):
    assert one(spark, N.id_range("a", "b"), a="T08", b="T11") == ["T08", "T09", "T10", "T11"]
    assert one(spark, N.id_range("a", "b"), a="T08", b="S11") is None and one(spark, N.id_range("a", "b"), a="T9", b="T1") is None
    assert one(spark, N.small_number("c"), c="三") == 3 and one(spark, N.small_number("c"), c="12") == 12 and one(spark, N.small_number("c"), c="x") is None
    assert one(spark, N.only_value("c", "n=([0-9]+)", "m=([0-9]+)"), c="n=1 n=2 m=7 m=7") == "7"
    assert one(spark, N.normal_form("c"), c="e\u0301") == "é"
    d = spark.createDataFrame([(["a"], ["a", "b"]), (["a"], ["b"]), (["a"], ["a"])], "o array<string>, n array<string>")
    assert [r.x for r in d.select(N.appended(F.col("o"), F.col("n")).alias("x")).collect()] == [["b"], None, None]


def test_numbers_and_rates(spark):
    assert one(spark, U.numbers("c"), c="1,200円と3.5%") == ["1200", "3.5"] and one(spark, U.numbers("c"), c="") == []
    got = [one(spark, U.number_verdict("a", "b"), a=a, b=b) for a, b in (("12%", "12.0"), ("12.3", "12.34"), ("12.4", "12.34"), ("1 2", "1"), ("x", "1"), ("0.5", "1"), (None, "1"))]
    assert got == ["exact", "rounded", "no", "no", "no", "rounded", "no"]
    assert tuple(one(spark, U.rate("c"), c="20〜10%")) == (10.0, 20.0, 15.0) and one(spark, U.rate("c"), c="1 2 3") is None and one(spark, U.rate("c"), c="") is None
    assert [one(spark, U.hours("c"), c=c) for c in ("2", "2.5h", "3時間", "4 hours", "h", "T2", None)] == [2.0, 2.5, 3.0, 4.0, None, None, None]
    assert one(spark, U.header_core("c"), c="金額（円）") == "金額" and one(spark, U.without_bracket("c"), c="12件（3%）") == "12件（3%）" and one(spark, U.without_bracket("c"), c="12（件）") == "12"
    asked = spark.createDataFrame([("小数点以下2桁で", 1.23456), ("to 1 decimal place", 2.25), ("いくつ", 1.5)], "q string, v double")
    assert [r.x for r in asked.select(U.rounded_as_asked("q", F.col("v")).alias("x")).collect()] == [1.23, 2.3, 1.5]
    assert one(spark, U.tilde_range("c"), c="[1.5, 2)") == "1.5〜2"


def test_answers_and_wordings(spark):
    got = [one(spark, U.answer_verdict("a", "b"), a=a, b=b) for a, b in (("T24です。", "t24"), ("12.0", "12"), ("予測モデルの移行", "予測モデル"), ("", "x"), ("a", "b"))]
    assert got == ["same", "number", "contains", "different", "different"]
    d = spark.createDataFrame([(["ab", "c"], ["a", "c"]), (["ab"], ["x"]), ([], ["a"]), (["a"], [])], "f array<string>, w array<string>")
    assert [r.x for r in d.select(U.set_contained(F.col("f"), F.col("w")).alias("x")).collect()] == [True, False, False, True]
    assert [one(spark, U.status_kind("c"), c=c) for c in ("完了", "未完了", "進行中", "x", "closed")] == ["done", "open", "open", "unknown", "done"]
    assert [one(spark, U.coarse_colour("c"), c=c) for c in ("FF0000", "ffff00", "00B050", "0070C0", "FFFFFF", "000000", "7F7F7F", "FFC000", "x")] == ["red", "yellow", "green", "blue", "white", "black", "grey", "yellow", None]
    assert one(spark, U.paraphrases("c"), c="値は何ですか。") == ["値を教えてください。"] and one(spark, U.paraphrases("c"), c="x") == []
    assert one(spark, U.condition_of("c"), c="もし10%下がったらいくらですか") == "10%下がっ" and one(spark, U.condition_of("c"), c="いくらですか") is None
    assert [tuple(one(spark, U.change_score("c"), c=c)) for c in ("[page3]", "T12は3,000円", "文言のみ")] == [("boilerplate", 0, 0), ("substantive", 2, 2), ("wording", 1, 0)]
