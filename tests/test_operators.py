import json

import pytest
from pyspark.sql import functions as F

from recordmill.operators import graph, importers, publication, records, references, rollups, rules, schema, series
from recordmill.plans import query as Q
from recordmill.sources import records as sources
from recordmill.streaming import journal


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_first_and_last_win(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 2, None), (None, 5, "n"), (None, 4, "m")], "k int, o int, v string")
    assert rows(records.first_wins(df, ["k"], [F.col("o")])) == sorted([(1, 1, "a"), (None, 4, "m")], key=repr)
    assert rows(records.last_wins(df, ["k"], [F.col("o")])) == sorted([(1, 3, "c"), (None, 5, "n")], key=repr)


def test_disambiguation_is_stable(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1)], "n string, c int")
    made = lambda d: rows(records.disambiguated(d, F.col("n"), ["n", "c"]), "n", "c", "uid")
    assert made(df) == made(df.orderBy(F.desc("c")).repartition(3)) and len({u for _, _, u in made(df)}) == 4


def test_upsert_twice_changes_nothing(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    incoming = spark.createDataFrame([(2, "B"), (3, None)], "k int, v string")
    assert rows(records.upsert_status(incoming, stored, "k", ["v"])) == sorted([(1, "kept"), (2, "updated"), (3, "created")], key=repr)
    after = records.upserted(incoming, stored, "k")
    assert {s for _, s in rows(records.upsert_status(incoming, after, "k", ["v"]))} == {"exists", "kept"}
    assert rows(records.upserted(incoming, after, "k")) == rows(after)


def test_pages(spark):
    df = spark.range(10)
    assert [r.id for r in records.page(df, [F.col("id")], 3, -5).collect()] == [0, 1, 2] and records.page(df, [F.col("id")], 0).count() == 0
    assert [r.id for r in records.page(df, [F.desc("id")], 2, 9).collect()] == [0]


def test_references(spark):
    df = spark.createDataFrame([("t1", "c1", ["d1", "d9"]), ("t2", None, []), ("t3", "d1", None)], "id string, cell string, ds array<string>")
    store = spark.createDataFrame([("c1", "cell"), ("d1", "dataset")], "target string, kind string")
    found = references.links(df, "id", {"cell_id": (F.col("cell"), "cell")}, {"dataset_ids": (F.col("ds"), "dataset")})
    assert rows(references.missing(found, store), "id", "path", "target") == [("t1", "dataset_ids[1].id", "d9")]
    assert rows(references.mistyped(found, store), "id", "expected", "actual") == [("t3", "cell", "dataset")]


def test_aliases(spark):
    entries = spark.createDataFrame([(0, "graphite", "Graphite", "C6"), (1, "silicon", "Si", "c6 "), (2, "x", None, None)], "pos int, key string, label string, alias string")
    table = references.alias_table(entries, "key", ["key", "label", "alias"])
    asked = spark.createDataFrame([(" C6",), ("si",), ("?",), (None,)], "q string")
    assert rows(references.resolve(asked, "q", table), "q", "resolved") == sorted([(" C6", "graphite"), ("si", "silicon"), ("?", "?"), (None, None)], key=repr)


def test_rules_and_policies(spark):
    df = spark.createDataFrame([(1, 5.0), (2, float("nan")), (3, None)], "id int, v double")
    found = rules.issues(df, "id", [rules.Rule("big", "error", "v", F.col("v") > 4, "too big"), rules.Rule("value_not_finite", "error", "v", rules.not_finite(F.col("v")), "nan")])
    assert rows(found, "id", "code") == [(1, "big"), (2, "big"), (2, "value_not_finite")]
    assert rules.severities(found).first().n_errors == 3 and rules.severities(found.limit(0)).first().ok
    assert {r.severity for r in rules.under_policy(found, "semantic", "default").collect()} == {"warning"} == {r.severity for r in rules.under_policy(found, "references", "ingest").collect()}
    assert {r.severity for p in rules.POLICIES for r in rules.under_policy(found, "publication", p).collect()} == {"error"}
    assert rules.rendered(found).where("id = 2").first().text == "[error] v: too big\n[error] v: nan"


def test_paired_ranges(spark):
    values = spark.createDataFrame([(1, "a", 5.0, "C"), (1, "b", 4.0, "C"), (2, "a", 5.0, "C"), (2, "b", 4.0, "K"), (3, "a", 1.0, "C")], "id int, property string, value double, unit string")
    assert rows(rules.paired(values, [("a", "b")]), "id", "message") == [(1, "a > b")]


def test_completeness(spark):
    have = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p"), ("y", None)], "g string, i string")
    assert rows(rollups.completeness(have, "g", "i", {"one": ["p"], "two": ["q", "p"], "none": []}), "g", "tier", "satisfied", "missing") == [("x", "one", True, []), ("x", "two", True, []), ("y", "one", True, []), ("y", "two", False, ["q"])]
    sided = spark.createDataFrame([("x", "material_negative", "a"), ("x", "material", "b"), ("x", "separator", "s")], "g string, s string, i string")
    got = rollups.sided_completeness(sided, "g", "s", "i", {"t": {"material": ["a"], "separator": ["s"]}}).first()
    assert not got.satisfied and got.missing == {"material_positive": ["a"]}


def test_conformance(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, "x")], "k int, v double, w string")
    b = spark.createDataFrame([(1, 1.05, None), (2, 2.0, None)], "k int, v double, w string")
    assert rows(rollups.conformance(a, b, "k", ["v", "w"])) == [(1, ["v"]), (2, ["w"])]
    assert rows(rollups.conformance(a, b, "k", ["v", "w"], 0.1)) == [(2, ["w"])]


def issue_codes(spark, columns, rows_, made):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows_)], "i int, " + columns)
    out = {}
    for r in rules.issues(df, "i", made).collect():
        out.setdefault(r.id, set()).add((r.code, r.severity))
    return [out.get(i, set()) for i in range(len(rows_))]


def test_size_codes(spark):
    codes = [("R26650", "cylindrical"), ("P20/50/50", "pouch"), ("P20-50-50", " Prismatic "), ("CR2032", "coin"), ("R2032", "pouch"), ("P1", "coin"), ("R1", "other"), (" ", "coin"), (None, "coin"), ("P2", None)]
    invalid, mismatch = {("size_code_invalid", "error")}, {("size_code_prefix_mismatch", "error")}
    got = issue_codes(spark, "c string, f string", codes, schema.size_code_rules(F.col("c"), F.col("f"), "error"))
    assert got == [set(), set(), set(), invalid, mismatch, mismatch, set(), set(), set(), set()]


def test_electrode_families(spark):
    cells = [("half_cell", True, False, False), ("Full_Cell", True, False, True), (None, False, True, False), (None, False, True, True), (None, True, False, True), ("three-electrode", True, True, True), ("half-cell", False, True, False), (None, False, False, True)]
    role, polarity, mixed = ({(f"electrode_{x}", "warning")} for x in ("role_expected", "polarity_expected", "holders_mixed"))
    got = issue_codes(spark, "c string, p boolean, r boolean, x boolean", cells, schema.electrode_rules(*map(F.col, "cprx")))
    assert got == [role, set(), polarity, set(), role, mixed, set(), set()]


def test_kinds(spark):
    got = issue_codes(spark, "k string", [("Graphite ",), (" ",), (None,), ("stone",)], schema.kind_rules(F.col("k"), ["graphite"], "material", "error"))
    missing, unknown = {("material_kind_missing", "error")}, {("material_kind_unknown", "error")}
    assert got == [set(), missing, missing, unknown]


def test_series_of_the_most_rows_stay_whole(spark):
    df = spark.createDataFrame([(k, o) for k, n in ((1, 5), (2, 6), (3, 11)) for o in range(n)], "k int, o int")
    kept = [(r.k, r.o) for r in series.downsample(df, "k", ["o"], 5).orderBy("k", "o").collect()]
    assert kept == [(1, o) for o in range(5)] + [(2, 0), (2, 2), (2, 4)] + [(3, 0), (3, 3), (3, 6), (3, 9)]


def test_predicates_reach_the_scan(spark, small):
    def pushed(table, condition):
        plan = spark.read.parquet(f"{small}/{table}.parquet").where(condition)._jdf.queryExecution().executedPlan().toString()
        return plan.split("PushedFilters: [")[1].split("]")[0]

    from recordmill.functions import predicates as P

    assert "EqualTo(o_orderkey,7)" in pushed("orders", P.equals(F.col("o_orderkey"), 7)) and "In(o_orderstatus" in pushed("orders", P.one_of(F.col("o_orderstatus"), ["F", "P"]))
    both = pushed("part", P.in_range(F.col("p_size"), 5, 45, nan=False))
    assert "GreaterThanOrEqual(p_size,5)" in both and "LessThanOrEqual(p_size,45)" in both and "GreaterThanOrEqual(s_acctbal" in pushed("supplier", P.in_range(F.col("s_acctbal"), 1000, 6000))


def test_series(spark):
    df = spark.createDataFrame([(1, i, None if i in (0, 9) else float(i)) for i in range(10)], "k int, o int, v double")
    assert rows(series.first_last(df, "k", "v", ["o"])) == [(1, 1.0, 8.0)]
    assert [r.o for r in series.downsample(df, "k", ["o"], 4).orderBy("o").collect()] == [0, 3, 6, 9]
    moved, unknown = series.renamed(df, {"v": "voltage_volt", "z": "current"})
    assert moved.columns == ["k", "o", "voltage_volt"] and unknown == ["z"] and series.lost_columns(["k", "gone", "v"], moved, {"v": "voltage_volt"}) == ["gone"]
    files = spark.createDataFrame([("a/x.csv",), ("a/x.bdf.parquet",), ("a/y.nda",)], "path string")
    assert rows(series.raw_with_converted(files)) == sorted([("a/x.csv", "a/x.bdf.parquet"), ("a/y.nda", None)], key=repr)
    assert series.infer_test_kind(["Cycle_Count", "V"], [("capacity", ["capacity"]), ("cycling", ["cycle"])]) == "cycling"


def test_graph(spark):
    df = spark.createDataFrame([("n1", 'say "hi"\n', "r1"), ("n2", None, None)], "id string, name string, region string")
    g = graph.triples(df, F.col("id"), "Nation", {"name": F.col("name")}, {"in": F.col("region")})
    assert g.count() == 4
    assert r'\"hi\"\n" .' in {r.value for r in graph.n_triples(g).collect() if "name" in r.value}.pop()
    assert rows(graph.deep_references(spark.createDataFrame([(1, '{"a": [{"spec_id": "x"}], "spec_id": "y"}')], "id int, d string"), "id", "d", ["spec_id"])) == [(1, "spec_id", "x"), (1, "spec_id", "y")]


def test_folding_nested_loops(spark):
    program = [(1, i, m, t, c) for i, (m, t, c) in enumerate([("a", None, None), ("b", None, None), ("loop", 1, 2), ("c", None, None), ("loop", 0, 3)])]
    got = importers.folded(spark.createDataFrame(program, "program int, position int, mode string, target int, count int"))
    assert [(r.path, r.mode, r.repeats) for r in got.orderBy("path").collect()] == [("0.0", "a", [3]), ("0.1.0", "b", [3, 2]), ("0.2", "c", [3])]


def test_group_files(spark):
    names = spark.createDataFrame([("ch01_25C",), ("ch02_25C",)], "n string")
    assert rows(importers.grouped_files(names, "n", [r"(?i)ch0*(\d+)"])) == [("ch01_25C", 1), ("ch02_25C", 2)]
    assert importers.grouped_files(names, "n", [r"x(\d+)"]).count() == 0 and importers.grouped_files(names.limit(0), "n", [r"(\d+)"]).count() == 0


def test_import_is_idempotent(spark):
    df = spark.createDataFrame([(1, "M", "X", "LFP", "2.5", "100"), (2, "NA", "Y", "LFP", "nr", "unk")], "id int, maker string, model string, cathode string, cap string, cyc string")
    made = lambda d: importers.from_rows(d, F.col("id"), F.col("maker"), F.col("model"), {"cathode": F.col("cathode")}, F.col("cap"), F.col("cyc"))
    a, b = made(df), made(df.repartition(2))
    assert {k: rows(v) for k, v in a.items()} == {k: rows(v) for k, v in b.items()}
    assert a["material-spec"].count() == 1 and a["test"].count() == 1 and a["cell-spec"].where("manufacturer = 'unknown'").count() == 1


def test_store_and_queries(spark, tmp_path):
    spec = lambda i, model, maker: {"cell_spec": {"id": i, "name": model, "model": model, "manufacturer": maker, "cell_format": "coin", "chemistry": "li-ion", "positive_electrode_basis": None, "negative_electrode_basis": None, "size_code": None, "country_of_origin": None}, "properties": {"nominal_capacity": {"value": float(len(model)), "value_typical": None, "value_max": None, "value_min": None}}}
    for n, record in enumerate([spec("s1", "ANR26650", "A123"), spec("s2", "MJ1", "LG Chem"), spec("s1", "again", "A123")]):
        sources.write_document(f"{tmp_path}/cell-spec/{n}.json", record)
    sources.write_document(f"{tmp_path}/cell-instance/a.json", {"cell_instance": {"id": "c1", "short_id": "abc", "cell_spec_id": "s1", "serial_number": "S", "batch_id": "B"}, "datasets": [{"id": "d1"}]})
    schema = "cell_spec struct<id:string,name:string,model:string,manufacturer:string,cell_format:string,chemistry:string,positive_electrode_basis:string,negative_electrode_basis:string,size_code:string,country_of_origin:string>, properties map<string,struct<value:double,value_typical:double,value_max:double,value_min:double>>"
    from pyspark.sql.types import StructType

    store = sources.read_store(spark, str(tmp_path)) | {"cell-spec": sources.read_kind(spark, str(tmp_path), "cell-spec", StructType.fromDDL(schema))}
    assert [r.id for r in Q.query(store, "cell_specs").collect()] == ["s1", "s2"]
    assert [r.id for r in Q.query(store, "cell-spec", manufacturer="lg").collect()] == ["s2"]
    assert [r.id for r in Q.query(store, "cell_specs", properties={"nominal_capacity": (5, None)}).collect()] == ["s1"]
    assert [r.id for r in Q.query(store, "cell_instances", has_dataset=True, dataset_id="d1", short_id="AB").collect()] == ["c1"]
    assert Q.resolve_one(store, "mj1") == "s2"
    with pytest.raises(ValueError):
        Q.resolve_one(store, "none")
    with pytest.raises(ValueError):
        Q.query(store, "nothing")
    with pytest.raises(ValueError):
        Q.query(store, "cell_specs", wrong=1)


def test_sources(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_bytes(b"\xef\xbb\xbfid,t\n1,\"two\nlines\"\n")
    (tmp_path / "csv" / "b.csv").write_bytes("id,t\n2,é\n".encode("cp1252"))
    assert rows(sources.read_csv_any_encoding(spark, str(tmp_path / "csv"), ["id", "t", "x"]), "id", "t", "x") == [("1", "two\nlines", None), ("2", "é", None)]
    (tmp_path / "g.json").write_text(json.dumps({"@graph": [{"@id": "a", "@type": "T"}, {"@id": "b", "@type": ["U", "V"]}]}))
    assert rows(sources.graph_nodes(spark, str(tmp_path / "g.json")), "id", "types") == [("a", ["T"]), ("b", ["U", "V"])]
    assert {r.role for r in sources.inventory(spark, str(tmp_path / "csv"), {".csv": "table"}).collect()} == {"table"}
    old = spark.createDataFrame([(None, "x"), ("n", "y")], "short_id string, shortId string")
    assert rows(sources.canonical(old)) == [("n",), ("x",)]
    both = spark.createDataFrame([(None, ("t",)), (("c",), ("t",))], "cell_spec struct<id:string>, test struct<id:string>")
    assert [r.k for r in both.select(sources.kind_of(both).alias("k")).collect()] == ["test", "cell-spec"]


def test_streams(spark, tmp_path):
    entries = tmp_path / "in"
    entries.mkdir()
    (entries / "1.json").write_text('{"id": 1, "v": "a"}\n{"id": 2, "v": "b"}\n{"id": 3, "v')
    table, mark = str(tmp_path / "table"), str(tmp_path / "mark")
    read = lambda: journal.read_journal(spark, str(entries), "id long, v string")
    journal.upsert_stream(read(), table, "id", ["v"], mark).awaitTermination()
    assert rows(journal.current(spark, table), "id", "v") == [(1, "a"), (2, "b")]
    (entries / "2.json").write_text('{"id": 2, "v": "B"}\n')
    journal.upsert_stream(read(), table, "id", ["v"], mark).awaitTermination()
    assert rows(journal.current(spark, table), "id", "v") == [(1, "a"), (2, "B")]
    once = journal.once_each(read(), ["id"]).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.sql("select count(*) from once").first()[0] == 2


def test_leaves_of_any_document(spark):
    texts = ['{"a": [{"b_id": "x\\"y"}, null, true], "c": NaN, "t": "\\"b_id\\": \\"no\\""}', "3", "[]", "no json", "", None, '{"a":' * 500 + '{"b_id":"deep"}' + "}" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, d string")
    found = rows(graph.leaves(df, "id", "d").where("id < 6"))
    assert found == sorted([(0, "a[0].b_id", "b_id", "text", 'x"y'), (0, "a[1]", None, "nothing", None), (0, "a[2]", None, "flag", "true"), (0, "c", "c", "number", "nan"), (0, "t", "t", "text", '"b_id": "no"'), (1, "", None, "number", "3")], key=repr)
    assert rows(graph.deep_references(df, "id", "d", ["b_id"])) == [(0, "b_id", 'x"y'), (6, "b_id", "deep")]
    assert [r.code for r in rules.leaf_issues(df, "id", "d").collect()] == ["value_not_finite"]
    assert rules.leaf_issues(df.limit(0), "id", "d").count() == 0


def test_publication_of_odd_documents(spark):
    texts = [None, "no json", "[]", '{"@graph": []}', '{"@graph": [1, "x"]}', '{"@id": "", "@type": "dcat:Catalog", "schema:license": ""}', '{"@id": 5}',
             '{"@id": "a", "@type": ["schema:Dataset"], "schema:about": {"@id": "b"}, "schema:distribution": [3, {"schema:contentUrl": "http://", "schema:encodingFormat": null, "schema:isPartOf": {}}]}',
             '{"@graph": [{"@id": "a"}, {"@id": "a"}, {"@id": "a", "@type": "prov:Plan", "schema:additionalProperty": [{"schema:propertyID": "g"}]}]}', '{"@id": "s/dataset/1", "@type": "schema:Dataset", "schema:about": [{"@id": "s/none"}, "s"]}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, d string")
    found = [(r.id, r.code.removeprefix("publication."), r.path) for r in publication.issues(df, "id", "d", "s/", "s/dataset/", ["g"]).collect()]
    assert sorted(found) == sorted([
        *[(i, "node_missing", "") for i in range(5)], (5, "node_missing_id", "@id"), (5, "license_missing", ""), (6, "node_missing_id", "@id"), (7, "reference_invalid", "schema:about"),
        (7, "distribution_invalid", "schema:distribution[0]"), (7, "distribution_url_invalid", "schema:distribution[1].schema:contentUrl"), (7, "distribution_parent_invalid", "schema:distribution[1].schema:isPartOf"),
        (8, "duplicate_node_id", "@graph[1].@id"), (8, "duplicate_node_id", "@graph[2].@id"), (8, "test_condition_unmapped", "@graph[2].schema:additionalProperty"), (9, "reference_invalid", "schema:about[1]"),
    ])
    assert publication.issues(df.limit(0), "id", "d", "s/", "s/").count() == 0


def test_save_modes(spark):
    incoming = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (None, "n")], "k int, v string")
    stored = spark.createDataFrame([(1, "a"), (2, "x"), (9, "z")], "k int, v string")
    errors, links = spark.createDataFrame([(4,)], "id int"), spark.createDataFrame([(3, 4), (2, 9), (1, None)], "id int, target int")
    say = lambda **how: [tuple(r) for r in records.save_outcomes(incoming, stored, "k", ["v"], errors, links, **how).orderBy("k").collect()]
    broken = [(3, "failed", "reference"), (4, "failed", "invalid")]
    assert say() == [(1, "exists", None), (2, "updated", None), *broken]
    assert say(mode="create_only") == [(1, "failed", "duplicate"), (2, "failed", "duplicate"), *broken]
    assert say(mode="create_only", on_duplicate="return_existing") == [(1, "exists", None), (2, "exists", None), *broken]
    assert say(dry_run=True) == [(1, "dry-run", None), (2, "dry-run", None), *broken]
    outcomes = records.save_outcomes(incoming, stored, "k", ["v"], errors, links)
    assert rows(records.saved(incoming, stored, "k", outcomes)) == [(1, "a"), (2, "b"), (9, "z")]


def test_files_of_one_path_stay_apart(spark):
    paths = ["raw/run-abc123.csv", "raw/run-abc123.csv", "raw/TEST_cell7_01.nda", "raw/TEST_cell7_01.nda", "raw/other.csv", "raw/other.csv", None]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    cells = spark.createDataFrame([(3, "ABC123", "s3"), (5, "abc123", "s5"), (7, "zzzzzz", "Cell7")], "cell int, short string, serial string")
    want = [(paths[0], 3)] * 2 + [(paths[2], 7)] * 2 + [(paths[4], None)] * 2 + [(None, None)]
    assert rows(references.matched_files(files, "path", cells, "cell", "short", "serial")) == sorted(want, key=repr)
