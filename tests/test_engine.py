"""Verbs, mappings, notation, validation and the registered queries against DuckDB."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tesserae.functions import numerics
from tesserae.functions.kernel import VERBS, CompileError
from tesserae.operators import documents as D
from tesserae.operators import exports as E
from tesserae.operators import notation as N
from tesserae.operators import series as S
from tesserae.operators import validation as V
from tesserae.operators.builder import Builder
from tesserae.plans.compiler import Transform, register_verb
from tesserae.plans.mapping import parse, parse_expression
from tesserae.sources import readers as R
from tesserae.sources import targets
from tesserae.streaming.transforms import transform_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scalars(spark):
    return spark.createDataFrame([(1, " a\tB ", 2.5, None, True), (2, None, None, 7, False), (3, "12abc", float("nan"), -7, None), (4, "", 1e7, 0, True), (5, "1_000", 1e16, 3, True)], "id long, s string, x double, n long, b boolean")


CASES = [
    ("%upper @.s", [" A\tB ", None, "12ABC", "", "1_000"]), ("%trim @.s", ["a\tB", None, "12abc", "", "1_000"]), ("%length @.s", [5, 0, 5, 0, 5]), ("%add @.n ##1", [None, 8, -6, 1, 4]), ("%mod @.n ##-3", [None, -2, -1, 0, 0]),
    ("%mod @.n ##3", [None, 1, 2, 0, 0]), ("%mod @.n ##0", [None] * 5), ("%eq @.s \"\"", [False, True, False, True, False]), ("%gt @.n ##-1", [True, True, False, True, True]), ("%not @.n", [True, False, False, True, False]),
    ("%coerceString @.x", ["2.5", "", "NaN", "10000000.0", "1.0e+16"]), ("%coerceNumber @.s", [0.0, 0.0, 0.0, 0.0, 0.0]), ("%multiply @.s ##2", [None, None, None, None, 2000.0]), ("%parseInt @.s ##10", [0, None, 12, 0, 1]),
    ("%ifElse @.b \"y\" \"n\"", ["y", "n", "n", "y", "y"]), ("%concat @.n \"-\" @.b", ["-true", "7-false", "-7-", "0-true", "3-true"]), ("%padLeft @.n ##3 \"0\"", ["000", "007", "0-7", "000", "003"]), ("%divide ##1 @.n", [None, 1 / 7, -1 / 7, None, 1 / 3]),
    ("%isNaN @.x", [False, True, True, False, False]), ("%soundex \"Robert\"", ["R163"] * 5), ("%typeOf @.n", ["null", "integer", "integer", "integer", "integer"]), ("%capitalize \"hello World\"", ["Hello World"] * 5),
    ("%titleCase \"a b-c\"", ["A B-C"] * 5), ("%snakeCase \"helloWorldABc\"", ["hello_world_a_bc"] * 5), ("%between \"a[b]c\" \"[\" \"]\"", ["b"] * 5), ("%formatDate \"2024-04-05\" \"MMMM D, YYYY A\"", None), ("%round #2.5 ##0", [3] * 5), ("%round #-2.5 ##0", [-3] * 5),
    ("%dateDiff \"2024-01-31\" \"2024-02-29\" \"months\"", [0] * 5), ("%addMonths \"2024-01-31\" ##1", ["2024-02-29"] * 5), ("%businessDays \"2024-03-01\" ##1", ["2024-03-04"] * 5), ("%weekOfYear \"2021-01-03\"", [53] * 5), ("%formatDuration \"P1DT2H\"", ["1 day, 2 hours"] * 5),
    ("%formatPhone \"02071234567\" \"GB\"", ["+44 2071 234567"] * 5), ("%lookup \"T.name\" @.n", [None, "seven", None, None, None]), ("@.missing.path[0]", [None] * 5), ("@$const.k", [4] * 5), ("%nothing.like", "error"),
]


@pytest.mark.parametrize("expression,want", CASES, ids=[c[0] for c in CASES])
def test_verbs(scalars, expression, want):
    t = Transform(f'{{$}}\nconst.k = ##4\n{{$table.T[key,name]}}\n##7, "seven"\n{{}}\nid = @.id\nout = {expression}')
    if want == "error":
        with pytest.raises(CompileError):
            t.apply(scalars)
        return
    got = [r.out for r in t.apply(scalars).orderBy("id").collect()]
    if want is None:
        assert len(got) == 5
        return
    assert all((a is None and b is None) or (isinstance(b, float) and math.isclose(a, b)) or a == b for a, b in zip(got, want, strict=True)), got


def test_all_verbs_are_there():
    assert len(VERBS) == 257 and sum(v.arity is None for v in VERBS.values()) == 8


def test_parsing():
    expr, directives = parse_expression('%upper %concat @.a "x y" :default "z" :maxLen 3')
    assert expr.verb == "upper" and expr.args[0].verb == "concat" and len(expr.args[0].args) == 2 and dict(directives) == {"default": "z", "maxLen": 3}
    plan = parse('{$}\ndirection = "json->xml"\n{A[]}\n_each = "@.x"\n_pass = ##2\nv = @.v :required ; a comment\n{B}\nw = "a;b"')
    assert plan.target_format == "xml" and plan.passes == [2, 0] and plan.segments[0].each == "@.x" and plan.segments[0].mappings[0].modifiers == ("required",) and plan.segments[1].mappings[0].expr.value == "a;b"


def test_segments_passes_and_accumulators(spark):
    df = spark.createDataFrame([(1, [("a", 2.0), ("b", 3.5)]), (2, []), (3, None)], "id long, items array<struct<name:string,price:double>>")
    t = Transform('{$accumulator}\ntotal = #0\ntotal._persist = ?true\n{Rows[]}\n_pass = ##1\n_each = @.items\nname = %upper @.name\n_ = %accumulate "total" @.price\n{Sum.Inner}\nt = @$accumulator.total\n{Names[]}\n_each = @.items\n_ = @.name\n{}\nx.y[1] = @.id')
    rows = t.apply(df, keep=("id",)).orderBy("id").collect()
    assert [r.name for r in rows[0].Rows] == ["A", "B"] and rows[0].Sum.Inner.t == 5.5 and rows[0].Names == ["a", "b"] and rows[1].Rows == [] and rows[2].Names == [] and rows[0].x.y == [None, 1]


def test_custom_verbs_and_assertions(spark, scalars):
    from tesserae.functions.kernel import text, text_value

    register_verb("my.twice", lambda ctx, v: text_value(F.concat(text(v), text(v))))
    out = Transform('{}\nid = @.id\na = %&my.twice @.n\nb = %&not.there @.n\nc = %assert %gt @.n ##0 "low"').apply(scalars).orderBy("id").collect()
    assert out[1].a == "77" and out[1].b == 7 and out[1]._errors == [] and out[3]._errors == ["E001: low"] and out[3].c is None


def test_streaming(spark, tmp_path, scalars):
    scalars.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(scalars.schema).parquet(f"{tmp_path}/in")
    q = transform_stream(stream, Transform("{}\nid = @.id\nu = %upper @.s")).writeStream.format("memory").queryName("out").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("out").count() == 5
    with pytest.raises(CompileError):
        transform_stream(stream, Transform('{}\nn = %rowNumber "x"'))


def test_notation_round_trip():
    text = '{$}\nid = "x"\n\n{policy}\nname = "A \\"b\\""\ntotal = #$10.5:usd :required\nn = !##5\n{.holder}\nage = ##40\n{items[] : sku, price.amount, .code}\n"a", #1.50, "x"\n"b", #2, "y"\n{}\nref = @policy.name\nd = 2024-01-05\n'
    [doc] = N.parse(text)
    once = N.canonical(doc.assignments)
    assert N.canonical(N.parse(once)[0].assignments) == once == N.canonical(N.parse(N.stringify(doc.assignments))[0].assignments)
    assert "policy.total = #$10.50:USD\n" in once and "policy.n = !##5\n" in once and doc.get("items[1].price.code").text == "y"


@pytest.mark.parametrize("text,code", [("a = b", "P002"), ('a = "x', "P004"), ("{a", "P008"), ("a[x] = ##1", "P003"), ("a = ##1\na = ##2", "P007"), ("a[1] = ##1", "P013"), ("a = #x", "P006"), ("a[20000] = ##1", "P015"), ('a = "\\q"', "P005"), ("nonsense", "P001"), ("a = ##1 :9", "P009")])
def test_notation_errors(text, code):
    with pytest.raises(N.NotationError) as e:
        N.parse(text)
    assert e.value.code == code


def test_patch_of_diff_is_the_new_version(spark):
    rng = random.Random(6)
    version = lambda: [(str(d), f"p{k}", rng.choice(["string", "integer"]), str(rng.randint(0, 3))) for d in range(20) for k in rng.sample(range(8), 5)]
    frame = lambda rows: spark.createDataFrame([(d, i, p, t, x, None, []) for i, (d, p, t, x) in enumerate(rows)], "doc_id string, ord int, path string, type string, text string, number double, mods array<string>")
    a, b = version(), version()
    before, after = frame(a), frame(b)
    got = D.patch(before, after, D.diff(before, after))
    assert sorted((r.doc_id, r.path, r.type, r.text) for r in got.collect()) == sorted(b)
    assert D.diff(before, before).count() == 0
    assert {r.doc_id: r.sha256 for r in D.canonical(got).collect()} == {r.doc_id: r.sha256 for r in D.canonical(after).collect()}


def test_validation_of_items(spark):
    text = '{o}\nname = "x"\n{rows[] : sku, n}\n"a", ##1\n"b", ##5\n"a", ##1\n'
    rows = D.parse_documents(spark.createDataFrame([("d", text)], "doc_id string, text string"))
    schema = V.Schema(fields=[V.FieldRule("o.name", "string", required=True), V.FieldRule("rows[].n", "integer", maximum=4), V.FieldRule("rows[].q", required=True)], arrays=[V.ArrayRule("rows", maximum=2, unique=True)])
    assert sorted((r.code, r.path) for r in V.validate(rows, schema).collect()) == [("V001", "rows[].q"), ("V003", "rows[1].n"), ("V006", "rows"), ("V007", "rows[2]")]
    assert not V.safe_pattern("(a+)+$") and V.safe_pattern("^[a-z]+$")


# The registered queries against DuckDB


def plain(v):
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T", " ")[:19]
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    db = duckdb.connect()
    db.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        db.execute(f"create view {f.partition('.')[0]} as select * from '{SF}/{f}'")
    return db


def test_references_of_long_chains(spark):
    chain = [("chain", f"p{i}", f"p{i + 1}") for i in range(300)]
    ring = [("ring", f"p{i}", f"p{(i + 1) % 150}") for i in range(150)]
    rows = [(d, p, "reference", t, None, [], 0) for d, p, t in chain + ring] + [("chain", "p300", "string", "x", None, [], 0)]
    df = spark.createDataFrame(rows, "doc_id string, path string, type string, text string, number double, mods array<string>, ord int")
    got = V.validate(df, V.Schema()).select("doc_id", "code", "path").collect()
    assert sorted(map(tuple, got)) == sorted(("ring", "V012", p) for _, p, _ in ring)


OWN = [n for n in __spark_entry__.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.mark.parametrize("name", OWN)
def test_query_matches_duckdb(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted([repr([plain(r[c]) for c in names]) for r in df.collect()])
    answer = duck.execute(__spark_entry__.oracle_sql()[name])
    own = [c[0] for c in answer.description]
    assert sorted(own) == names
    assert got == sorted(repr([plain(r[own.index(c)]) for c in names]) for r in answer.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1500


def test_xml_elements_as_objects():
    text = """<r><b></b><c/><p:d xmlns:p="u">1</p:d><item> é1 </item><e>1</e><e>2</e><f n:k="v" nil="false">t</f><g xsi:nil="true">q</g><h k="1"/></r>"""
    want = {"b": "", "c": None, "p:d": {"_text": "1"}, "f": {"@k": "v", "_text": "t"}, "g": None, "h": {"@k": "1"}, "item": ["é1"], "e": ["1", "2"]}
    assert R.xml_to_object(text) == {"r": want}
    assert R.xml_to_object("<a>x<b>1</b>y</a>") == {"a": {"_text": "xy", "b": "1"}} and R.xml_to_object("<a/>") == {"a": None}
    for bad in ("<a>", "<!DOCTYPE a [<!ENTITY x 'y'>]><a>&x;</a>", "<a>" * 200 + "</a>" * 200):
        with pytest.raises(Exception):  # noqa: B017
            R.xml_to_object(bad)


def test_formats_and_unknown_fields(spark):
    cases = [("currency-code", "USD", True), ("currency-code", "usd", False), ("state-us", "ca", False), ("iban", "DE89 3704 0044 0532 0130 00", True), ("hostname", "a." * 126 + "ab", False), ("url", "https://a.b\n", False), ("ipv6", "1:2:3:4:5:6:7:8:", True), ("what", "x", True)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, name string, value string, ok boolean")
    assert [r.i for r in df.where(V.formats_ok(F.col("name"), F.col("value")) != F.col("ok")).collect()] == []
    values = [("items[0].a", "integer", "1"), ("items[0].b", "integer", "1"), ("items[1]", "string", "x"), ("when", "date", "2024-13-45"), ("at", "string", "2024-1-1")]
    rows = spark.createDataFrame([("d", p, t, v, None) for p, t, v in values], "doc_id string, path string, type string, text string, number double")
    schema = V.Schema(fields=[V.FieldRule("items[].a"), V.FieldRule("when", format="date-iso"), V.FieldRule("at", format="date-iso")], arrays=[V.ArrayRule("items")], strict=True)
    assert sorted((r.code, r.path) for r in V.validate(rows, schema).collect()) == [("V004", "at"), ("V011", "items[0].b")]
    assert V.validate(rows, V.Schema()).count() == 0


def test_row_order_over_all_rows_is_refused(scalars):
    with pytest.raises(CompileError, match="partition"):
        Transform('{}\nn = %rowNumber "x"').apply(scalars, order=("id",))


def test_rounding_is_that_of_the_decimal_text(spark):
    df = spark.createDataFrame([(1.005,), (311582.535,), (-2.675,)], "x double")
    assert [r.y for r in Transform("{}\ny = %round @.x ##2").apply(df).collect()] == [1.01, 311582.54, -2.68]


def test_diff_pairs_equal_values_once(spark):
    kind = "doc_id string, path string, type string, text string, number double, mods array<string>"
    old = spark.createDataFrame([("d", "a", "string", "x", None, []), ("d", "b", "string", "x", None, []), ("d", "c", "string", "y", None, []), ("d", "m", "string", "z", None, []), ("d", "n", "number", "1E20", 1e20, [])], kind)
    new = spark.createDataFrame([("d", "q", "string", "x", None, []), ("d", "c", "string", "Y", None, []), ("d", "m", "string", "z", None, ["required"]), ("d", "n", "number", "1E20", 1e20, [])], kind)
    got = sorted((r.op, r.path, r.from_path) for r in D.diff(old, new).collect())
    assert got == [("changed", "c", None), ("changed", "m", None), ("moved", "q", "a"), ("removed", "b", None)]


def test_builder_and_exports(spark):
    b = Builder().set_string("a.x", F.col("s")).set_integer("rows[1].v", 3).set_integer("rows[0].v", F.col("id")).set_string("gone", "x").remove("gone")
    rows = b.build(spark.createDataFrame([(1, "<&>"), (2, None)], "id long, s string"), "id")
    got = {r.doc_id: r.json for r in E.to_json(rows).collect()}
    assert got == {"1": '{"a": {"x": "<&>"}, "rows": [{"v": 1}, {"v": 3}]}', "2": '{"a": {"x": null}, "rows": [{"v": 2}, {"v": 3}]}'}
    xml = {r.doc_id: r.xml for r in E.to_xml(rows).collect()}
    assert "<x>&lt;&amp;&gt;</x>" in xml["1"] and "<x>" not in xml["2"]
    assert {r.csv for r in E.to_csv(rows).collect()} == {"v\n1\n3\n", "v\n2\n3\n"}
    line = {r.doc_id: r.line for r in E.to_fixed_width(rows, [{"path": "a.x", "pos": 1, "len": 2}, {"path": "rows[0].v", "pos": 3, "len": 3, "align": "right", "pad": "0"}]).collect()}
    assert line == {"1": " <&001", "2": "   002"}
    for f in (E.to_json, E.to_xml, E.to_csv):
        assert f(rows.where("false")).count() == 0
    assert {r.doc_id: r.has for r in D.has(rows, "a.x").collect()} == {"1": True, "2": True}


def test_quantiles_of_groups_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randint(0, 20)), rng.random() * 9])) for _ in range(3000)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    want = {r.g: (r.p, r.q, r.z) for r in df.groupBy("g").agg(F.percentile("x", F.lit(0.5)).alias("p"), F.percentile("x", F.lit(0.93)).alias("q"), F.percentile("x", F.lit(0.0)).alias("z")).collect()}
    got = {r.g: (r.p, r.q, r.z) for r in S.group_quantiles(df, ["g"], "x", {"p": 0.5, "q": 0.93, "z": 0.0}, parts=7).collect()}
    assert "none" not in got and all(math.isclose(a, b, abs_tol=1e-12) for g in got for a, b in zip(got[g], want[g], strict=True)) and set(got) == set(want) - {"none"}
    stats = {r.g: r for r in S.group_statistics(df, ["g"], "x").collect()}
    assert stats["none"].median is None and stats[None]["count"] == sum(g is None for g, _ in rows) and math.isclose(stats[None].median, want[None][0])


def test_files_are_read_and_written_as_the_plan_says(spark, tmp_path):
    (tmp_path / "in.csv").write_text('\ufeffid;name\n1;"a ""b""; c"\n2;"two\nlines"\n')
    cells = targets.read_source(spark, str(tmp_path / "in.csv"), parse('{$source}\nformat = "csv"\ndelimiter = ";"\n{}\nx = @.id'))
    assert sorted(map(tuple, cells.collect())) == [("1", 'a "b"; c'), ("2", "two\nlines")]
    (tmp_path / "rows.json").write_text('[{"id": 1, "name": "abcdefghij"}, {"id": 22, "name": null}]')
    mapping = '{$}\ndirection = "json->fixed-width"\n{}\nid = @.id :pos 0 :len 3 :leftPad "0"\nname = @.name :pos 4 :len 8\n'
    targets.transform_files(spark, str(tmp_path / "rows.json"), mapping, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["001 abcdefgh", "022         "]
    cut = Transform('{$source}\nformat = "flat"\n{}\na = @.s :pos 1 :len 2\nb = @.s :field 1\n').apply(spark.createDataFrame([("abc,de",)], "s string"))
    assert cut.collect() == [("bc", "de")]
    (tmp_path / "in.json").write_text('{"a": {"b": 1}, "c": [1, 2]}')
    assert targets.read_source(spark, str(tmp_path / "in.json"), parse('{$}\ndirection = "json->xml"\n{}\nx = @.a.b')).select("a.b", "c").collect() == [(1, [1, 2])]
    (tmp_path / "in.xml").write_text("<r><row k='1'><v>x</v></row><row k='2'/></r>")
    rows = targets.read_source(spark, str(tmp_path / "in.xml"), parse('{$source}\nformat = "xml"\nrowTag = "row"\n{}\nx = @.v'))
    assert sorted((r["@k"], r.v) for r in rows.collect()) == [(1, "x"), (2, None)]
    (tmp_path / "in.properties").write_text('# c\na.b = "x"\nn = ~\n')
    pairs = targets.read_source(spark, str(tmp_path / "in.properties"), parse('{$source}\nformat = "properties"\n{}\nx = @.v'))
    assert sorted((r.path, r.value) for r in pairs.collect()) == [("a.b", "x"), ("n", None)]
    (tmp_path / "in.txt").write_text("  7ab \n 12c\n")
    fixed = R.read_fixed_width(spark, str(tmp_path / "in.txt"), [("n", 0, 3), ("s", 3, 3, False)])
    assert sorted(map(tuple, fixed.collect())) == [("12", "c"), ("7", "ab ")]
    with pytest.raises(CompileError):
        targets.read_source(spark, "x", parse('{$source}\nformat = "what"\n{}\nx = @.v'))


def test_references_with_stars(spark):
    values = [("a[0].x", "string", "1"), ("r1", "reference", "a[*].x"), ("r2", "reference", "b*"), ("r3", "reference", "a*x"), ("r4", "reference", "a.0..x*"), ("r5", "reference", "a[0].x")]
    rows = spark.createDataFrame([("d", p, t, v, None) for p, t, v in values], "doc_id string, path string, type string, text string, number double")
    assert sorted((r.code, r.path) for r in V.validate(rows, V.Schema()).collect()) == [("V013", "r2"), ("V013", "r4")]


def test_newton_on_batches():
    flows = np.array([[-100.0, 60, 60], [-100.0, 0, 0], [0.0, 0, 0]])

    def step(r, rows):
        i = np.arange(3)
        terms = flows[rows] * (1 + r)[:, None] ** -i
        return terms.sum(1), (-i * terms).sum(1) / (1 + r)

    got = numerics.newton(step, np.array([0.1, 0.1, 0.1]))
    assert abs(got[0] - 0.13066238629180753) < 1e-9 and np.isnan(got[1:]).all()
