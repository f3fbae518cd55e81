"""Queries of the document model: assignments, canonical form, diff, patch, validation and named formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import exports as E
from ..operators import paths as P
from ..operators import validation as V
from ..operators.builder import Builder
from .mappings import read

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _before(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return D.assignments_of(df, "c_custkey")


def _after(spark, sf_dir):
    """The next version: some names changed, segments moved to another path, a flag added for some."""
    df = read(spark, sf_dir, "customer")
    base = df.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("c_name"), F.col("c_mktsegment").alias("segment"), "c_nationkey")
    flag = df.where("c_custkey % 5 = 0").select("c_custkey", F.lit("new").alias("flag"))
    return D.assignments_of(base, "c_custkey").unionByName(D.assignments_of(flag, "c_custkey"))


@query("""SELECT c_custkey::VARCHAR AS doc_id, 'c_mktsegment = "' || c_mktsegment || '"' || chr(10) || 'c_name = "' || c_name || '"' || chr(10) || 'c_nationkey = ##' || c_nationkey || chr(10) AS canonical,
    sha256('c_mktsegment = "' || c_mktsegment || '"' || chr(10) || 'c_name = "' || c_name || '"' || chr(10) || 'c_nationkey = ##' || c_nationkey || chr(10)) AS sha256 FROM customer""")
def document_canonical(spark, sf_dir):
    return D.canonical(_before(spark, sf_dir))


@query("""SELECT c_custkey::VARCHAR AS doc_id, 'changed' AS op, 'c_name' AS path, NULL AS from_path, '"' || c_name || '"' AS old, '"' || c_name || '!"' AS new FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey::VARCHAR, 'moved', 'segment', 'c_mktsegment', '"' || c_mktsegment || '"', '"' || c_mktsegment || '"' FROM customer
    UNION ALL SELECT c_custkey::VARCHAR, 'added', 'flag', NULL, NULL, '"new"' FROM customer WHERE c_custkey % 5 = 0""")
def document_diff(spark, sf_dir):
    return D.diff(_before(spark, sf_dir), _after(spark, sf_dir))


@query("""SELECT c_custkey::VARCHAR AS doc_id, 'c_name' AS path, c_name || CASE WHEN c_custkey % 3 = 0 THEN '!' ELSE '' END AS text FROM customer UNION ALL SELECT c_custkey::VARCHAR, 'segment', c_mktsegment FROM customer
    UNION ALL SELECT c_custkey::VARCHAR, 'c_nationkey', c_nationkey::VARCHAR FROM customer UNION ALL SELECT c_custkey::VARCHAR, 'flag', 'new' FROM customer WHERE c_custkey % 5 = 0""")
def document_patch(spark, sf_dir):
    before, after = _before(spark, sf_dir), _after(spark, sf_dir)
    return D.patch(before, after, D.diff(before, after)).select("doc_id", "path", "text")


@query("""SELECT 'c' || c_custkey AS doc_id, 'customer.name' AS path, 'string' AS type, c_name AS text FROM customer UNION ALL SELECT 'c' || c_custkey, 'customer.balance', 'number', NULL FROM customer
    UNION ALL SELECT 'c' || c_custkey, 'rows[0].a', 'integer', '1' FROM customer UNION ALL SELECT 'c' || c_custkey, 'rows[1].a', 'integer', '2' FROM customer""")
def document_parse(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    text = F.concat(F.lit('{customer}\nname = "'), "c_name", F.lit('"\nbalance = #'), F.format_string("%.2f", F.col("c_acctbal")), F.lit(" ; a comment\n{rows[] : a}\n##1\n##2\n"))
    got = D.parse_documents(df.select(F.concat(F.lit("c"), "c_custkey").alias("doc_id"), text.alias("text")))
    return got.select("doc_id", "path", "type", F.when(F.col("type") != "number", F.col("text")).alias("text"))


@query("SELECT c_custkey::VARCHAR AS doc_id, i::INT AS i, c_name AS name, (c_nationkey + i)::VARCHAR AS nation FROM customer, range(2) t(i)")
def document_export_table(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    cols = [c for i in range(2) for c in (F.col("c_name").alias(f"x[{i}].name"), (F.col("c_nationkey") + i).alias(f"x[{i}].nation"))]
    rows = df.select("c_custkey", *cols)
    safe = rows.toDF("c_custkey", "a", "b", "c", "d")
    a = D.assignments_of(safe, "c_custkey")
    names = F.create_map(*[F.lit(v) for pair in zip("abcd", rows.columns[1:], strict=True) for v in pair])
    return D.export_table(a.withColumn("path", names[F.col("path")]), "x", ["name", "nation"])


@query("SELECT n_nationkey::VARCHAR AS doc_id, 'n_name=' || n_name || chr(10) || 'n_regionkey=' || n_regionkey AS flat FROM nation")
def document_export_flat(spark, sf_dir):
    return D.export_flat(D.assignments_of(read(spark, sf_dir, "nation"), "n_nationkey"))


def _built(spark, sf_dir):
    """A document of each customer: metadata, a section, an array of two items, a null."""
    b = Builder().set_metadata("version", "string", "1").set_string("who.name", F.col("c_name"), ("required",)).set_integer("who.id", F.col("c_custkey")).set_string("gone", "x").set_null("note")
    for i in range(2):
        b.set_integer(f"rows[{i}].nation", F.col("c_nationkey") + i).set_string(f"rows[{i}].kind", F.when(F.col("c_custkey") % 2 == i, 'a "b", <c>'))
    b.set_currency("who.owes", F.col("c_custkey"), "EUR").set_boolean("ok", F.col("c_custkey") > 5).remove("gone")
    return b.build(read(spark, sf_dir, "customer"), "c_custkey")


@query("""SELECT c_custkey::VARCHAR AS doc_id, p AS path, t AS type, v AS text FROM customer, LATERAL (VALUES ('$.version', 'string', '1'), ('who.name', 'string', c_name), ('who.id', 'integer', c_custkey::VARCHAR), ('note', 'null', NULL),
    ('rows[0].nation', 'integer', c_nationkey::VARCHAR), ('rows[1].nation', 'integer', (c_nationkey + 1)::VARCHAR), ('rows[0].kind', CASE WHEN c_custkey % 2 = 0 THEN 'string' ELSE 'null' END, CASE WHEN c_custkey % 2 = 0 THEN 'a "b", <c>' END),
    ('rows[1].kind', CASE WHEN c_custkey % 2 = 1 THEN 'string' ELSE 'null' END, CASE WHEN c_custkey % 2 = 1 THEN 'a "b", <c>' END), ('who.owes', 'currency', c_custkey || '.00:EUR'), ('ok', 'boolean', (c_custkey > 5)::VARCHAR)) w(p, t, v)""")
def document_builder(spark, sf_dir):
    return _built(spark, sf_dir).select("doc_id", "path", "type", "text")


@query("""SELECT c_custkey::VARCHAR AS doc_id, '{"who": {"name": "' || c_name || '", "id": ' || c_custkey || ', "owes": ' || c_custkey || '}, "note": null, "rows": [{"nation": ' || c_nationkey || ', "kind": ' || CASE WHEN c_custkey % 2 = 0 THEN '"a \\"b\\", <c>"' ELSE 'null' END
    || '}, {"nation": ' || (c_nationkey + 1) || ', "kind": ' || CASE WHEN c_custkey % 2 = 1 THEN '"a \\"b\\", <c>"' ELSE 'null' END || '}], "ok": ' || (c_custkey > 5)::VARCHAR || ', "$": {"version": "1"}}' AS json FROM customer""")
def document_export_json(spark, sf_dir):
    return E.to_json(_built(spark, sf_dir))


_XML_ROW = """'  <rows_{i}_>' || chr(10) || '    <nation t:type="integer">' || (c_nationkey + {i}) || '</nation>' || chr(10)
    || CASE WHEN c_custkey % 2 = {i} THEN '    <kind>a &quot;b&quot;, &lt;c&gt;</kind>' || chr(10) ELSE '' END || '  </rows_{i}_>' || chr(10)"""


@query(f"""SELECT c_custkey::VARCHAR AS doc_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<root xmlns:t="urn:types">' || chr(10) || '  <who>' || chr(10) || '    <name t:required="true">' || c_name || '</name>' || chr(10)
    || '    <id t:type="integer">' || c_custkey || '</id>' || chr(10) || '    <owes t:type="currency" t:currencyCode="EUR">' || c_custkey || '.00</owes>' || chr(10) || '  </who>' || chr(10)
    || {_XML_ROW.format(i=0)} || {_XML_ROW.format(i=1)} || '  <ok t:type="boolean">' || (c_custkey > 5)::VARCHAR || '</ok>' || chr(10) || '</root>' || chr(10) AS xml FROM customer""")
def document_export_xml(spark, sf_dir):
    return E.to_xml(_built(spark, sf_dir), modifiers=True)


@query("""SELECT c_custkey::VARCHAR AS doc_id, 'nation,kind' || chr(10) || c_nationkey || ',' || CASE WHEN c_custkey % 2 = 0 THEN '"a ""b"", <c>"' ELSE '' END || chr(10) || (c_nationkey + 1) || ',' || CASE WHEN c_custkey % 2 = 1 THEN '"a ""b"", <c>"' ELSE '' END || chr(10) AS csv FROM customer""")
def document_export_csv(spark, sf_dir):
    return E.to_csv(_built(spark, sf_dir))


@query("""SELECT c_custkey::VARCHAR AS doc_id, rtrim(lpad(c_custkey::VARCHAR, 8, '0') || rpad(left(c_name, 10), 10, ' ') || '  ' || rpad(left((c_custkey > 5)::VARCHAR, 3), 3, ' ')) AS line FROM customer""")
def document_export_fixed(spark, sf_dir):
    columns = [{"path": "who.id", "pos": 0, "len": 8, "pad": "0", "align": "right"}, {"path": "who.name", "pos": 8, "len": 10}, {"path": "note", "pos": 18, "len": 2}, {"path": "ok", "pos": 20, "len": 3}]
    return E.to_fixed_width(_built(spark, sf_dir), columns)


@query("""SELECT n_nationkey, 'a.b[' || n_nationkey || '].c' AS built, ['a', 'b', '[' || n_nationkey || ']', 'c'] AS split, 'a.b[' || n_nationkey || ']' AS parent, 'c' AS leaf, 'a.b[].c' AS general, NULL AS no_parent FROM nation""")
def path_parts(spark, sf_dir):
    path = F.concat(F.lit("b["), F.col("n_nationkey"), F.lit("]"))
    df = read(spark, sf_dir, "nation").withColumn("built", P.build("a", F.lit(""), path, "c"))
    built = F.col("built")
    return df.select("n_nationkey", "built", P.split(built).alias("split"), P.parent(built).alias("parent"), P.leaf(built).alias("leaf"), P.general(built).alias("general"), P.parent(F.lit("a")).alias("no_parent"))


_SCHEMA = V.Schema(
    fields=[
        V.FieldRule("o_orderkey", "integer", required=True), V.FieldRule("o_totalprice", "number", minimum=1000, maximum=400000), V.FieldRule("o_orderstatus", "string", enum=("O", "F")), V.FieldRule("o_orderpriority", "string", pattern="^[1-4]-"),
        V.FieldRule("o_comment", "string", required=True, condition=("o_orderstatus", "=", "P", False)), V.FieldRule("o_custkey", "string"),
    ],
    invariants=[("", "o_totalprice", ">", "o_custkey")], cardinalities=[("", ("o_comment", "o_note"), 1, None)], arrays=[V.ArrayRule("items", minimum=1)], strict=True,
)


@query("""SELECT o_orderkey::VARCHAR AS doc_id, 'V003' AS code, 'o_totalprice' AS path FROM orders WHERE o_totalprice < 1000 OR o_totalprice > 400000 UNION ALL SELECT o_orderkey::VARCHAR, 'V005', 'o_orderstatus' FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
    UNION ALL SELECT o_orderkey::VARCHAR, 'V004', 'o_orderpriority' FROM orders WHERE o_orderpriority NOT SIMILAR TO '[1-4]-.*' UNION ALL SELECT o_orderkey::VARCHAR, 'V010', 'o_comment' FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT o_orderkey::VARCHAR, 'V002', 'o_custkey' FROM orders UNION ALL SELECT o_orderkey::VARCHAR, 'V008', '' FROM orders WHERE NOT o_totalprice > o_custkey UNION ALL SELECT o_orderkey::VARCHAR, 'V009', '' FROM orders
    UNION ALL SELECT o_orderkey::VARCHAR, 'V006', 'items' FROM orders UNION ALL SELECT o_orderkey::VARCHAR, 'V001', 'o_orderkey' FROM orders UNION ALL SELECT o_orderkey::VARCHAR, 'V011', 'o_orderdate' FROM orders""")
def validate_documents(spark, sf_dir):
    return V.validate(D.assignments_of(read(spark, sf_dir, "orders"), "o_orderkey"), _SCHEMA).select("doc_id", "code", "path")


@query("""WITH d AS (SELECT c_custkey, c_custkey % 7 AS k, (c_custkey + 1) % 7 AS t FROM customer) SELECT c_custkey::VARCHAR AS doc_id, 'V013' AS code, 'lost' AS path FROM d
    UNION ALL SELECT c_custkey::VARCHAR, 'V012', p FROM d, (VALUES ('a'), ('b')) v(p) WHERE k = 0""")
def validate_references(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    ref = lambda path, target: F.struct(F.lit(path).alias("path"), F.lit("reference").alias("type"), target.alias("text"))
    loop = F.when(F.col("c_custkey") % 7 == 0, F.lit("a")).otherwise(F.lit("name"))
    name = F.struct(F.lit("name").alias("path"), F.lit("string").alias("type"), F.col("c_name").alias("text"))
    rows = df.select(F.col("c_custkey").cast("string").alias("doc_id"), F.inline(F.array(ref("a", F.lit("b")), ref("b", loop), ref("lost", F.lit("nothing")), name)))
    rows = rows.withColumns({"number": F.lit(None).cast("double"), "mods": F.array().cast("array<string>"), "ord": F.lit(0)})
    return V.validate(rows, V.Schema()).select("doc_id", "code", "path")


#: A good and a bad value for each named format.
SAMPLES = {
    "email": ("a@b.co", "a@b"), "uri": ("urn:x", "x"), "url": ("https://a.b/c", "ftp://a"), "uuid": ("123e4567-e89b-12d3-a456-426614174000", "123"), "date": ("2024-01-01", "2024-1-1"), "time": ("10:30", "1:3"), "datetime": ("2024-01-01T10:00:00Z", "2024-01-01"),
    "date-time": ("2024-01-01T10:00:00", "x"), "duration": ("P1DT2H", "1D"), "hostname": ("a.b-c.d", "-a"), "ipv4": ("1.2.3.255", "1.2.3.256"), "ipv6": ("::1", "1::2::3"), "phone": ("+1 (555) 123-4567", "12"), "credit-card": ("4111 1111 1111 1111", "4111111111111112"),
    "creditcard": ("4111111111111111", "1"), "ssn": ("123-45-6789", "000-12-3456"), "ein": ("12-3456789", "123456789"), "fein": ("12-3456789", "1"), "zip": ("12345-6789", "1234"), "vin": ("1hgcm82633a004352", "1HGCM82633A00435O"), "iban": ("DE89370400440532013000", "89DE"),
    "bic": ("DEUTDEFF", "DEU"), "swift": ("DEUTDEFF500", "X"), "routing": ("123456789", "12"), "cusip": ("037833100", "0"), "isin": ("US0378331005", "US"), "lei": ("5493001KJTIIGC8Y1R12", "5"), "npi": ("1234567890", "1"), "naic": ("12345", "1"), "dea": ("AB1234567", "A1"),
    "imei": ("123456789012345", "1"), "iccid": ("1234567890123456789", "1"), "hex": ("0aF", "xyz"), "currency-code": ("USD", "usd"), "state-us": ("CA", "XX"), "date-iso": ("anything", None),
}


def _samples():
    return [(n, v, ok) for n, (good, bad) in SAMPLES.items() for v, ok in ((good, True), (bad, False)) if v is not None]


@query("SELECT n_nationkey, name, value, ok FROM nation, (VALUES " + ", ".join(f"('{n}', '{v}', {ok})" for n, v, ok in _samples()) + ") v(name, value, ok)")
def validate_formats(spark, sf_dir):
    """Rows of format names and values, each tested by the format that its row names."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v, _ in _samples()])
    rows = read(spark, sf_dir, "nation").select("n_nationkey", F.inline(pairs))
    # A repartition keeps the values from being folded into the plan: they are tested row by row.
    return rows.repartition("name").select("n_nationkey", "name", "value", V.formats_ok(F.col("name"), F.col("value")).alias("ok"))
