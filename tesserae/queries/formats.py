"""Queries of sources and sinks: rows are written as text and read back, whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.compiler import Transform
from ..plans.mapping import parse
from ..sources import readers as R
from ..sources import targets
from ..sources import writers as W
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


@query("SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS value FROM region")
def sink_json(spark, sf_dir):
    return W.as_text(read(spark, sf_dir, "region"), "json")


@query("SELECT c_custkey || ',\"' || c_name || ', x\",' || c_mktsegment AS value FROM customer")
def sink_csv(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(", x")).alias("n"), "c_mktsegment")
    return W.as_text(df, "csv")


@query("SELECT '<part id=\"' || p_partkey || '\"><name>' || p_name || '</name><kind>a &amp; b</kind><none/></part>' AS value FROM part")
def sink_xml(spark, sf_dir):
    df = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("a & b").alias("kind"), F.lit(None).cast("string").alias("none"))
    return df.select(W.as_xml(df, "part", ("id",)).alias("value"))


@query("SELECT lpad(p_partkey::VARCHAR, 8, '0') || rpad(left(p_name, 10), 10, ' ') || lpad(p_size::VARCHAR, 4, ' ') AS value FROM part")
def sink_fixed_width(spark, sf_dir):
    df = read(spark, sf_dir, "part")
    return df.select(W.as_fixed_width(df, [("p_partkey", 0, 8, "0"), ("p_name", 8, 10), ("p_size", 18, 4)]).alias("value"))


@query("SELECT 'n_name=' || n_name || chr(10) || 'n_nationkey=' || n_nationkey || chr(10) || 'n_regionkey=' || n_regionkey AS value FROM nation")
def sink_key_values(spark, sf_dir):
    return W.as_text(read(spark, sf_dir, "nation"), "flat")


@query("SELECT 'n_nationkey = ##' || n_nationkey || chr(10) || 'n_name = \"' || n_name || '\"' || chr(10) || 'n_regionkey = ##' || n_regionkey AS value FROM nation")
def sink_notation(spark, sf_dir):
    return W.as_text(read(spark, sf_dir, "nation"), "notation")


@query("SELECT p_partkey, p_name, p_size FROM part")
def source_fixed_width(spark, sf_dir):
    df = read(spark, sf_dir, "part")
    lines = df.select(W.as_fixed_width(df, [("p_partkey", 0, 8), ("p_name", 8, 40), ("p_size", 48, 4)]).alias("value"))
    got = lines.select(*R.fixed_width(F.col("value"), [("p_partkey", 0, 8), ("p_name", 8, 40), ("p_size", 48, 4)]))
    return got.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", F.col("p_size").cast("int").alias("p_size"))


@query("SELECT c_custkey, c_name || ', x' AS c_name, c_mktsegment FROM customer")
def source_csv(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(", x")).alias("c_name"), "c_mktsegment")
    row = R.parse_csv_text(W.as_csv(df), ["c_custkey", "c_name", "c_mktsegment"])
    return df.select(row.alias("r")).select(F.col("r.c_custkey").cast("long").alias("c_custkey"), "r.c_name", "r.c_mktsegment")


@query("SELECT n_nationkey AS id, 'n_name' AS path, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', n_regionkey::VARCHAR FROM nation UNION ALL SELECT n_nationkey, 'n_nationkey', n_nationkey::VARCHAR FROM nation")
def source_key_values(spark, sf_dir):
    df = read(spark, sf_dir, "nation")
    return df.select(F.col("n_nationkey").alias("id"), F.inline(R.key_values(F.concat(F.lit("# a comment\n"), W.as_key_values(df)))))


@query("""SELECT p_partkey AS id, '{"p:part": {"@id": "' || p_partkey || '", "name": "' || p_name || '", "empty": "", "none": null, "nil": null, "item": ["' || p_size || '"], "n": ["1", "2"]}}' AS json FROM part""")
def source_xml_shapes(spark, sf_dir):
    """Empty and self-closing elements, nil, prefixes, repeats and ``item``."""
    df = read(spark, sf_dir, "part")
    text = F.concat(F.lit("<p:part xmlns:p='u' id='"), "p_partkey", F.lit("'><name> "), "p_name", F.lit(" </name><empty></empty><none/><nil xsi:nil='true' xmlns:xsi='x'>1</nil><item>"), "p_size", F.lit("</item><n>1</n><n>2</n></p:part>"))
    return R.text_to_json(df.select(F.col("p_partkey").alias("id"), text.alias("value")), "xml").select("id", "json")


@query("SELECT p_partkey AS id, p_name AS name, p_partkey::VARCHAR AS attribute FROM part")
def source_xml(spark, sf_dir):
    df = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    texts = df.select("id", W.as_xml(df, "part", ("id",)).alias("value"))
    got = R.text_to_json(texts, "xml")
    return got.select("id", F.get_json_object("json", "$.part.name").alias("name"), F.get_json_object("json", "$.part.@id").alias("attribute"))


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def source_yaml(spark, sf_dir):
    texts = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.concat(F.lit("name: "), "r_name", F.lit("\nlist: [1, 2]\n")).alias("value"))
    return R.text_to_json(texts, "yaml").select("id", F.get_json_object("json", "$.name").alias("name"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def source_json(spark, sf_dir):
    df = read(spark, sf_dir, "events")
    return df.select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("""SELECT 'order' AS kind, o_orderkey::VARCHAR AS id, o_orderpriority AS detail FROM orders UNION ALL SELECT 'customer', c_custkey::VARCHAR, c_mktsegment FROM customer""")
def multi_record_routing(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.concat_ws("|", F.lit("ORD"), "o_orderkey", "o_orderpriority").alias("value"))
    customers = read(spark, sf_dir, "customer").select(F.concat_ws("|", F.lit("CUS"), "c_custkey", "c_mktsegment").alias("value"))
    plan = parse('{$source}\nformat = "delimited"\ndelimiter = "|"\ndiscriminator = ":field 0"\n{Order[]}\n_type = "ORD"\nid = @.1\ndetail = @.2\n{Customer[]}\n_type = "CUS"\nid = @.1\ndetail = @.2\n')
    routed = R.route_records(orders.unionByName(customers), plan)
    return routed["Order"].select(F.lit("order").alias("kind"), "id", "detail").unionByName(routed["Customer"].select(F.lit("customer").alias("kind"), "id", "detail"))


def _rendered(spark, sf_dir, head: str):
    """Customers with an array of two rows, as the plan's target format has them."""
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.array(*[F.struct((F.col("c_nationkey") + i).alias("n"), F.lit("x, <y>").alias("t")) for i in range(2)]).alias("rows"))
    t = Transform(f'{head}\n{{Head}}\nid = @.c_custkey :pos 0 :len 8 :leftPad "0" :attr\nname = @.c_name :pos 10 :len 12\n{{Line[]}}\n_each = "@.rows"\nn = @.n :pos 0 :len 4\nt = @.t :pos 4 :len 3 :rightPad "."\n')
    return targets.render(t.plan, t.apply(df, keep=("c_custkey",)), keep=("c_custkey",))


@query("SELECT c_custkey, lpad(c_custkey::VARCHAR, 8, '0') || '  ' || rpad(left(c_name, 12), 12, ' ') || chr(10) || lpad(c_nationkey::VARCHAR, 4, ' ') || 'x, ' || chr(10) || lpad((c_nationkey + 1)::VARCHAR, 4, ' ') || 'x, ' AS value FROM customer")
def sink_plan_fixed_width(spark, sf_dir):
    return _rendered(spark, sf_dir, '{$target}\nformat = "fixed-width"')


@query("""SELECT c_custkey, '<Head xmlns:t="urn:types" id="' || c_custkey || '">' || chr(10) || '  <name>' || c_name || '</name>' || chr(10) || '</Head>' || chr(10) || string_agg('<Line>' || chr(10) || '  <n t:type="integer">' || (c_nationkey + i) || '</n>' || chr(10) || '  <t>x, &lt;y&gt;</t>' || chr(10) || '</Line>' || chr(10), '' ORDER BY i) AS value
    FROM customer, range(2) r(i) GROUP BY c_custkey, c_name""")
def sink_plan_xml(spark, sf_dir):
    return _rendered(spark, sf_dir, '{$target}\nformat = "xml"\ndeclaration = false')


@query("""SELECT c_custkey, 'n;t' || chr(10) || c_nationkey || ';x, <y>' || chr(10) || (c_nationkey + 1) || ';x, <y>' || chr(10) AS value FROM customer""")
def sink_plan_csv(spark, sf_dir):
    return _rendered(spark, sf_dir, '{$target}\nformat = "csv"\ndelimiter = ";"')
