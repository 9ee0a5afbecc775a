"""Queries over the graph operators on the driver's tables, each with its SQL equivalent."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.frames import local
from quadloom.functions.html import local_url, replace_links_column
from quadloom.functions.terms import INVERSE_OF, RDF_TYPE, parse_predicates
from quadloom.operators import entities
from quadloom.operators.graph import Graph, build_graph
from quadloom.operators.lookup import Lookup
from quadloom.operators.paths import compile_path
from quadloom.plans.load import load
from quadloom.plans.scratch import scratch_path
from quadloom.plans.triplify import BASE, customer_schema, document_quads, star_parts, star_quads, uri
from quadloom.sinks import export
from quadloom.sources.nquads import parse_lines, read_nquads, to_lines, write_nquads
from quadloom.sources.pathbuilder import Path, dumps_xml
from quadloom.sources.turtle import statements

ORDER_PATH = [BASE + x for x in ("Order", "placedBy", "Customer", "inNation", "Nation")]
HAS_ORDER = [("placedBy", "hasOrder")]


def _graph(spark: SparkSession, sf_dir: str, *tables: str, **options) -> Graph:
    parts = star_parts(spark, sf_dir, tables, options.pop("inverses", ()))
    return build_graph(functools.reduce(DataFrame.unionAll, parts.values()), parts=parts, **options)


def _customers(spark: SparkSession, sf_dir: str, **options) -> tuple[Graph, entities.BundleTables]:
    pb = customer_schema()
    # the mask as a user would set it: both directions of the inverse
    g = _graph(spark, sf_dir, "nation", "customer", "orders", inverses=HAS_ORDER, masks=pb.masks(RDF_TYPE), mask_mode="closed", **options)
    return g, entities.extract(g, pb.bundle("customer"), persist=True)


def path_basic(spark, sf_dir):
    ps = compile_path(_graph(spark, sf_dir, "nation", "customer", "orders"), Path("f", ORDER_PATH, BASE + "name"))
    return ps.values().select(F.col("n0").alias("order_uri"), F.col("value").alias("nation_name"))


def path_long(spark, sf_dir):
    steps = [BASE + x for x in ("LineItem", "ofOrder", "Order", "placedBy", "Customer", "inNation", "Nation", "inRegion", "Region")]
    ps = compile_path(_graph(spark, sf_dir, "region", "nation", "customer", "orders", "lineitem"), Path("f", steps, BASE + "name"))
    return ps.values().groupBy(F.col("value").alias("region_name")).agg(F.count("*").alias("n_items"))


def path_nodes(spark, sf_dir):
    p = compile_path(_graph(spark, sf_dir, "nation", "customer", "orders"), ORDER_PATH).paths()
    return p.select(F.array_join("nodes", " ").alias("nodes"), F.array_join("edges", " ").alias("edges"), F.size("tids").cast("long").alias("n_triples"), "has_datum")


def path_ending(spark, sf_dir):
    g = _graph(spark, sf_dir, "nation", "supplier", "region")
    ps = compile_path(g, [BASE + "Supplier", BASE + "supplierNation", BASE + "Nation"]).ending(BASE + "inRegion", BASE + "region/2")
    return ps.values().select(F.col("n0").alias("supplier"), F.col("value").alias("nation"))


def path_count(spark, sf_dir):
    return compile_path(_graph(spark, sf_dir, "nation", "customer", "orders"), ORDER_PATH).size()


def path_value_fallback(spark, sf_dir):
    ps = compile_path(_graph(spark, sf_dir, "nation", "customer"), [BASE + x for x in ("Customer", "inNation", "Nation")])
    return ps.values().select(F.col("n0").alias("customer"), "value", "lang")


def path_triples(spark, sf_dir):
    t = compile_path(_graph(spark, sf_dir, "nation", "supplier"), Path("f", [BASE + x for x in ("Supplier", "supplierNation", "Nation")], BASE + "name")).triples()
    return t.select(F.col("at").cast("long").alias("at"), "subject", "predicate", F.coalesce("object", "value").alias("object"), F.col("role").cast("long").alias("role"))


def path_render(spark, sf_dir):
    ps = compile_path(_graph(spark, sf_dir, "nation", "supplier"), Path("f", [BASE + x for x in ("Supplier", "supplierNation", "Nation")], BASE + "name"))
    return ps.render()


def _repeated_orders(spark, sf_dir) -> Graph:
    # an order's customer, stated once by the order and again by each of its items
    q = star_quads(spark, sf_dir, ["orders"])
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey"))
    again = li.select((F.col("l_linenumber") + 1_000_000_000).cast("bigint").alias("ord"), uri("order", "o_orderkey").alias("s"), F.lit(BASE + "placedBy").alias("p"), uri("customer", "o_custkey").alias("o"), F.lit(None).cast("string").alias("value"), F.lit("").alias("lang"), F.lit(None).cast("string").alias("datatype"), F.concat(F.lit("item"), F.col("l_linenumber").cast("string")).alias("graph"))
    return build_graph(q.unionAll(again))


def dedup_argmin(spark, sf_dir):
    g = _repeated_orders(spark, sf_dir)
    return g.edges.filter(F.col("p_c") == BASE + "placedBy").select(F.col("s_c").alias("s"), F.col("o_c").alias("o"), "graph", F.col("role").cast("long").alias("role"))


def inverse_infer(spark, sf_dir):
    g = _graph(spark, sf_dir, "orders", inverses=HAS_ORDER)
    e = g.edges.filter(F.col("p_c") == BASE + "hasOrder")
    return e.select(F.col("s_c").alias("customer"), F.col("o_c").alias("order_uri"), "s_l", "p_l", "o_l", F.col("role").cast("long").alias("role"))


def inverse_many(spark, sf_dir):
    # 900 statements over 300 and 250 properties, so most are stated again and the last one counts
    pairs = spark.range(900).select((F.col("id") - 5000).alias("ord"), F.concat(F.lit(BASE + "p"), (F.col("id") * 7 % 300).cast("string")).alias("s"), F.lit(INVERSE_OF[0]).alias("p"), F.concat(F.lit(BASE + "q"), (F.col("id") * 11 % 250).cast("string")).alias("o"))
    d = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = d.select(F.col("event_id").alias("ord"), uri("event", "event_id").alias("s"), F.concat(F.lit(BASE + "p"), (F.col("event_id") % 300).cast("string")).alias("p"), uri("user", "user_id").alias("o"))
    none = F.lit(None).cast("string")
    q = pairs.unionAll(e).select("ord", "s", "p", "o", none.alias("value"), F.lit("").alias("lang"), none.alias("datatype"), F.lit("").alias("graph"))
    g = build_graph(q)
    return g.edges.filter(F.col("role") == 1).select(F.col("s_c").alias("s"), F.col("p_c").alias("p"), F.col("o_c").alias("o"), "p_l")


def graph_stats_conflicts(spark, sf_dir):
    return _repeated_orders(spark, sf_dir).stats()


def graph_stats(spark, sf_dir):
    pb = customer_schema()
    return _graph(spark, sf_dir, "nation", "customer", "orders", inverses=HAS_ORDER, masks=pb.masks(RDF_TYPE), mask_mode="closed").stats()


def graph_stats_reference_mask(spark, sf_dir):
    pb = customer_schema()
    return _graph(spark, sf_dir, "nation", "customer", "orders", inverses=HAS_ORDER, masks=pb.masks(RDF_TYPE)).stats()


def mask_filter(spark, sf_dir):
    g = _graph(spark, sf_dir, "customer", "orders", masks=([RDF_TYPE, BASE + "placedBy"], [BASE + "name"]))
    counts = g.adj.groupBy(F.col("p").alias("predicate")).agg(F.count("*").alias("n"))
    return counts


def same_as_components(spark, sf_dir):
    q = document_quads(spark, sf_dir)
    g = build_graph(q, same_as_mode="distributed")
    docs = g.edges.filter(F.col("p_c") == RDF_TYPE).select(F.col("s_c").alias("canonical")).distinct()
    return docs


def identity_map(spark, sf_dir):
    return build_graph(document_quads(spark, sf_dir)).identity_map()


def language_literals(spark, sf_dir):
    g = build_graph(document_quads(spark, sf_dir))
    size = F.length("value").cast("bigint")
    return g.data.groupBy("lang", "graph").agg(F.count("*").alias("n"), F.sum(size).alias("chars"), F.min(F.sha2(F.col("value").cast("binary"), 256)).alias("least_hash"))


def entity_wide(spark, sf_dir):
    return entities.wide(_customers(spark, sf_dir)[1])


def entity_wide_child(spark, sf_dir):
    return entities.wide(_customers(spark, sf_dir)[1].children[0])


def entity_long(spark, sf_dir):
    out = None
    for name, df in entities.long(_customers(spark, sf_dir)[1]).items():
        df = df.withColumn("tbl", F.lit(name))
        out = df if out is None else out.unionAll(df)
    return out


def entity_children(spark, sf_dir):
    n = entities.nested(_customers(spark, sf_dir)[1])
    statuses = F.flatten(F.transform("bundle__orders", lambda o: F.transform(o["field__status"], lambda v: v["value"])))
    return n.select("uri", F.size("bundle__orders").cast("long").alias("n_orders"), F.array_join(F.array_sort(statuses), "").alias("statuses"), F.size("field__cname").cast("long").alias("n_names"))


def entity_all_triples(spark, sf_dir):
    t = entities.all_triples(*_customers(spark, sf_dir))
    return t.select("uri", F.col("s_subject").alias("s"), F.col("s_predicate").alias("p"), F.coalesce("s_object", "value").alias("o"), F.col("role").cast("long").alias("role"))


def entity_ntriples(spark, sf_dir):
    return export.ntriples(entities.all_triples(*_customers(spark, sf_dir))).select("uri", "line")


def entity_turtle(spark, sf_dir):
    # written as Turtle, and read back
    t = export.turtle(entities.all_triples(*_customers(spark, sf_dir)))
    return t.select("uri", F.explode(statements(F.col("turtle"))).alias("x")).select("uri", "x.s", "x.p", "x.o")


def entity_json(spark, sf_dir):
    pb = customer_schema()
    t = entities.extract(_graph(spark, sf_dir, "nation", "customer", "orders", inverses=HAS_ORDER), pb.bundle("customer"), persist=True)
    j = export.json_rows(t)
    # read back by its own schema
    value = "array<struct<value:string,lang:string,path:array<string>,tids:array<bigint>>>"
    kind = f"uri string, path array<string>, field__cname {value}, field__nation {value}, bundle__orders array<struct<uri:string,field__status:{value}>>"
    j = j.select(F.from_json("json", kind).alias("j"))
    orders = F.array_sort(F.transform("j.bundle__orders", lambda o: F.concat(o["uri"], F.lit(" "), o["field__status"][0]["value"])))
    return j.select("j.uri", F.array_join("j.path", " ").alias("path"), F.col("j.field__cname")[0]["value"].alias("name"), F.col("j.field__nation")[0]["value"].alias("nation"), F.array_join(orders, ", ").alias("orders"))


def _lookup(spark, sf_dir) -> Lookup:
    g, t = _customers(spark, sf_dir)
    return Lookup(g, {"customer": t})


def bundle_page(spark, sf_dir):
    return _lookup(spark, sf_dir).page("customer", skip=20, limit=30)


def bundle_of(spark, sf_dir):
    look = _lookup(spark, sf_dir)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(uri("customer", F.col("c_custkey") * 2).alias("uri"))
    return look.bundle_of(c).select("uri", "canonical", "bundle")


def first_bundle(spark, sf_dir):
    look = _lookup(spark, sf_dir)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ids = o.select(F.col("o_orderkey").alias("id"), F.array(uri("nowhere", "o_orderkey"), uri("customer", "o_orderkey"), uri("customer", "o_custkey")).alias("uris"))
    return look.first_bundle(ids)


def bundle_index(spark, sf_dir):
    # every bundle by name with its entities
    look = _lookup(spark, sf_dir)
    return functools.reduce(DataFrame.unionAll, [look.entities(n).select(F.lit(n).alias("bundle"), "uri", F.size("path").cast("long").alias("nodes")) for n in look.bundle_names()])


def entity_by_uri(spark, sf_dir):
    rows = _lookup(spark, sf_dir).entity(f"{BASE}customer/7", "customer")
    first = lambda n: F.col(n)[0]["value"]
    orders = F.array_join(F.array_sort(F.col("bundle__orders.uri")), " ")
    return rows.select("uri", first("field__cname").alias("name"), first("field__segment").alias("segment"), first("field__nation").alias("nation"), orders.alias("orders"))


def resolve_uri(spark, sf_dir):
    look = _lookup(spark, sf_dir)
    asked = [f" {BASE}customer/3 ", f"{BASE}customer/0", f"{BASE}order/1"]
    found = [(u, *(look.resolve(u) or (None, None))) for u in asked]
    return local(spark, found, asked="string", bundle="string", uri="string")


def navigate(spark, sf_dir):
    # customers under a public address, found by a local path over either scheme
    d = spark.read.parquet(f"{sf_dir}/customer.parquet")
    s = F.concat(F.lit("https://data.example/base/c/"), F.col("c_custkey").cast("string"))
    none = F.lit(None).cast("string")
    q = d.select(F.col("c_custkey").alias("ord"), s.alias("s"), F.lit(RDF_TYPE).alias("p"), F.lit(BASE + "Customer").alias("o"), none.alias("value"), F.lit("").alias("lang"), none.alias("datatype"), F.lit("").alias("graph"))
    g = build_graph(q)
    look = Lookup(g, {"customer": entities.extract(g, customer_schema().bundle("customer"))})
    hits = [look.navigate(path, ["http://other.example", "http://data.example/base/"]) for path in ("/c/5", "c/6", "/c/none")]
    return functools.reduce(DataFrame.unionAll, hits).select("uri", "bundle")


def aliases_of_uri(spark, sf_dir):
    look = Lookup(build_graph(document_quads(spark, sf_dir)), {})
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(F.coalesce("text", F.lit(""))).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    one = d.orderBy(F.col("n").desc(), "first").first()
    return look.aliases(f"{BASE}doc/{one.first}")


def canonical(spark, sf_dir):
    g = build_graph(document_quads(spark, sf_dir))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(uri("doc", "doc_id").alias("uri"))
    return Lookup(g, {}).canonical(d).select("uri", "canonical")


def aliases(spark, sf_dir):
    g = build_graph(document_quads(spark, sf_dir))
    return g.canon.groupBy("canonical").agg(F.count("*").alias("n_aliases"))


def nquads_roundtrip(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    none = F.lit(None).cast("string")
    q = d.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), uri("conv", "conv_id", "turn").alias("s"), F.lit(BASE + "said").alias("p"), none.alias("o"), F.col("text").alias("value"), F.lit("en").alias("lang"), none.alias("datatype"), F.concat(F.lit(BASE), F.col("role")).alias("graph"))
    back = parse_lines(to_lines(q))
    return back.select("ord", "s", "p", "value", "lang", "graph")


def nquads_files(spark, sf_dir):
    # written to files of statements and read from them, in a shared folder
    path = scratch_path(spark, "statements") + ".nq"
    write_nquads(star_quads(spark, sf_dir, ["nation", "customer"]), path)
    back = read_nquads(spark, path)
    return back.select("s", "p", "o", "value", "lang", "graph")


def load_files(spark, sf_dir):
    # the schema as XML and the statements as text, found in one folder and loaded from there
    folder = scratch_path(spark, "source")
    spark.createDataFrame([(dumps_xml(customer_schema()),)], "value string").coalesce(1).write.text(f"{folder}/schema.xml")
    write_nquads(star_quads(spark, sf_dir, ["nation", "customer", "orders"], HAS_ORDER), f"{folder}/data.nq")
    _, bundles, _ = load(spark, folder, mask_mode="closed")
    return entities.wide(bundles["customer"], cell_format="pair")


def csv_files(spark, sf_dir):
    g, t = _customers(spark, sf_dir)
    path = scratch_path(spark, "csv")
    export.to_csv(export.tables({"customer": t}), path)
    return spark.read.option("header", True).csv(f"{path}/bundle__orders")


def predicate_list(spark, sf_dir):
    names = parse_predicates(f" {BASE}placedBy, {BASE}inNation\n\n,{BASE}inRegion ,")
    q = star_quads(spark, sf_dir, ["region", "nation", "customer", "orders"])
    return q.filter(F.col("p").isin(names)).groupBy(F.col("p").alias("predicate")).agg(F.count("*").alias("n"))


def html_links(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", replace_links_column(F.col("html"), lambda u: "https://mirror.test" + u).alias("html"))


def url_replace(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", local_url(F.col("url"), ["https://", "http://example"]).alias("local"))


def graph_view(spark, sf_dir):
    v = export.graph_view(entities.all_triples(*_customers(spark, sf_dir)))
    text = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: F.array_join(x, " "))), "|")
    return v.select("uri", text("edges").alias("edges"), text("literals").alias("literals"))


QUERIES = {
    f.__name__: f
    for f in (
        path_basic,
        path_long,
        path_nodes,
        path_ending,
        path_count,
        path_value_fallback,
        path_triples,
        path_render,
        dedup_argmin,
        inverse_infer,
        inverse_many,
        graph_stats_conflicts,
        graph_stats,
        graph_stats_reference_mask,
        mask_filter,
        same_as_components,
        identity_map,
        language_literals,
        entity_wide,
        entity_wide_child,
        entity_long,
        entity_children,
        entity_all_triples,
        entity_ntriples,
        entity_turtle,
        entity_json,
        bundle_page,
        bundle_of,
        first_bundle,
        bundle_index,
        entity_by_uri,
        resolve_uri,
        navigate,
        aliases_of_uri,
        canonical,
        aliases,
        nquads_roundtrip,
        nquads_files,
        load_files,
        csv_files,
        predicate_list,
        html_links,
        url_replace,
        graph_view,
    )
}

TYPE = RDF_TYPE
_FIRST = "(SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents)"

#: Every triple of each customer with their orders: (uri, s, p, o, role).
_ALL = f"""
    WITH c AS (SELECT '{BASE}customer/' || c_custkey AS uri, '{BASE}nation/' || n_nationkey AS n, * FROM customer JOIN nation ON c_nationkey = n_nationkey),
    d AS (SELECT uri, '{BASE}order/' || o_orderkey AS ord, o_orderstatus, o_orderpriority FROM orders JOIN c ON o_custkey = c_custkey),
    t AS (
        SELECT uri, uri AS s, '{TYPE}' AS p, '{BASE}Customer' AS o, 0::BIGINT AS role FROM c
        UNION ALL SELECT uri, uri, '{BASE}name', c_name, 2 FROM c
        UNION ALL SELECT uri, uri, '{BASE}mktsegment', c_mktsegment, 2 FROM c
        UNION ALL SELECT uri, uri, '{BASE}inNation', n, 0 FROM c
        UNION ALL SELECT uri, n, '{TYPE}', '{BASE}Nation', 0 FROM c
        UNION ALL SELECT uri, n, '{BASE}name', n_name, 2 FROM c
        UNION ALL SELECT uri, uri, '{BASE}hasOrder', ord, 1 FROM d
        UNION ALL SELECT uri, ord, '{TYPE}', '{BASE}Order', 0 FROM d
        UNION ALL SELECT uri, ord, '{BASE}status', o_orderstatus, 2 FROM d
        UNION ALL SELECT uri, ord, '{BASE}priority', o_orderpriority, 2 FROM d)"""
_S, _P, _O = "'<' || s || '>'", "'<' || p || '>'", "CASE WHEN role = 2 THEN '\"' || o || '\"' ELSE '<' || o || '>' END"

ORACLES = {
    "path_basic": f"""
        SELECT '{BASE}order/' || o_orderkey AS order_uri, n_name AS nation_name
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "path_long": """
        SELECT r_name AS region_name, count(*) AS n_items
        FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS d FROM lineitem)
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
    "path_nodes": f"""
        SELECT '{BASE}order/' || o_orderkey || ' {BASE}customer/' || c_custkey || ' {BASE}nation/' || n_nationkey AS nodes,
               '{BASE}placedBy {BASE}inNation' AS edges, 5::BIGINT AS n_triples, false AS has_datum
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "path_ending": f"""
        SELECT '{BASE}supplier/' || s_suppkey AS supplier, '{BASE}nation/' || n_nationkey AS nation
        FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2""",
    "path_count": """
        SELECT count(*) AS size FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "path_value_fallback": f"""
        SELECT '{BASE}customer/' || c_custkey AS customer, '{BASE}nation/' || n_nationkey AS value, '' AS lang
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "path_triples": f"""
        WITH p AS (SELECT '{BASE}supplier/' || s_suppkey AS s, '{BASE}nation/' || n_nationkey AS n, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
        SELECT 0::BIGINT AS at, s AS subject, '{TYPE}' AS predicate, '{BASE}Supplier' AS object, 0::BIGINT AS role FROM p
        UNION ALL SELECT 1, n, '{TYPE}', '{BASE}Nation', 0 FROM p
        UNION ALL SELECT 2, s, '{BASE}supplierNation', n, 0 FROM p
        UNION ALL SELECT 3, n, '{BASE}name', n_name, 2 FROM p""",
    "dedup_argmin": f"""
        WITH a AS (
            SELECT o_orderkey, o_custkey, o_orderkey * 512 + 1 AS ord, '' AS graph FROM orders
            UNION ALL SELECT o_orderkey, o_custkey, 1000000000 + l_linenumber, 'item' || l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT '{BASE}order/' || o_orderkey AS s, '{BASE}customer/' || o_custkey AS o, graph, 0::BIGINT AS role
        FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey, o_custkey ORDER BY ord) AS n FROM a) WHERE n = 1""",
    "inverse_infer": f"""
        SELECT '{BASE}customer/' || o_custkey AS customer, '{BASE}order/' || o_orderkey AS order_uri, '{BASE}order/' || o_orderkey AS s_l,
               '{BASE}placedBy' AS p_l, '{BASE}customer/' || o_custkey AS o_l, 1::BIGINT AS role FROM orders""",
    "graph_stats": """
        WITH n AS (SELECT (SELECT count(*) FROM nation) AS na, (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM orders) AS o)
        SELECT (na + 2 * c + 2 * o)::BIGINT AS direct, (na + 2 * c + 2 * o)::BIGINT AS datum, (na + 1)::BIGINT AS masked_pred,
               0::BIGINT AS masked_data, o::BIGINT AS inverse, 0::BIGINT AS conflict FROM n""",
    "graph_stats_reference_mask": """
        WITH n AS (SELECT (SELECT count(*) FROM nation) AS na, (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM orders) AS o)
        SELECT (na + 2 * c + o)::BIGINT AS direct, (na + 2 * c + 2 * o)::BIGINT AS datum, (na + 1 + o)::BIGINT AS masked_pred,
               0::BIGINT AS masked_data, 0::BIGINT AS inverse, 0::BIGINT AS conflict FROM n""",
    "mask_filter": f"""
        SELECT '{TYPE}' AS predicate, (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS n
        UNION ALL SELECT '{BASE}placedBy', count(*) FROM orders UNION ALL SELECT '{BASE}name', count(*) FROM customer""",
    "same_as_components": f"""SELECT DISTINCT '{BASE}doc/' || first AS canonical FROM {_FIRST}""",
    "identity_map": f"""SELECT '{BASE}doc/' || doc_id AS label, '{BASE}doc/' || first AS canonical FROM {_FIRST} WHERE doc_id <> first""",
    "language_literals": f"""
        SELECT lang, '{BASE}source/' || source AS graph, count(*) AS n, sum(length(text))::BIGINT AS chars, min(sha256(text)) AS least_hash
        FROM documents WHERE text IS NOT NULL GROUP BY lang, source""",
    "entity_wide": f"""
        SELECT '{BASE}customer/' || c_custkey AS uri, c_name AS field__cname, c_mktsegment AS field__segment, n_name AS field__nation,
               '{BASE}nation/' || n_nationkey AS field__nation_ref
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "entity_wide_child": f"""
        SELECT '{BASE}order/' || o_orderkey AS uri, '{BASE}customer/' || o_custkey AS parent, o_orderstatus AS field__status, o_orderpriority AS field__priority
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "entity_long": f"""
        SELECT '{BASE}customer/' || c_custkey AS uri, c_name AS value, '' AS lang, 'field__customer__cname' AS tbl FROM customer
        UNION ALL SELECT '{BASE}customer/' || c_custkey, c_mktsegment, '', 'field__customer__segment' FROM customer
        UNION ALL SELECT '{BASE}customer/' || c_custkey, n_name, '', 'field__customer__nation' FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT '{BASE}customer/' || c_custkey, '{BASE}nation/' || n_nationkey, '', 'field__customer__nation_ref' FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "entity_children": f"""
        SELECT '{BASE}customer/' || c_custkey AS uri, count(o_orderkey) AS n_orders, coalesce(string_agg(o_orderstatus, '' ORDER BY o_orderstatus), '') AS statuses, 1::BIGINT AS n_names
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
    "entity_all_triples": f"""{_ALL} SELECT uri, s, p, o, role FROM t""",
    "entity_ntriples": f"""{_ALL} SELECT uri, {_S} || ' ' || {_P} || ' ' || {_O} || ' .' AS line FROM t""",
    "entity_turtle": f"""{_ALL} SELECT uri, {_S} AS s, {_P} AS p, {_O} AS o FROM t""",
    "entity_json": f"""
        WITH o AS (SELECT o_custkey, string_agg('{BASE}order/' || o_orderkey || ' ' || o_orderstatus, ', ' ORDER BY '{BASE}order/' || o_orderkey || ' ' || o_orderstatus) AS orders FROM orders GROUP BY 1)
        SELECT '{BASE}customer/' || c_custkey AS uri, '{BASE}customer/' || c_custkey AS path, c_name AS name, n_name AS nation, coalesce(orders, '') AS orders
        FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o ON c_custkey = o_custkey""",
    "bundle_page": f"""
        SELECT '{BASE}customer/' || c_custkey AS uri FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 30 OFFSET 20)""",
    "bundle_of": f"""
        SELECT '{BASE}customer/' || 2 * a.c_custkey AS uri, '{BASE}customer/' || 2 * a.c_custkey AS canonical, CASE WHEN b.c_custkey IS NOT NULL THEN 'customer' END AS bundle
        FROM customer a LEFT JOIN customer b ON 2 * a.c_custkey = b.c_custkey""",
    "first_bundle": f"""
        SELECT o_orderkey AS id, CASE WHEN a.c_custkey IS NOT NULL THEN '{BASE}customer/' || o_orderkey ELSE '{BASE}customer/' || o_custkey END AS uri, 'customer' AS bundle
        FROM orders LEFT JOIN customer a ON o_orderkey = a.c_custkey LEFT JOIN customer b ON o_custkey = b.c_custkey
        WHERE a.c_custkey IS NOT NULL OR b.c_custkey IS NOT NULL""",
    "canonical": f"""SELECT '{BASE}doc/' || doc_id AS uri, '{BASE}doc/' || first AS canonical FROM {_FIRST}""",
    "aliases": f"""SELECT '{BASE}doc/' || first AS canonical, count(*) AS n_aliases FROM {_FIRST} WHERE doc_id <> first GROUP BY first""",
    "nquads_roundtrip": f"""
        SELECT conv_id * 1000 + turn AS ord, '{BASE}conv/' || conv_id || '-' || turn AS s, '{BASE}said' AS p, text AS value, 'en' AS lang, '{BASE}' || role AS graph
        FROM conversations WHERE text IS NOT NULL""",
    "predicate_list": f"""
        SELECT '{BASE}placedBy' AS predicate, count(*) AS n FROM orders UNION ALL SELECT '{BASE}inNation', count(*) FROM customer
        UNION ALL SELECT '{BASE}inRegion', count(*) FROM nation""",
    "url_replace": """
        SELECT page_id, url, CASE WHEN starts_with(url, 'https://') OR starts_with(url, 'http://example') THEN regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '') ELSE url END AS local
        FROM pages""",
    "graph_view": f"""{_ALL}
        SELECT uri, string_agg(s || ' ' || p || ' ' || o, '|' ORDER BY s || ' ' || p || ' ' || o) FILTER (role < 2) AS edges,
               string_agg(s || ' ' || p || ' ' || o || ' ', '|' ORDER BY s || ' ' || p || ' ' || o || ' ') FILTER (role = 2) AS literals FROM t GROUP BY uri""",
    "path_render": f"""
        SELECT '{BASE}supplier/' || s_suppkey || ' {BASE}supplierNation {BASE}nation/' || n_nationkey || ' {BASE}name "' || n_name || '"' AS path
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "inverse_many": f"""
        WITH i AS (SELECT range AS id, '{BASE}p' || range * 7 % 300 AS a, '{BASE}q' || range * 11 % 250 AS b FROM range(900)),
        both_ways AS (SELECT id, 0 AS turn, a AS p, b AS inv FROM i UNION ALL SELECT id, 1, b, a FROM i),
        last AS (SELECT p, arg_max(inv, id * 2 + turn) AS inv FROM both_ways GROUP BY p)
        SELECT '{BASE}user/' || user_id AS s, inv AS p, '{BASE}event/' || event_id AS o, p AS p_l
        FROM events JOIN last ON p = '{BASE}p' || event_id % 300""",
    "graph_stats_conflicts": """
        WITH n AS (SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS l)
        SELECT (2 * o)::BIGINT AS direct, (2 * o)::BIGINT AS datum, 0::BIGINT AS masked_pred, 0::BIGINT AS masked_data, 0::BIGINT AS inverse, (2 * l)::BIGINT AS conflict FROM n""",
    "bundle_index": f"""SELECT 'customer' AS bundle, '{BASE}customer/' || c_custkey AS uri, 1::BIGINT AS nodes FROM customer""",
    "entity_by_uri": f"""
        SELECT '{BASE}customer/' || c_custkey AS uri, c_name AS name, c_mktsegment AS segment, n_name AS nation,
               (SELECT coalesce(string_agg('{BASE}order/' || o_orderkey, ' ' ORDER BY '{BASE}order/' || o_orderkey), '') FROM orders WHERE o_custkey = c_custkey) AS orders
        FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7""",
    "resolve_uri": f"""
        SELECT asked, CASE WHEN c_custkey IS NOT NULL THEN 'customer' END AS bundle, CASE WHEN c_custkey IS NOT NULL THEN trim(asked) END AS uri
        FROM (VALUES (' {BASE}customer/3 '), ('{BASE}customer/0'), ('{BASE}order/1')) v(asked) LEFT JOIN customer ON trim(asked) = '{BASE}customer/' || c_custkey""",
    "navigate": """SELECT 'https://data.example/base/c/' || c_custkey AS uri, 'customer' AS bundle FROM customer WHERE c_custkey IN (5, 6)""",
    "aliases_of_uri": f"""
        WITH top AS (SELECT first FROM {_FIRST} GROUP BY first ORDER BY count(*) DESC, first LIMIT 1)
        SELECT '{BASE}doc/' || doc_id AS label FROM {_FIRST} JOIN top USING (first) WHERE doc_id <> first""",
    "nquads_files": f"""
        SELECT '{BASE}nation/' || n_nationkey AS s, '{TYPE}' AS p, '{BASE}Nation' AS o, NULL::VARCHAR AS value, '' AS lang, '' AS graph FROM nation
        UNION ALL SELECT '{BASE}nation/' || n_nationkey, '{BASE}inRegion', '{BASE}region/' || n_regionkey, NULL, '', '' FROM nation
        UNION ALL SELECT '{BASE}nation/' || n_nationkey, '{BASE}name', NULL, n_name, '', '' FROM nation
        UNION ALL SELECT '{BASE}customer/' || c_custkey, '{TYPE}', '{BASE}Customer', NULL, '', '' FROM customer
        UNION ALL SELECT '{BASE}customer/' || c_custkey, '{BASE}inNation', '{BASE}nation/' || c_nationkey, NULL, '', '' FROM customer
        UNION ALL SELECT '{BASE}customer/' || c_custkey, '{BASE}name', NULL, c_name, '', '' FROM customer
        UNION ALL SELECT '{BASE}customer/' || c_custkey, '{BASE}mktsegment', NULL, c_mktsegment, '', '' FROM customer""",
    "load_files": f"""
        SELECT '{BASE}customer/' || c_custkey AS uri, '{{' || c_name || ' }}' AS field__cname, '{{' || c_mktsegment || ' }}' AS field__segment,
               '{{' || n_name || ' }}' AS field__nation, '{{{BASE}nation/' || n_nationkey || ' }}' AS field__nation_ref
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "csv_files": f"""
        SELECT '{BASE}order/' || o_orderkey AS uri, '{BASE}customer/' || o_custkey AS parent, o_orderstatus AS field__status, o_orderpriority AS field__priority
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "html_links": """
        SELECT page_id, regexp_replace(regexp_replace(html, '<a href="', '<a href="https://mirror.test', 'g'), '<(br|meta[^>]*)>', '<\\1/>', 'g') AS html FROM pages""",
}
