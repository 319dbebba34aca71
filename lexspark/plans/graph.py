"""Queries of the graph operators: parts descend from parts, lineitems tie parts to suppliers, nodes tie to records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.operators import graph as G
from lexspark.operators.references import clean_uuid
from lexspark.sources.tables import table


def descent(s, d):
    p = table(s, d, "part", "p_partkey").filter("p_partkey > 1")
    return p.select(F.col("p_partkey").alias("source_id"), F.floor(F.col("p_partkey") / 3).cast("bigint").alias("target_id"), F.lit("DESCENDS_FROM").alias("relationship_type")).filter("target_id > 0")


def _lang(s, d):
    return table(s, d, "part", F.col("p_partkey").alias("id"), (F.col("p_size") % 8).cast("int").alias("lang"))


def proto_roots(s, d):
    return G.roots(descent(s, d))


def etymology_chain(s, d):
    """The chain of ancestors of every part whose key is divisible by 20."""
    return G.chains(descent(s, d), table(s, d, "part", F.col("p_partkey").alias("id")).filter("id % 20 = 0")).select("start", "proto", "depth")


def descendants(s, d):
    """All parts within three levels below every part whose key is divisible by 20."""
    starts = table(s, d, "part", F.col("p_partkey").alias("id")).filter("id % 20 = 0")
    return G.walk(G.reversed_(descent(s, d)), starts, 3)


def cognates(s, d):
    """Words per root and language, root aside."""
    r = proto_roots(s, d).filter("depth > 0")
    return r.join(_lang(s, d), "id").groupBy("root", "lang").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def shortest_paths(s, d):
    """Hops from every part whose key is divisible by 20 to the others within four, in both directions."""
    starts = table(s, d, "part", F.col("p_partkey").alias("id")).filter("id % 20 = 0")
    return G.walk(G.both_ways(descent(s, d)), starts, 4).withColumnRenamed("depth", "hops")


def borrowing_neighbours(s, d):
    """Degree of suppliers and parts by lineitems, one hop."""
    e = table(s, d, "lineitem", "l_partkey", "l_suppkey").distinct()
    return e.groupBy("l_suppkey").agg(F.count("*").alias("parts"))


def graph_cycles(s, d):
    """Every customer points to another one by a formula that ends in a few cycles."""
    e = table(s, d, "customer", "c_custkey").select(F.col("c_custkey").alias("source_id"), ((F.col("c_custkey") * 7 + 3) % 31).alias("target_id"))
    return G.on_cycles(e)


def temporal_consistency(s, d):
    """Borrowing records whose donor node starts later than the record ends."""
    m = table(s, d, "lsr_metadata", "id", "neo4j_id", "date_start", "date_end")
    n = table(s, d, "graph_nodes", "node_id", F.col("date_start").alias("node_start"), F.col("date_end").alias("node_end"))
    x = m.join(n, F.col("neo4j_id") == F.col("node_id"))
    return x.filter((F.col("node_start") > F.col("date_end")) | (F.col("node_end") < F.col("date_start"))).select("id", "node_id")


def orphan_nodes(s, d):
    """Graph nodes without a record, and records without attestation and entry, by language."""
    n = table(s, d, "graph_nodes", "node_id", "language_code")
    return G.orphan_nodes(n, table(s, d, "lsr_metadata", "neo4j_id").filter("neo4j_id is not null").distinct()).select("node_id", "language_code")


def unattested(s, d):
    a = table(s, d, "attestations", clean_uuid(F.col("lsr_id")).alias("k")).distinct()
    m = table(s, d, "lsr_metadata", "id", "language_code")
    return m.join(a, m["id"] == a["k"], "left_anti").groupBy("language_code").agg(F.count("*").alias("n"))


QUERIES = {
    "proto_roots": proto_roots, "etymology_chain": etymology_chain, "descendants": descendants, "cognates": cognates, "shortest_paths": shortest_paths, "borrowing_neighbours": borrowing_neighbours,
    "graph_cycles": graph_cycles, "temporal_consistency": temporal_consistency, "orphan_nodes": orphan_nodes, "unattested": unattested,
}
_E = "e as (select p_partkey as source_id, p_partkey // 3 as target_id from part where p_partkey // 3 > 0)"
_ROOT = f"{_E}, r as (select distinct target_id as id, target_id as root, 0 as depth from e where target_id not in (select source_id from e) union all select e.source_id, r.root, r.depth + 1 from e join r on e.target_id = r.id)"
SQL = {
    "proto_roots": f"with recursive {_ROOT} select id, root, depth from r",
    "etymology_chain": f"with recursive {_ROOT} select id as start, root as proto, depth from r where id % 20 = 0 union all select p_partkey, p_partkey, 0 from part where p_partkey % 20 = 0 and p_partkey not in (select id from r)",
    "descendants": f"with recursive {_E}, c as (select p_partkey as start, p_partkey as id, 0 as depth from part where p_partkey % 20 = 0 union all select start, e.source_id, depth + 1 from c join e on e.target_id = c.id where depth < 3) select start, id, depth from c",
    "cognates": f"with recursive {_ROOT} select root, cast(p_size % 8 as int) as lang, count(*) as n, min(id) as first from r join part on p_partkey = id where depth > 0 group by all",
    "shortest_paths": f"with recursive {_E}, b as (select * from e union select target_id, source_id from e), c as (select p_partkey as start, p_partkey as id, 0 as hops from part where p_partkey % 20 = 0 union select start, b.target_id, hops + 1 from c join b on b.source_id = c.id where hops < 4) select start, id, min(hops) as hops from c group by all",
    "borrowing_neighbours": "select l_suppkey, count(distinct l_partkey) as parts from lineitem group by 1",
    "graph_cycles": "with recursive e as (select distinct c_custkey as a, (c_custkey * 7 + 3) % 31 as b from customer), c as (select a as s, b from e union select c.s, e.b from c join e on e.a = c.b) select distinct s as id from c where s = b",
    "temporal_consistency": "select id, node_id from lsr_metadata m join graph_nodes n on neo4j_id = node_id where n.date_start > m.date_end or n.date_end < m.date_start",
    "orphan_nodes": "select node_id, language_code from graph_nodes where node_id not in (select neo4j_id from lsr_metadata where neo4j_id is not null)",
    "unattested": r"""select language_code, count(*) as n from lsr_metadata where id not in (select lower(regexp_replace(lsr_id, '^[\s\x{a0}{(]+|[\s\x{a0})}]+$', '', 'g')) from attestations where lsr_id is not null) group by 1""",
}
