"""Queries over relabelling, components and graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import graphs, labels, stitch
from lamina.operators.shared import kept, shared_dir
from lamina.sources.volume import with_halo
from lamina.plans.base import EDGES, VOX, edges, table, vox
from lamina.plans.registry import query

S = SparkSession


@query(f"WITH {VOX}, t AS (SELECT CAST(n_nationkey AS BIGINT) AS old_id, CAST(n_regionkey - 1 AS BIGINT) AS new_id FROM nation) SELECT z, y, x, CASE WHEN new_id IS NULL OR new_id < 0 THEN label ELSE new_id END AS label FROM vox LEFT JOIN t ON label = old_id")
def relabel_default(spark: S, d: str) -> DataFrame:
    t = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("old_id"), (F.col("n_regionkey") - 1).cast("long").alias("new_id"))
    return labels.relabel(vox(spark, d), t).select("z", "y", "x", "label")


@query(f"WITH {VOX}, t AS (SELECT CAST(n_regionkey AS INTEGER) AS volume, CAST(n_nationkey % 11 AS BIGINT) AS old_id, CAST(max(n_nationkey) + 100 AS BIGINT) AS new_id FROM nation GROUP BY 1, 2) SELECT z, y, x, coalesce(new_id, label) AS label FROM vox LEFT JOIN t ON label = old_id AND z % 5 = volume")
def relabel_by_volume(spark: S, d: str) -> DataFrame:
    t = table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("int").alias("volume"), (F.col("n_nationkey") % 11).cast("long").alias("old_id")).agg((F.max("n_nationkey") + 100).cast("long").alias("new_id"))
    return labels.relabel(vox(spark, d).withColumn("volume", (F.col("z") % 5).cast("int")), t, ["volume"]).select("z", "y", "x", "label")


@query(f"WITH {VOX}, t AS (SELECT label, row_number() OVER (ORDER BY label) AS n FROM (SELECT DISTINCT label * 7 % 23 AS label FROM vox WHERE label * 7 % 23 > 0)) SELECT z, y, x, coalesce(n, 0) AS label FROM (SELECT z, y, x, label * 7 % 23 AS label FROM vox) v LEFT JOIN t USING (label)")
def make_contiguous(spark: S, d: str) -> DataFrame:
    v = vox(spark, d).withColumn("label", F.col("label") * 7 % 23)
    return labels.contiguous(v).select("z", "y", "x", "label")




@query(f"""WITH RECURSIVE {EDGES}, b AS (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges),
reach(node, root) AS (SELECT u, u FROM b UNION SELECT b.v, reach.root FROM reach JOIN b ON b.u = reach.node WHERE reach.root < b.v)
SELECT node, min(root) AS component FROM reach GROUP BY node""")
def graph_components(spark: S, d: str) -> DataFrame:
    return labels.components(edges(spark, d))


@query(f"""WITH RECURSIVE {EDGES}, b AS (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges),
far(node, depth) AS (SELECT CAST(3 AS BIGINT), 0 UNION SELECT b.v, depth + 1 FROM far JOIN b ON b.u = far.node WHERE depth < 8),
near AS (SELECT node, min(depth) AS depth FROM far GROUP BY node),
path(node, depth) AS (SELECT node, depth FROM near WHERE node = 40 UNION ALL
  SELECT (SELECT min(b.u) FROM b JOIN near n ON n.node = b.u WHERE b.v = path.node AND n.depth = path.depth - 1), depth - 1 FROM path WHERE depth > 0)
SELECT depth AS step, node FROM path""")
def graph_shortest_path(spark: S, d: str) -> DataFrame:
    return labels.shortest_path(edges(spark, d), 3, 40)


@query("WITH s AS (SELECT o_custkey AS sel, o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders) SELECT CAST(node AS BIGINT) AS src, CAST(nxt AS BIGINT) AS dst FROM (SELECT node, lead(node) OVER (PARTITION BY sel ORDER BY pos) AS nxt FROM s) WHERE nxt IS NOT NULL")
def merge_chain(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("sel"), F.col("o_orderkey").cast("long").alias("pos"), F.col("o_orderkey").cast("long").alias("node"))
    return labels.chain_edges(o)


@query(f"WITH {EDGES} SELECT src, dst FROM edges WHERE (src % 3 = 0) = (dst % 3 = 0) AND NOT (src = 3 AND dst = 401)")
def isolate_and_cut(spark: S, d: str) -> DataFrame:
    """Edges that don't leave a set, less one."""
    e = edges(spark, d)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).where("node % 3 = 0")
    return labels.without_edge(labels.isolate(e, nodes), spark.createDataFrame([(401, 3)], "src long, dst long"))


#: A graph that grows with the table: orders and the parts that groups of eight orders share; additions bridge neighbouring groups.
LOCAL = """l AS (SELECT l_orderkey AS o, l_orderkey // 8 AS g, l_partkey AS p, l_linenumber AS n, l_quantity AS q FROM lineitem),
e0 AS (SELECT DISTINCT o AS src, 1000000000000 + g * 50 + p % 50 AS dst FROM l),
m1 AS (SELECT DISTINCT o AS src, 1000000000000 + (g + 1) * 50 + p % 50 AS dst FROM l WHERE p % 97 = 0),
c2 AS (SELECT DISTINCT o AS src, 1000000000000 + g * 50 + p % 50 AS dst FROM l WHERE p % 13 = 5)"""


def _local(spark: S, d: str, where: str = "true", on: int = 0) -> DataFrame:
    group = F.floor(F.col("l_orderkey") / 8)
    rows = table(spark, d, "lineitem").where(where)
    return rows.select(F.col("l_orderkey").alias("src"), (F.lit(1000000000000) + (group + on) * 50 + F.col("l_partkey") % 50).alias("dst")).distinct()


@query(f"""WITH RECURSIVE {LOCAL},
e AS (SELECT 1 AS version, * FROM (SELECT * FROM e0 UNION SELECT * FROM m1) UNION ALL
  SELECT 3, * FROM (SELECT * FROM e0 UNION SELECT * FROM m1) WHERE (src, dst) NOT IN (SELECT (src, dst) FROM c2) AND src % 11 <> 0),
b AS (SELECT version, src AS u, dst AS v FROM e UNION SELECT version, dst, src FROM e),
r(version, node, root) AS (SELECT version, u, u FROM b UNION SELECT b.version, b.v, r.root FROM r JOIN b ON b.version = r.version AND b.u = r.node WHERE r.root < b.v),
k AS (SELECT version, node, min(root) AS component FROM r GROUP BY ALL),
a AS (SELECT i.i AS version, node FROM (SELECT src AS node FROM e0 UNION SELECT dst FROM e0 UNION SELECT src FROM m1 UNION SELECT dst FROM m1), (VALUES (1), (3)) AS i(i))
SELECT CAST(a.version AS INTEGER) AS version, a.node, coalesce(component, a.node) AS component FROM a LEFT JOIN k USING (version, node)""")
def graph_versions(spark: S, d: str) -> DataFrame:
    """A graph under additions, cuts and an isolated set: its components after the additions and at the end."""
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    graphs.commit(spark, path, merge=_local(spark, d))
    graphs.commit(spark, path, merge=_local(spark, d, "l_partkey % 97 = 0", 1))
    graphs.commit(spark, path, cut=_local(spark, d, "l_partkey % 13 = 5"))
    graphs.commit(spark, path, isolate=table(spark, d, "lineitem").where("l_orderkey % 11 = 0").select(F.col("l_orderkey").alias("node")))
    return labels.union_all(*[graphs.parts_at(spark, path, k).select(F.lit(k).alias("version"), "node", "component") for k in (1, 3)])


@query(f"""WITH RECURSIVE {LOCAL}, b AS (SELECT src AS u, dst AS v FROM e0 UNION SELECT dst, src FROM e0),
s AS (SELECT g AS split, min(o) AS a, max(o) AS z FROM l GROUP BY g),
far(split, node, depth) AS (SELECT split, a, 0 FROM s UNION SELECT far.split, b.v, depth + 1 FROM far JOIN b ON b.u = far.node WHERE depth < 16),
near AS (SELECT split, node, min(depth) AS depth FROM far GROUP BY split, node),
up AS (SELECT n.split, n.node, n.depth, min(m.node) AS parent FROM near n JOIN b ON b.v = n.node JOIN near m ON m.split = n.split AND m.node = b.u AND m.depth = n.depth - 1 GROUP BY ALL),
path(split, node, depth) AS (SELECT near.split, near.node, near.depth FROM near JOIN s ON s.split = near.split AND near.node = z UNION ALL SELECT path.split, parent, path.depth - 1 FROM path JOIN up ON up.split = path.split AND up.node = path.node),
len AS (SELECT split, count(*) AS n FROM path GROUP BY split),
mv AS (SELECT g AS split, CAST(q % 3 - 1 AS BIGINT) AS delta, row_number() OVER (PARTITION BY g ORDER BY o, n, p, q) AS k FROM l),
pt(split, k, i) AS (SELECT split, 0, 1 FROM len UNION ALL SELECT pt.split, pt.k + 1, greatest(1, least(n, i + delta)) FROM pt JOIN mv ON mv.split = pt.split AND mv.k = pt.k + 1 JOIN len ON len.split = pt.split),
ix AS (SELECT split, arg_max(i, k) AS i FROM pt GROUP BY split)
SELECT ix.split, x.node AS src, y.node AS dst FROM ix JOIN path x ON x.split = ix.split AND x.depth = i - 1 JOIN path y ON y.split = ix.split AND y.depth = i""")
def split_edges(spark: S, d: str) -> DataFrame:
    """Where each path between the first and the last order of a group is cut after its pointer was moved."""
    l = table(spark, d, "lineitem").withColumn("split", F.floor(F.col("l_orderkey") / 8))
    goals = l.groupBy("split").agg(F.min("l_orderkey").alias("start"), F.max("l_orderkey").alias("goal"))
    paths = kept(labels.shortest_paths(_local(spark, d), goals), "paths")
    moves = l.select("split", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("seq"), (F.col("l_quantity") % 3 - 1).alias("delta"))
    return graphs.accepted(paths, graphs.pointers(paths, moves)).select("split", "src", "dst")


@query("""WITH c AS (SELECT CAST(user_id AS BIGINT) AS id, arg_max(event_type, event_id) AS cls FROM events GROUP BY 1)
SELECT id, cls FROM (SELECT *, row_number() OVER (ORDER BY id) AS n FROM c) WHERE n > 20 AND n <= 40""")
def review_page(spark: S, d: str) -> DataFrame:
    """The second page of objects with the last class given to each."""
    e = table(spark, d, "events").select(F.col("user_id").cast("long").alias("id"), F.col("event_type").alias("cls"), F.col("event_id").alias("seq"))
    return labels.page(labels.last_class(e), 20, 1)


@query("SELECT CAST(o_orderkey AS BIGINT) AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber >= 3)")
def unfinished_corners(spark: S, d: str) -> DataFrame:
    """Work whose result does not exist yet: orders without a third line."""
    done = table(spark, d, "lineitem").where("l_linenumber >= 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(done, "o_orderkey", "left_anti").select(F.col("o_orderkey").cast("long").alias("id"))


#: Tiles of 8 x 16 x 16 voxels that see 2 more in z and 3 in x; every other tile does not tell labels 3 and 4 apart; ids are each tile's own.
TILED = f"""{VOX}, d AS (SELECT *, bz * 1000 + bx AS tile FROM (
  SELECT v.*, unnest(list_distinct([(z - 2 + 8) // 8 - 1, z // 8, (z + 2) // 8])) AS bz FROM vox v) w,
  LATERAL (SELECT unnest(list_distinct([(x - 3 + 16) // 16 - 1, x // 16, (x + 3) // 16])) AS bx)),
t AS (SELECT CAST(tile AS BIGINT) AS tile, z, y, x, CASE WHEN label = 0 THEN 0 ELSE 1 + (CASE WHEN label = 3 AND (bz + bx + 10) % 2 = 1 THEN 4 ELSE label END * 13 + (bz + 5) * 29 + (bx + 5) * 31) % 101 END AS label FROM d)"""
MATCHED = f"""{TILED},
c AS (SELECT a.tile AS tile_a, a.label AS id_a, b.tile AS tile_b, b.label AS id_b, count(*) AS n FROM t a JOIN t b ON a.z = b.z AND a.y = b.y AND a.x = b.x AND a.tile < b.tile GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY tile_a, tile_b, id_a) AS n_a, sum(n) OVER (PARTITION BY tile_a, tile_b, id_b) AS n_b FROM c),
s AS (SELECT *, CAST(n AS DOUBLE) / (n_a + n_b - n) AS share FROM w WHERE id_a > 0 AND id_b > 0),
m AS (SELECT * FROM s QUALIFY share >= 0.3 AND row_number() OVER (PARTITION BY tile_a, tile_b, id_a ORDER BY share DESC, id_b) = 1 AND row_number() OVER (PARTITION BY tile_a, tile_b, id_b ORDER BY share DESC, id_a) = 1),
n AS (SELECT tile, label, row_number() OVER (ORDER BY tile, label) AS node FROM (SELECT DISTINCT tile, label FROM t WHERE label > 0)),
e AS (SELECT a.node AS u, b.node AS v FROM m JOIN n a ON a.tile = tile_a AND a.label = id_a JOIN n b ON b.tile = tile_b AND b.label = id_b),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r(node, root) AS (SELECT node, node FROM n UNION SELECT b.v, r.root FROM r JOIN b ON b.u = r.node WHERE r.root < b.v),
g AS (SELECT node, min(root) AS root FROM r GROUP BY node),
ids AS (SELECT tile, label, dense_rank() OVER (ORDER BY root) AS global_id FROM n JOIN g USING (node))"""


def _tiled(spark: S, d: str):
    dealt = with_halo(vox(spark, d).select("z", "y", "x", "label"), (8, 16, 16), (2, 0, 3))
    own = F.when((F.col("label") == 3) & (F.pmod(F.col("bz") + F.col("bx"), F.lit(2)) == 1), 4).otherwise(F.col("label"))
    local = F.when(F.col("label") == 0, 0).otherwise(1 + (own * 13 + (F.col("bz") + 5) * 29 + (F.col("bx") + 5) * 31) % 101)
    return dealt.select((F.col("bz") * 1000 + F.col("bx")).cast("long").alias("tile"), "z", "y", "x", local.cast("long").alias("label"))


@query(f"WITH RECURSIVE {MATCHED} SELECT tile, label, global_id FROM ids")
def ids_across_tiles(spark: S, d: str) -> DataFrame:
    """One numbering of the segments of overlapping tiles with local ids."""
    return stitch.global_ids(_tiled(spark, d), 0.3)


@query(f"""WITH RECURSIVE {MATCHED}, h AS (SELECT tile, min(z) AS lz, min(y) AS ly, min(x) AS lx, max(z) AS hz, max(y) AS hy, max(x) AS hx FROM t GROUP BY tile),
o AS (SELECT t.* FROM t JOIN h USING (tile) QUALIFY row_number() OVER (PARTITION BY z, y, x ORDER BY least(z - lz, y - ly, x - lx, hz - z, hy - y, hx - x) DESC, tile) = 1)
SELECT z, y, x, coalesce(global_id, 0) AS label FROM o LEFT JOIN ids USING (tile, label)""")
def stitched_tiles(spark: S, d: str) -> DataFrame:
    """The whole volume from overlapping tiles."""
    t = _tiled(spark, d)
    return stitch.stitched(t, stitch.global_ids(t, 0.3))
