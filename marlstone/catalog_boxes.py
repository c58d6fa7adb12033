"""Queries over containers of boxes, with their SQL: parts stand in for the items of files, forty to a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.catalog import _query
from marlstone.session import table, written
from marlstone.sources import boxes

ALPHA = "urn:mpeg:hevc:2015:auxid:1"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    item = k % 40 + 1
    kind = F.when(s % 5 == 0, "iden").when(s % 5 == 1, "iovl").when(s % 10 == 2, "grid").otherwise("hvc1")
    return table(spark, sf_dir, "part").select(
        F.floor(k / 40).alias("file"), item.alias("item"), kind.alias("kind"), F.col("p_name").alias("name"), s.cast("long").alias("width"), (k % 100 + 1).alias("height"), (k % 4 * 90).alias("angle"),
        F.when(k % 3 == 0, k % 2).alias("axis"), F.when(s % 7 == 0, F.lit(ALPHA)).when(s % 7 == 1, "depth").alias("aux"), F.when(kind != "hvc1", F.array(F.ceil(item / 2), item * 7 % 40 + 1)).alias("derived"),
        F.when(s % 7 == 0, F.array(F.lit(1).cast("long"), item)).alias("auxiliary"), F.when(kind == "hvc1", F.encode("p_type", "UTF-8")).alias("data"),
    )


_ITEMS = f"""i AS (SELECT p_partkey // 40 AS file, p_partkey % 40 + 1 AS item, CASE WHEN p_size % 5 = 0 THEN 'iden' WHEN p_size % 5 = 1 THEN 'iovl' WHEN p_size % 10 = 2 THEN 'grid' ELSE 'hvc1' END AS kind, p_name AS name,
  p_size::BIGINT AS width, p_partkey % 100 + 1 AS height, p_partkey % 4 * 90 AS angle, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 2 END AS axis, CASE WHEN p_size % 7 = 0 THEN '{ALPHA}' WHEN p_size % 7 = 1 THEN 'depth' END AS aux, p_type, p_size FROM part)"""


def _read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # Every table of a file is read from its boxes, which are packed and walked once.
    files = written(boxes.pack_files(_items(spark, sf_dir)), "files")
    return files, written(boxes.box_table(files), "boxes")


def _assembled(found: DataFrame) -> DataFrame:
    return boxes.assemble_items(boxes.item_entries(found), boxes.item_associations(found), boxes.item_properties(found))


@_query(f"""WITH {_ITEMS}, f AS (SELECT file, count(*) AS items, count(DISTINCT width::VARCHAR || 'x' || height) + count(DISTINCT angle) FILTER (angle > 0) + count(DISTINCT axis) + count(DISTINCT aux) AS properties, count(*) FILTER (kind <> 'hvc1') AS derived, count(*) FILTER (aux LIKE 'urn%') AS auxiliary FROM i GROUP BY file)
SELECT file, path, n FROM (SELECT file, unnest(['ftyp', 'meta', 'mdat', 'meta/pitm', 'meta/iinf', 'meta/iloc', 'meta/iprp', 'meta/iref', 'meta/iprp/ipma', 'meta/iprp/ipco', 'meta/iinf/infe', 'meta/iprp/ipco/*', 'meta/iref/dimg', 'meta/iref/auxl']) AS path,
  unnest([1, 1, 1, 1, 1, 1, 1, 1, 1, 1, items, properties, derived, auxiliary]) AS n FROM f) WHERE n > 0""")
def src19_box_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("path", "^meta/iprp/ipco/.*", "meta/iprp/ipco/*")
    return boxes.box_table(boxes.pack_files(_items(spark, sf_dir))).groupBy("file", path.alias("path")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"""WITH {_ITEMS} SELECT file, item, kind, name, width, height, concat_ws(',', CASE WHEN angle > 0 THEN 'irot' || angle END, 'imir' || axis) AS moves, aux, CASE WHEN kind = 'hvc1' THEN p_type END AS text FROM i""")
def j8_item_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, found = _read(spark, sf_dir)
    names = boxes.item_entries(found).select("file", "item", "name")
    data = boxes.item_data(boxes.item_places(found), files, found).select("file", "item", F.decode("data", "UTF-8").alias("text"))
    moves = F.array_join(F.transform("transforms", lambda m: F.concat(m["kind"], m["value"])), ",")
    return _assembled(found).join(names, ["file", "item"]).join(data, ["file", "item"], "left").select("file", "item", "kind", "name", "width", "height", moves.alias("moves"), "aux", "text")


@_query(f"""WITH {_ITEMS} SELECT DISTINCT file, unnest([1, item]) AS target, item FROM i WHERE aux LIKE 'urn%'""")
def j10_auxiliary_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _read(spark, sf_dir)[1]
    return boxes.auxiliary_items(boxes.item_references(found), _assembled(found), "urn:mpeg:hevc:2015:auxid")


@_query(f"""WITH RECURSIVE {_ITEMS}, t AS (SELECT file, item, kind, unnest(CASE kind WHEN 'iden' THEN [(item + 1) // 2] ELSE [(item + 1) // 2, item * 7 % 40 + 1] END) AS target FROM i WHERE kind <> 'hvc1'),
s AS (SELECT t.*, i.kind AS target_kind FROM t LEFT JOIN i ON i.file = t.file AND i.item = t.target),
c AS (SELECT file, item AS root, item, kind, 0 AS depth, [item] AS path, NULL::VARCHAR AS fault FROM i
  UNION ALL SELECT c.file, c.root, s.target, CASE WHEN s.kind = 'grid' THEN 'tile' ELSE coalesce(s.target_kind, 'none') END, c.depth + 1, list_append(c.path, s.target),
    CASE WHEN list_contains(c.path, s.target) THEN 'cycle' WHEN s.target_kind IS NULL THEN 'missing item' WHEN c.depth + 1 > 8 AND s.kind <> 'grid' THEN 'too deep' END
  FROM c JOIN s ON s.file = c.file AND s.item = c.item AND s.kind = c.kind WHERE c.fault IS NULL)
SELECT file, root, item, CAST(depth AS INTEGER) AS depth, fault, count(*) AS n FROM c WHERE fault IS NOT NULL OR kind IN ('hvc1', 'tile', 'none') GROUP BY ALL""")
def j11_derived_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _read(spark, sf_dir)[1]
    out = boxes.derived_sources(boxes.item_entries(found), boxes.item_references(found))
    return out.groupBy("file", "root", "item", "depth", "fault").agg(F.count(F.lit(1)).alias("n"))
