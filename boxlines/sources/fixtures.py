"""Tables shaped like the intermediate data of a diagram extraction, derived by SQL from the test tables.

Each text runs in Spark SQL, where names in braces are DataFrames, and in DuckDB, where they are the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FIXTURES: dict[str, str] = {
    "fx_images": """
SELECT DISTINCT user_id AS diagram_id,
       800 + (user_id * 37) % 3200 AS width,
       600 + (user_id * 53) % 2600 AS height
FROM {events}
""",
    "fx_regions": """
SELECT user_id AS diagram_id, event_id AS region_id,
       CASE event_type
         WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'Class' WHEN 1 THEN 'Struck Class' ELSE 'Note' END
         WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'Arrow End' WHEN 1 THEN 'Triangle End'
                           WHEN 2 THEN 'Empty Diamond End' ELSE 'Filled Diamond End' END
         WHEN 'purchase' THEN CASE event_id % 2 WHEN 0 THEN 'Crossing' ELSE 'Empty End' END
         WHEN 'signup' THEN 'Relationship label'
         ELSE 'Multiplicity' END AS label,
       CAST((event_id * 7919) % 9000 AS DOUBLE) / CAST(100 AS DOUBLE) AS x,
       CAST((event_id * 10007) % 9000 AS DOUBLE) / CAST(100 AS DOUBLE) AS y,
       CAST(2 + (event_id * 31) % 8 AS DOUBLE) AS width,
       CAST(2 + (event_id * 17) % 8 AS DOUBLE) AS height,
       CAST(300 + (event_id * 613) % 700 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score,
       (event_id % 4) * 240 AS offset_px_x,
       (CAST(floor(event_id / 4) AS BIGINT) % 3) * 240 AS offset_px_y,
       CAST(480 AS BIGINT) AS tile_width,
       CAST(480 AS BIGINT) AS tile_height
FROM {events}
""",
    "fx_class_boxes": """
SELECT CAST(floor(c_custkey / 10) AS BIGINT) AS diagram_id,
       c_custkey % 10 AS class_index,
       CAST(20 + ((c_custkey % 10) % 4) * 240 AS DOUBLE) AS x,
       CAST(20 + CAST(floor((c_custkey % 10) / 4) AS BIGINT) * 240 AS DOUBLE) AS y,
       CAST(120 + (c_custkey * 13) % 80 AS DOUBLE) AS w,
       CAST(100 + (c_custkey * 29) % 80 AS DOUBLE) AS h
FROM {customer}
""",
    "fx_endpoints": """
SELECT CAST(floor(o_custkey / 10) AS BIGINT) AS diagram_id,
       o_orderkey AS endpoint_id,
       CAST((o_orderkey * 211) % 1000 AS DOUBLE) AS x,
       CAST((o_orderkey * 379) % 760 AS DOUBLE) AS y
FROM {orders}
""",
    "fx_end_shapes": """
SELECT user_id AS diagram_id, event_id AS shape_index,
       CAST((event_id * 71) % 960 AS DOUBLE) AS x,
       CAST((event_id * 113) % 720 AS DOUBLE) AS y,
       CAST(12 + event_id % 9 AS DOUBLE) AS w,
       CAST(12 + event_id % 7 AS DOUBLE) AS h,
       CASE event_id % 4 WHEN 0 THEN 'Arrow End' WHEN 1 THEN 'Triangle End'
            WHEN 2 THEN 'Empty Diamond End' ELSE 'Filled Diamond End' END AS label,
       CAST(500 + (event_id * 613) % 500 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score
FROM {events} WHERE event_type = 'error'
""",
    "fx_label_boxes": """
SELECT user_id AS diagram_id, event_id AS label_id,
       CASE WHEN event_type = 'signup' THEN 'Relationship label' ELSE 'Multiplicity' END AS kind,
       CAST((event_id * 89) % 940 AS DOUBLE) AS x1,
       CAST((event_id * 131) % 700 AS DOUBLE) AS y1,
       CAST((event_id * 89) % 940 + 10 + event_id % 50 AS DOUBLE) AS x2,
       CAST((event_id * 131) % 700 + 10 + event_id % 23 AS DOUBLE) AS y2,
       CAST(300 + (event_id * 613) % 700 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score
FROM {events} WHERE event_type IN ('signup', 'view')
""",
    "fx_polygons": """
SELECT user_id AS diagram_id, event_id AS region_id,
       CAST((event_id * 7919) % 88 AS DOUBLE) AS x1,
       CAST((event_id * 10007) % 88 AS DOUBLE) AS y1,
       CAST((event_id * 7919) % 88 + 1 + event_id % 11 AS DOUBLE) AS x2,
       CAST((event_id * 10007) % 88 + 1 + event_id % 5 AS DOUBLE) AS y2,
       CAST(500 + (event_id * 613) % 500 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score
FROM {events} WHERE event_type = 'view'
""",
    "fx_paths": """
SELECT l_orderkey AS diagram_id, l_partkey % 6 AS start_index, l_suppkey % 6 AS endpoint_index,
       CASE WHEN l_partkey % 6 = 5 THEN NULL ELSE l_partkey % 3 END AS class_a,
       CASE WHEN l_suppkey % 6 = 5 THEN NULL ELSE l_suppkey % 3 END AS class_b,
       CAST(floor(max(l_quantity) / 25) * 25 AS DOUBLE) AS total_div,
       CAST(max(l_linenumber) * 25 AS BIGINT) AS path_len
FROM {lineitem} WHERE l_partkey % 6 <> l_suppkey % 6
GROUP BY l_orderkey, l_linenumber % 2, l_partkey % 6, l_suppkey % 6,
         CASE WHEN l_partkey % 6 = 5 THEN NULL ELSE l_partkey % 3 END,
         CASE WHEN l_suppkey % 6 = 5 THEN NULL ELSE l_suppkey % 3 END
""",
    "fx_class_text": """
SELECT CAST(floor(conv_id / 4) AS BIGINT) AS diagram_id, conv_id % 4 AS class_index, turn AS pos,
       CASE WHEN role = 'system' THEN 'Stereotype'
            WHEN role = 'user' AND conv_id % 5 <> 0 AND turn < 2 THEN 'Name'
            WHEN (conv_id + turn) % 7 = 6 THEN 'Other' ELSE 'Property' END AS label,
       CAST(350 + (conv_id * 137 + turn * 211) % 650 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score,
       CASE WHEN (conv_id + turn) % 6 = 5 AND role = 'assistant' THEN ''
            WHEN role = 'system' THEN CASE conv_id % 3 WHEN 0 THEN '<<interface>>' WHEN 1 THEN '<<entlty>>' ELSE 'zzz' END
            WHEN conv_id % 3 = 0 THEN concat(CAST(conv_id AS VARCHAR(20)), ' item.', CAST(turn AS VARCHAR(20)),
                 CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN ' aO' ELSE ' b0: int' END)
            ELSE concat(role, '-', CAST(conv_id AS VARCHAR(20)),
                 CASE (conv_id * 3 + turn) % 6 WHEN 0 THEN ' getO' WHEN 1 THEN ': int' WHEN 2 THEN '(x)'
                      WHEN 3 THEN ' b0: int' WHEN 4 THEN ' )(' ELSE ' runQ' END) END AS text
FROM {conversations}
""",
    "fx_relationships": """
SELECT CAST(floor(l_orderkey / 100) AS BIGINT) AS diagram_id,
       CAST(row_number() OVER (PARTITION BY CAST(floor(l_orderkey / 100) AS BIGINT)
                               ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS BIGINT) AS rel_index,
       l_partkey % 4 AS class_index_0, l_suppkey % 4 AS class_index_1,
       CASE l_partkey % 5 WHEN 0 THEN 'Empty End' WHEN 1 THEN 'Arrow End' WHEN 2 THEN 'Triangle End'
            WHEN 3 THEN 'Empty Diamond End' ELSE 'Filled Diamond End' END AS end_shape_0,
       CASE (l_suppkey + l_linenumber) % 5 WHEN 0 THEN 'Empty End' WHEN 1 THEN 'Arrow End' WHEN 2 THEN 'Triangle End'
            WHEN 3 THEN 'Empty Diamond End' ELSE 'Filled Diamond End' END AS end_shape_1,
       l_discount AS shape_score_0, l_tax AS shape_score_1,
       CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN NULL ELSE '0..*' END AS multiplicity_0,
       CASE l_linestatus WHEN 'F' THEN '*' ELSE NULL END AS multiplicity_1,
       CASE l_linenumber % 3 WHEN 0 THEN 'owner "main"' ELSE '' END AS role_0,
       CASE l_linenumber % 2 WHEN 0 THEN 'part' ELSE '' END AS role_1,
       CASE l_linenumber % 4 WHEN 0 THEN 'uses' ELSE '' END AS name
FROM {lineitem}
""",
    "fx_timings": """
SELECT l_orderkey % 1000 AS diagram_id, CAST(l_linenumber % 5 AS BIGINT) AS run_index,
       concat(l_returnflag, l_linestatus) AS step, sum(l_quantity) AS seconds
FROM {lineitem}
GROUP BY l_orderkey % 1000, l_linenumber % 5, concat(l_returnflag, l_linestatus)
""",
    "fx_files": """
SELECT concat('IMG_', CAST(p_partkey AS VARCHAR(20)), '.png') AS file_name,
       concat('IMG_', CAST(p_partkey AS VARCHAR(20))) AS stem,
       p_size % 3 = 0 AS done
FROM {part}
""",
}


def oracle(name: str) -> str:
    """The fixture as a subquery for DuckDB."""
    return re.sub(r"\{(\w+)\}", r"\1", FIXTURES[name]).strip()


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture as a DataFrame over the tables of sf_dir."""
    tables = set(re.findall(r"\{(\w+)\}", FIXTURES[name]))
    return spark.sql(FIXTURES[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})
