"""Several seeded draws of a model over the same packets, their findings merged by citations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.model import draws, merged_draws
from parley.plans.registry import query
from parley.sources.tables import turn_messages

SEEDS = [1, 2, 3, 4]


def stand_in(bodies: list[str], seeds: list[int]) -> list[str]:
    """A model that finds two stories a packet, cites what is not there at times, and at times answers in prose."""
    out = []
    for body, seed in zip(bodies, seeds):
        p = json.loads(body)
        conv, turns = p["id"], p["turns"]
        first = [f"m{t}" for t in turns if (3 * t + conv + seed) % 4 < 2]
        second = [f"m{t}" for t in turns if (t + conv * seed) % 3 == 0] + ["m99"]
        findings = [{"title": f"first of {len(first)}", "importance": (conv + seed) % 50, "refs": first}, {"title": f"second of {len(second)}", "importance": (conv * 7 + seed) % 60, "refs": second}]
        out.append("nothing to report" if (conv + seed) % 11 == 0 else json.dumps(findings))
    return out


@query(f"""WITH RECURSIVE t AS (SELECT conv_id AS conv, turn FROM conversations), s AS (SELECT unnest({SEEDS})::BIGINT AS seed),
f AS (SELECT conv, seed, 0::BIGINT AS no, 'first of ' || count(*) AS title, (conv + seed) % 50 AS importance, list('m' || turn ORDER BY 'm' || turn) AS refs FROM t, s WHERE (3 * turn + conv + seed) % 4 < 2 AND (conv + seed) % 11 <> 0 GROUP BY conv, seed
  UNION ALL SELECT conv, seed, 1, 'second of ' || (count(*) + 1), (conv * 7 + seed) % 60, list('m' || turn ORDER BY 'm' || turn) FROM t, s WHERE (turn + conv * seed) % 3 = 0 AND (conv + seed) % 11 <> 0 GROUP BY conv, seed),
o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY seed, no) AS k FROM f),
r(conv, k, groups, home) AS (SELECT DISTINCT conv, 0::BIGINT, []::VARCHAR[][], 0::BIGINT FROM o
  UNION ALL SELECT conv, k, CASE WHEN place IS NULL THEN list_append(groups, refs) ELSE list_transform(groups, lambda g, j: CASE WHEN j = place THEN list_distinct(g || refs) ELSE g END) END, coalesce(place, len(groups) + 1) FROM (
    SELECT o.conv, o.k, r.groups, o.refs, list_position(list_transform(r.groups, lambda g: len(list_intersect(g, o.refs)) >= greatest(1, least(len(g), len(o.refs)) // 2)), true) AS place
    FROM r JOIN o ON o.conv = r.conv AND o.k = r.k + 1)),
j AS (SELECT o.*, r.home FROM o JOIN r ON r.conv = o.conv AND r.k = o.k)
SELECT conv AS packet, arg_min(seed, k) AS first_seed, arg_min(no, k) AS first_no, count(DISTINCT seed) AS support, count(*) AS findings, arg_max(title, (len(refs), importance, -k)) AS title,
  arg_max(importance, (len(refs), importance, -k)) AS importance, array_to_string(list_sort(list_distinct(flatten(list(refs)))), ',') AS refs FROM j GROUP BY conv, home""")
def drawn_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories that draws of a stand-in model find in conversations, with the number of draws that support each."""
    body = F.to_json(F.struct(F.col("chat_id").alias("id"), F.array_sort(F.collect_list("pos")).alias("turns")))
    handles = F.transform(F.collect_list("pos"), lambda x: F.concat(F.lit("m"), x))
    packets = turn_messages(spark, sf_dir).groupBy("chat_id").agg(body.alias("body"), handles.alias("handles")).withColumnRenamed("chat_id", "packet")
    found = merged_draws(draws(packets, stand_in, SEEDS))
    return found.withColumn("refs", F.array_join("refs", ","))
