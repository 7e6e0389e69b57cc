"""Analysis of packets in three phases by injected models: A finds a packet's topics, B the claims of
each topic, C audits the packet. A phase runs only on what the one before completed, and an answer
that breaks its schema or names a handle it was not given leaves its unit pending."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from parley.operators.graph import checkpointed

#: Answers, a list of JSON texts, to a list of request bodies.
Model = Callable[[list[str]], list[str]]


def ask(requests: DataFrame, model: Model) -> DataFrame:
    """requests (packet, topic, body, ...) with ``answer`` and ``provider_call``. Equal bodies are asked
    once, for the first of their (packet, topic); the others take its answer. Answers are checkpointed,
    so that later phases do not ask again."""
    hashed = requests.withColumn("request", F.sha2("body", 256))
    once = hashed.groupBy("request").agg(F.min("body").alias("body"), F.min(F.struct("packet", "topic")).alias("first"))
    once = once.select("request", "body", F.col("first.packet").alias("asked_packet"), F.col("first.topic").alias("asked_topic"))
    kept = [f for f in once.schema.fields if f.name != "body"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[f.name for f in kept]].assign(answer=model(frame["body"].tolist()))

    answers = checkpointed(once.mapInPandas(run, StructType([*kept, StructField("answer", StringType())])))
    found = hashed.drop("body").join(answers, "request")
    asked = (F.col("packet") == F.col("asked_packet")) & (F.col("topic") == F.col("asked_topic"))
    return found.withColumn("provider_call", asked).drop("request", "asked_packet", "asked_topic")


def _ledger(rows: DataFrame, stage: str, ok: Column) -> DataFrame:
    return rows.select("packet", F.lit(stage).alias("stage"), "topic", F.when(ok, "complete").otherwise("pending").alias("status"), "provider_call")


def staged_analysis(messages: DataFrame, topics: Model, claims: Model, audit: Model) -> DataFrame:
    """packet, stage, topic (empty for A and C), status (complete or pending), provider_call.

    ``messages``: packet, handle, content; a null content counts as empty, and a packet is a page of
    bounded size. Answers: A a map from every handle of the packet to a topic, B an array of handles of
    the topic, not empty, C {"ok": true}. Packets that A leaves pending have no row in B; C has a row
    for each packet that A completed, pending without a call where a topic is."""
    lines = F.array_sort(F.collect_list(F.struct("handle", F.coalesce("content", F.lit("")).alias("content"))))
    packets = messages.groupBy("packet").agg(lines.alias("lines"))
    packets = packets.select("packet", "lines", F.lit("").alias("topic"), F.to_json("lines").alias("body"))
    a = ask(packets, topics).withColumn("topics", F.from_json("answer", "map<string,string>"))
    named = F.forall(F.map_values("topics"), lambda t: t.isNotNull() & (F.trim(t) != ""))
    a_ok = F.coalesce((F.array_sort(F.map_keys("topics")) == F.array_sort(F.array_distinct("lines.handle"))) & named, F.lit(False))
    placed = a.where(a_ok).select("packet", F.explode("lines").alias("line"), "topics").select("packet", F.element_at("topics", F.col("line.handle")).alias("topic"), "line")
    units = placed.groupBy("packet", "topic").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    b = ask(units.withColumn("body", F.to_json("lines")), claims).withColumn("claims", F.from_json("answer", "array<string>"))
    b_ok = F.coalesce((F.size("claims") > 0) & (F.size(F.array_except("claims", "lines.handle")) == 0), F.lit(False))
    judged = b.withColumn("ok", b_ok)
    whole = judged.groupBy("packet").agg(F.bool_and("ok").alias("ready"), F.array_sort(F.collect_list(F.struct("topic", "claims"))).alias("found"))
    whole = whole.select("packet", "ready", F.lit("").alias("topic"), F.to_json("found").alias("body"))
    c = ask(whole.where("ready").drop("ready"), audit)
    c_ok = F.coalesce(F.get_json_object("answer", "$.ok") == "true", F.lit(False))
    held = whole.where("NOT ready").withColumn("provider_call", F.lit(False))
    return _ledger(a, "A", a_ok).unionByName(_ledger(judged, "B", F.col("ok"))).unionByName(_ledger(c, "C", c_ok)).unionByName(_ledger(held, "C", F.lit(False)))
