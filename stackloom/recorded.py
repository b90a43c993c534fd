"""Registered queries of the readers of recordings, and their SQL. Files are
made from the test tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.plans import fixtures as fx
from stackloom.plans import recordings as rec
from stackloom.registry import register
from stackloom.sources import experiments as ingest
from stackloom.sources import packets, reports
from stackloom.tables import folder

_BLOCKS = f"(SELECT event_id // {rec.BLOCK} AS block, event_id, epoch_us(ts) * 1000 AS tstamp, user_id, event_type FROM events)"
_NUMBER = "row_number() OVER (PARTITION BY block ORDER BY event_id)"


@register(f"SELECT block, {_NUMBER} - 1 AS row_id, tstamp, user_id AS thrid, event_type AS name FROM {_BLOCKS}")
def recorded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = rec.files(rec.events(spark, sf_dir), "event_id", rec.event_file)
    return packets.decode_events(files, rec.FIELDS).select(rec.block_of(), "row_id", "tstamp", "thrid", "name")


@register(f"""SELECT block, event_id + 1 AS id, array_to_string(list(event_id % 100) OVER (PARTITION BY block, user_id ORDER BY event_id DESC
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), ',') AS stack FROM {_BLOCKS}""")
def recorded_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = rec.files(rec.events(spark, sf_dir), "event_id", rec.frame_file)
    whole = packets.flatten_stacks(packets.merge_nodes(packets.decode_frames(files)))
    return whole.select(rec.block_of(), "id", F.array_join(F.transform("stack", lambda x: x.cast("string")), ",").alias("stack"))


@register(f"""SELECT l_orderkey // {rec.BLOCK} AS block, l_orderkey * 8 + l_linenumber AS id, l_orderkey * 10 AS from_ns,
  'shop.O' || l_orderkey || '.line' || l_linenumber AS function, '(I)V' AS signature FROM lineitem WHERE l_orderkey % 7 <> 0""")
def recorded_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx._read(spark, sf_dir, "lineitem").selectExpr(f"l_orderkey DIV {rec.BLOCK} AS block", "l_orderkey", "l_linenumber", "l_orderkey * 8 + l_linenumber AS row_id")
    found = packets.method_versions(packets.decode_classes(rec.files(rows, "row_id", rec.class_file)))
    return found.select(rec.block_of(), "id", "from_ns", "function", "signature")


@register(f"SELECT block, {_NUMBER} - 1 AS rec, tstamp, event_id * 1000000000 + user_id AS utime, user_id AS ioch, 0::BIGINT AS minf FROM {_BLOCKS}")
def recorded_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = rec.files(rec.events(spark, sf_dir), "event_id", rec.snapshot_file)
    return packets.decode_snapshots(files).select(rec.block_of(), "rec", "tstamp", "utime", "ioch", "minf")


@register(f"SELECT block, {_NUMBER} - 1 AS ord, event_type AS kind, tstamp, event_id || ' < ' || user_id AS text FROM {_BLOCKS}")
def logged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit('<event kind="'), "event_type", F.lit('" tstamp="'), rec.seconds(F.col("tstamp")), F.lit('">'), "event_id", F.lit(" &lt; "), "user_id", F.lit("</event>"))
    found = ingest.log_events(ingest.elements(rec.log_files(rec.events(spark, sf_dir), "event_id", line)))
    return found.select(rec.block_of(), "ord", "kind", "tstamp", "text")


@register(f"""SELECT block, 'clock' AS profile, 3 AS packet_kind, 'F' || event_id % 5 AS field, arg_min(event_id % 97, event_id) AS "offset", 'INT64' AS type
FROM {_BLOCKS} GROUP BY ALL""")
def logged_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit('<field name="F'), (F.col("event_id") % 5).cast("string"), F.lit('" offset="'), (F.col("event_id") % 97).cast("string"), F.lit('" type="INT64"/>'))
    logs = rec.log_files(rec.events(spark, sf_dir), "event_id", line, '<profile name="clock"><profpckt kind="3">')
    return ingest.schema_declarations(ingest.elements(logs)).select(rec.block_of(), "profile", "packet_kind", "field", "offset", "type")


@register(f"""SELECT block, CASE WHEN event_type = 'error' THEN 'unmap' ELSE 'map' END AS kind, tstamp, user_id * 4096 AS base, event_id % 9 AS size,
  CASE WHEN event_type <> 'error' THEN event_type END AS name FROM {_BLOCKS} WHERE event_type = 'error' OR event_id % 2 = 0""")
def logged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", F.lit('unmap" object="segment')).otherwise(F.concat(F.lit('map" object="segment" name="'), "event_type"))
    modes = F.when(F.col("event_id") % 2 == 0, "0x005").otherwise("0x006")
    line = F.concat(F.lit('<event kind="'), kind, F.lit('" tstamp="'), rec.seconds(F.col("tstamp")), F.lit('" modes="'), modes, F.lit('" vaddr="0x'), F.hex(F.col("user_id") * 4096), F.lit('" size="'), (F.col("event_id") % 9).cast("string"), F.lit('"/>'))
    found = ingest.map_records(ingest.elements(rec.log_files(rec.events(spark, sf_dir), "event_id", line)))
    return found.select(rec.block_of(), "kind", "tstamp", "base", "size", "name")


def _runs(spark: SparkSession, sf_dir: str) -> str:
    """A folder of runs, one for each block of events, with a note for each event."""
    root = f"{folder(spark)}/runs-{uuid.uuid4().hex}"
    rows = rec.events(spark, sf_dir).select(F.concat("block", F.lit(".er")).alias("run"), F.concat(F.lit("note "), "event_id").alias("line"))
    rows.repartition("run").write.partitionBy("run").text(root)
    return root


@register("""SELECT row_number() OVER (ORDER BY 'run=' || block || '.er') AS exp_id, block, n_bytes, 'no log' AS status
FROM (SELECT block, sum(length('note ' || event_id) + 1)::BIGINT AS n_bytes FROM """ + _BLOCKS + " GROUP BY block)")
def discovered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.number_experiments(ingest.discover(spark, _runs(spark, sf_dir)))
    return found.select("exp_id", rec.block_of(), "n_bytes", "status")


@register(f"SELECT block, 'note ' || event_id AS line FROM {_BLOCKS}")
def noted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.read_notes(spark, f"{_runs(spark, sf_dir)}/*").select(rec.block_of(), "line")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files (group, value) that list a run for each event; every third has no header."""
    line = F.concat(F.lit(" u"), "user_id", F.lit(".er more"))
    logs = rec.log_files(rec.events(spark, sf_dir), "event_id", line).withColumn("block", rec.block_of())
    head = F.when(F.col("block") % 3 == 2, "# another file\n").otherwise(ingest.GROUP_HEADER + "\n")
    return logs.select(F.col("block").alias("group"), F.concat(head, "value").alias("value"))


_LISTED = f"SELECT block AS listed_in, {_NUMBER} AS ord, 'u' || user_id || '.er' AS experiment{{}} FROM {_BLOCKS} WHERE block % 3 <> 2"


@register(_LISTED.format(""))
def grouped_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.group_entries(_groups(spark, sf_dir)).select(F.col("group").alias("listed_in"), "ord", "experiment")


@register(_LISTED.format(", row_number() OVER (ORDER BY event_id) AS exp_id"))
def opened_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.open_all(ingest.group_entries(_groups(spark, sf_dir))).select("exp_id", F.col("group").alias("listed_in"), "ord", "experiment")


def _logs(spark: SparkSession, sf_dir: str, line: Column, head: str = "") -> str:
    """A folder of runs, one for each block of events, each with a folder of its
    log, a line for each event, and one of its notes, a line for each tenth event."""
    root = f"{folder(spark)}/logs-{uuid.uuid4().hex}"
    rows = rec.events(spark, sf_dir).select(F.concat("block", F.lit(".er")).alias("run"), "event_id", line.alias("line"))
    heads = rows.groupBy("run").agg(F.lit(-1).cast("long").alias("event_id"), F.lit(head).alias("line")) if head else rows.limit(0)
    logs = rows.unionByName(heads).withColumn("file", F.lit("log"))
    notes = rows.where("event_id % 10 = 0").select("run", "event_id", F.concat(F.lit("note "), "event_id").alias("line"), F.lit("notes").alias("file"))
    both = logs.unionByName(notes).repartition("run", "file").sortWithinPartitions("run", "file", "event_id")
    both.select("run", "file", "line").write.partitionBy("run", "file").text(root)
    return root


_LOG = "file=log"


@register(f"SELECT block, {_NUMBER} - 1 AS ord, event_type AS kind, tstamp, event_id || ' < ' || user_id AS text FROM {_BLOCKS}")
def scanned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit('<event kind="'), "event_type", F.lit('" tstamp="'), rec.seconds(F.col("tstamp")), F.lit('">'), "event_id", F.lit(" &lt; "), "user_id", F.lit("</event>"))
    found = ingest.log_events(ingest.read_elements(spark, f"{_logs(spark, sf_dir, line)}/*/{_LOG}"))
    return found.select(rec.block_of(), "ord", "kind", "tstamp", "text")


@register(f"""SELECT block, 'clock' AS profile, 3 AS packet_kind, 'F' || event_id % 5 AS field, arg_min(event_id % 97, event_id) AS "offset", 'INT64' AS type
FROM {_BLOCKS} GROUP BY ALL""")
def scanned_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit('<field name="F'), (F.col("event_id") % 5).cast("string"), F.lit('" offset="'), (F.col("event_id") % 97).cast("string"), F.lit('" type="INT64"/>'))
    root = _logs(spark, sf_dir, line, '<profile name="clock"><profpckt kind="3">')
    found = ingest.schema_declarations(ingest.read_elements(spark, f"{root}/*/{_LOG}"))
    return found.select(rec.block_of(), "profile", "packet_kind", "field", "offset", "type")


@register(f"""SELECT block, event_id, event_id % 5 AS "STATE", CASE WHEN event_id % 5 IN (SELECT event_id % 4 FROM {_BLOCKS} i WHERE i.block = o.block) THEN 'State ' || event_id % 5 END AS "STATE_name" FROM {_BLOCKS} o""")
def declared_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events labelled with the states that the log of their run declares."""
    code = (F.col("event_id") % 4).cast("string")
    line = F.concat(F.lit('<state value="'), code, F.lit('" name="S'), code, F.lit('" uname="State '), code, F.lit('"/>'))
    root = _logs(spark, sf_dir, line, '<profile name="clock"><profpckt kind="3"><field name="OTHER"><state value="4" name="no"/></field><field name="STATE">')
    declared = ingest.state_names(ingest.read_elements(spark, f"{root}/*/{_LOG}")).withColumn("experiment", rec.block_of()).distinct()
    rows = rec.events(spark, sf_dir).select(F.col("block").alias("experiment"), "event_id", (F.col("event_id") % 5).alias("STATE"))
    return ingest.label_states(rows, declared, "STATE").select(F.col("experiment").alias("block"), "event_id", "STATE", "STATE_name")


_QUEUES = f"""queued AS (
  SELECT block, event_id, 0 AS part, 'comment' AS queue, NULL AS id, '*** Note: n' || event_id AS text FROM {_BLOCKS} WHERE event_type = 'view' AND event_id % 3 = 0
  UNION ALL SELECT block, event_id, 1, CASE WHEN event_type = 'click' AND event_id % 50 + 190 <> 201 THEN 'warning' WHEN event_type = 'error' THEN 'error' ELSE 'comment' END, event_id % 50 + 190,
    'm' || event_id || CASE WHEN event_type = 'error' AND event_id % 4 > 0 THEN ' -- errno ' || event_id % 4 ELSE '' END
  FROM {_BLOCKS} WHERE event_type IN ('error', 'click', 'view') AND event_id % 7 > 0)"""


def _message_lines() -> Column:
    """Errors, warnings and comments, some without a number or with a system error."""
    kind = F.when(F.col("event_type") == "error", "cerror").when(F.col("event_type") == "click", "cwarn").when(F.col("event_type") == "view", "comment").otherwise("sample")
    number = F.when(F.col("event_id") % 7 > 0, F.concat(F.lit(' id="'), (F.col("event_id") % 50 + 190).cast("string"), F.lit('"'))).otherwise(F.lit(""))
    said = F.when((F.col("event_type") == "view") & (F.col("event_id") % 3 == 0), F.concat(F.lit(' text="n'), "event_id", F.lit('"'))).otherwise(F.lit(""))
    return F.concat(F.lit('<event kind="'), kind, F.lit('"'), number, said, F.lit(' ec="'), (F.col("event_id") % 4).cast("string"), F.lit('">m'), "event_id", F.lit("</event>"))


@register("SELECT block, queue, id, text FROM queued", _QUEUES)
def collected_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = ingest.read_elements(spark, f"{_logs(spark, sf_dir, _message_lines())}/*/{_LOG}")
    return ingest.message_queues(elements, ignore_fs_warnings=True).select(rec.block_of(), "queue", F.col("id").cast("long").alias("id"), "text")


@register(f"""SELECT block, section, coalesce(place, 0) AS place, coalesce(text, missing) AS text FROM (
  SELECT * FROM (SELECT DISTINCT block FROM {_BLOCKS}), (VALUES ('comment', 'Experiment header', 'Empty header'), ('error', 'Error message', 'No errors'), ('warning', 'Warning message', 'No warnings'), ('note', 'Notes', '')) s(queue, section, missing)
) LEFT JOIN (SELECT block, queue, text, row_number() OVER (PARTITION BY block, queue ORDER BY event_id, part) AS place FROM (
  SELECT block, event_id, part, CASE WHEN queue = 'comment' AND id = 201 AND said = 'click' THEN 'warning' ELSE queue END AS queue, text FROM (SELECT q.*, e.event_type AS said FROM queued q JOIN {_BLOCKS} e USING (event_id))
  UNION ALL SELECT block, event_id, 0, 'note', 'note ' || event_id FROM {_BLOCKS} WHERE event_id % 10 = 0)) USING (block, queue)""", _QUEUES)
def previewed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header, messages and notes of every run, from its log and notes alone."""
    found = ingest.preview(spark, _logs(spark, sf_dir, _message_lines()), _LOG, "file=notes")
    return ingest.preview_sections(found).select(rec.block_of(), "section", "place", "text")


@register("SELECT event_type AS function, sum(CAST(floor(value) AS BIGINT))::BIGINT AS e_cpu FROM events GROUP BY ALL")
def written_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible columns of a result, written and read back."""
    table = fx._read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("function")).agg(F.sum(F.floor("value")).cast("long").alias("e_cpu"), F.count("*").alias("i_cpu"))
    path = f"{folder(spark)}/columns-{uuid.uuid4().hex}"
    reports.write_columns(table, ["function", "e_cpu"], path)
    return spark.read.parquet(path)
