"""Recordings written here, little-endian, and read back."""

import datetime
import struct

import pytest
from pyspark.sql import functions as F

from stackloom.functions import text as texts
from stackloom.plans import recordings
from stackloom.sources import experiments, packets, reports
from stackloom.streaming.bins import late_rows, store_bins, stored_bins, streamed_bins

FIELDS = {3: [("tstamp", 4, "INT64"), ("thrid", 12, "UINT32"), ("name", 16, "STRING")]}


def event(ts, tid, name):
    body = struct.pack("<qI", ts, tid) + name.encode() + b"\0"
    return struct.pack("<HH", 4 + len(body), 3) + body


def write(tmp_path, name, data, run="a.er"):
    (tmp_path / run).mkdir(exist_ok=True)
    (tmp_path / run / name).write_bytes(data if isinstance(data, bytes) else data.encode())


def test_events(spark, tmp_path):
    first = event(10, 3_000_000_000, "x")
    data = first + b"\0" * (packets.CHUNK - len(first)) + event(11, 2, "") + event(12, 4, "cut")[:-3]
    write(tmp_path, "profile", data)
    rows = packets.read_events(spark, str(tmp_path / "*.er/profile"), FIELDS).orderBy("row_id").collect()
    assert [(r.row_id, r.tstamp, r.thrid, r.name) for r in rows] == [(0, 10, 3_000_000_000, "x"), (1, 11, 2, None)]


def sub(kind, uid, values, link=None):
    body = struct.pack("<q", uid) + struct.pack(f"<{len(values)}q", *values) + (struct.pack("<q", link) if link is not None else b"")
    return struct.pack("<II", 8 + len(body), kind | (packets.COMPRESSED if link is not None else 0)) + body


def frame_packet(uid, *subs):
    body = struct.pack("<Iq", 16, uid) + b"".join(subs)
    return struct.pack("<HH", 4 + len(body), packets.FRAME_PACKET) + body


def test_frames_and_shared_tails(spark, tmp_path):
    data = frame_packet(1, sub(1, 100, [7, 8], 200)) + frame_packet(2, sub(1, 200, [9])) + frame_packet(3, sub(1, 300, [5], 300)) + frame_packet(4, sub(1, 400, [6], 999))
    write(tmp_path, "data.frameinfo", data)
    got = packets.read_frames(spark, str(tmp_path / "*.er/data.frameinfo"))
    assert {(r.id, r.uid_native) for r in got.where("record = 'frame'").collect()} == {(1, 100), (2, 200), (3, 300), (4, 400)}
    nodes = packets.merge_nodes(got)
    assert {r.id: r.stack for r in packets.flatten_stacks(nodes).collect()} == {100: [7, 8, 9], 200: [9], 300: [5], 400: [6]}


def test_conflicting_stacks(spark, tmp_path):
    write(tmp_path, "data.frameinfo", frame_packet(1, sub(1, 100, [7, 8])) + frame_packet(2, sub(1, 100, [7, 9])))
    nodes = packets.merge_nodes(packets.read_frames(spark, str(tmp_path / "*.er/data.frameinfo")))
    assert nodes.first()["values"] == [7, packets.CONFLICT]


def text(s):
    raw = s.encode()
    return raw + b"\0" * (((len(raw) + 4) & ~3) - len(raw))


def test_classes(spark, tmp_path):
    def record(kind, a, b, *strings):
        body = struct.pack("<Iqq", 0, a, b) + b"".join(map(text, strings))
        return struct.pack("<HH", 4 + len(body), kind) + body

    data = record(packets.CLASS_RECORD, 1, 50, "Lp/C;", "C.java") + record(packets.METHOD_RECORD, 1, 77, "run", "()V") + record(packets.CLASS_RECORD, 2, 60, "[I", "") + record(packets.METHOD_RECORD, 2, 78, "gone", "()V")
    write(tmp_path, "jclasses", data)
    rows = packets.method_versions(packets.read_classes(spark, str(tmp_path / "*.er/jclasses"))).collect()
    assert [(r.id, r.from_ns, r.function, r.signature) for r in rows] == [(77, 50, "p.C.run", "()V")]


def test_snapshots(spark, tmp_path):
    one = bytearray(packets.SNAPSHOT_SIZE)
    struct.pack_into("<qq", one, 8, 2, 5)
    struct.pack_into("<qq", one, 72, 1, 7)
    struct.pack_into("<q", one, 416, 42)
    write(tmp_path, "overview", bytes(one) * 2)
    rows = packets.read_snapshots(spark, str(tmp_path / "*.er/overview")).collect()
    assert [(r.rec, r.tstamp, r.utime, r.ioch) for r in rows] == [(0, 2_000_000_005, 1_000_000_007, 42), (1, 2_000_000_005, 1_000_000_007, 42)]


LOG = """<experiment version="12.4">
<profile name="clock">
<profpckt kind="3"><field name="TSTAMP" offset="4" type="INT64"/>
<field name="MSTATE" offset="20" type="INT32"><state value="0" name="USER" uname="User CPU"/></field></profpckt></profile>
<event kind="cerror" tstamp="1.5" id="12" ec="3">a &lt; b</event>
<event kind="map" object="segment" tstamp="2.0" vaddr="0x1000" size="64" modes="0x005" name="lib.so"/>
<event kind="map" object="segment" tstamp="2.0" vaddr="0x2000" size="64" modes="0x006" name="data"/>
<event kind="unmap" tstamp="3.0" vaddr="0x1000"/>
"""


def test_logs(spark, tmp_path):
    write(tmp_path, "log.xml", LOG)
    write(tmp_path, "notes", "hello\n")
    elements = experiments.read_elements(spark, str(tmp_path / "*.er/log.xml")).cache()
    assert [(r.kind, r.id, r.errno, r.text) for r in experiments.messages(elements).collect()] == [("error", 12, 3, "a < b")]
    assert [(r.kind, r.base, r.tstamp) for r in experiments.map_records(elements).orderBy("ord").collect()] == [("map", 4096, 2_000_000_000), ("unmap", 4096, 3_000_000_000)]
    assert {(r.packet_kind, r.field, r.offset, r.type) for r in experiments.schema_declarations(elements).collect()} == {(3, "TSTAMP", 4, "INT64"), (3, "MSTATE", 20, "INT32")}
    assert [(r.field, r.value, r.uname) for r in experiments.state_names(elements).collect()] == [("MSTATE", 0, "User CPU")]
    found = experiments.preview(spark, str(tmp_path))
    assert found.where("element = 'note'").first().text == "hello"


def test_discovery_and_groups(spark, tmp_path):
    write(tmp_path, "log.xml", LOG)
    write(tmp_path, "profile", b"\0" * 8, run="b.er")
    rows = experiments.discover(spark, str(tmp_path)).orderBy("experiment").collect()
    assert [(r.experiment[-4:], r.status) for r in rows] == [("a.er", "ok"), ("b.er", "no log")]
    assert [r.exp_id for r in experiments.number_experiments(experiments.discover(spark, str(tmp_path))).orderBy("experiment").collect()] == [1, 2]
    (tmp_path / "g").write_text("#analyzer experiment group\n# no\n\n a.er extra\nb.er\n")
    (tmp_path / "h").write_text("a.er\n")
    got = experiments.read_groups(spark, [str(tmp_path / "g"), str(tmp_path / "h")]).orderBy("ord").collect()
    assert [r.experiment for r in got] == ["a.er", "b.er"]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    bins = lambda df: streamed_bins(df, "ts", "1 day", "60 days", ["event_type"], {"total": F.floor("value")})
    stream = bins(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("binned").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("binned").collect())) == sorted(map(tuple, bins(events).collect()))


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([("b", 2), ("a", 3), ("<Total>", 5)], "function string, incl long")
    reports.write_text(reports.text_report(table, "incl", 2), str(tmp_path / "text"), 2, "|")
    lines = [line for p in (tmp_path / "text").glob("part-*") for line in p.read_text().splitlines()]
    assert lines == ["function|incl", "<Total>|5", "a|3"]
    reports.write_columns(table, ["incl"], str(tmp_path / "cols"))
    assert spark.read.parquet(str(tmp_path / "cols")).columns == ["incl"]


def test_messages_of_a_run_stay_in_the_order_of_the_log(spark):
    rows = spark.createDataFrame([("a.er", 3, "error", "b"), ("a.er", 1, "error", "z"), ("a.er", 2, "error", "a"), ("a.er", 4, "comment", "c")], "experiment string, ord int, kind string, text string")
    got = {r.kind: (r.n, r.texts) for r in experiments.messages_by_run(rows).collect()}
    assert got == {"error": (3, ["z", "a", "b"]), "comment": (1, ["c"])}


def test_events_of_several_kinds_and_blocks(spark, tmp_path):
    fields = {3: FIELDS[3], 4: [("tstamp", 4, "INT64"), ("flag", 12, "INT32"), ("odd", 4, "FLOAT")]}
    other = lambda ts, *flag: struct.pack("<HHq", 12 + 4 * len(flag), 4, ts) + struct.pack(f"<{len(flag)}i", *flag)
    n = packets.BLOCK + 5
    data = other(-7, -1) + b"".join(event(i, 2**32 - 1, "a") for i in range(n)) + other(8)
    write(tmp_path, "profile", recordings.packed([data]))
    rows = packets.read_events(spark, str(tmp_path / "*.er/profile"), fields).cache()
    assert [(r.row_id, r.tstamp, r.flag, r.odd, r.thrid, r.name) for r in rows.where("kind = 4").orderBy("row_id").collect()] == [(0, -7, -1, None, None, None), (1, 8, None, None, None, None)]
    assert [(r.row_id, r.tstamp, r.thrid) for r in rows.where("kind = 3").orderBy("row_id").collect()] == [(i, i, 2**32 - 1) for i in range(n)]


def test_files_without_a_packet(spark, tmp_path):
    write(tmp_path, "profile", b"")
    path = str(tmp_path / "*.er/profile")
    assert packets.read_events(spark, path, FIELDS).count() == packets.read_frames(spark, path).count() == packets.read_classes(spark, path).count() == packets.read_snapshots(spark, path).count() == 0


def test_runs_of_several_groups_are_one_union(spark):
    files = spark.createDataFrame([("g", "#analyzer experiment group\nb.er\na.er\n"), ("h", "#analyzer experiment group\na.er\n"), ("i", "c.er")], "group string, value string")
    opened = experiments.open_all(experiments.group_entries(files)).orderBy("exp_id").collect()
    assert [(r.exp_id, r.group, r.experiment) for r in opened] == [(1, "g", "b.er"), (2, "g", "a.er"), (3, "h", "a.er")]


@pytest.mark.parametrize("size", [40, 97, 10**6])
def test_a_log_is_read_in_splits(spark, tmp_path, size):
    """Elements that splits cut anywhere, against the whole text in one row."""
    lines = [f'<event kind="k{i % 3}" note="a>b" tstamp="{i}.5">text &lt;{i}&gt;\n</event>' if i % 4 else f"<event kind='k' i='{i}'/>" for i in range(60)]
    head = '<?xml version="1.0"?>\n<experiment v="1">\n<profile name="clock">\n<profpckt kind="3">'
    fields = [f'<field name="f{i}" offset="{i}" type="INT32"><state value="{i}" name="s{i}"/></field>' for i in range(40)]
    whole = head + "\n".join(fields) + "</profpckt></profile>\n" + "\n".join(lines) + "<event kind='last'>open"
    write(tmp_path, "log.xml", whole)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = experiments.read_elements(spark, str(tmp_path / "*.er/log.xml"))
        assert size > 1000 or spark.read.option("lineSep", "<").text(str(tmp_path / "*.er/log.xml")).rdd.getNumPartitions() > 4
        got = [(r.ord, r.element, r.attributes, r.text) for r in found.orderBy("ord").collect()]
        declared = sorted(map(tuple, experiments.schema_declarations(found).select("profile", "packet_kind", "field", "offset").collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    one = experiments.elements(spark.createDataFrame([("x", whole)], "experiment string, value string"))
    assert got == [(r.ord, r.element, r.attributes, r.text) for r in one.orderBy("ord").collect()]
    assert declared == sorted(("clock", 3, f"f{i}", i) for i in range(40))


def test_message_queues(spark):
    rows = [(1, "event", {"kind": "cerror", "id": "5", "ec": "3"}, "bad"), (2, "event", {"kind": "cerror", "ec": "9"}, "dropped"), (3, "event", {"kind": "cwarn", "id": "201"}, "slow"), (4, "event", {"kind": "comment", "text": "hi"}, ""), (5, "event", {"kind": "comment", "text": "ho", "id": "7"}, "more"), (6, "event", {"kind": "cerror", "id": "8", "ec": "0"}, None), (7, "other", {"kind": "cerror", "id": "1"}, "")]
    df = spark.createDataFrame([("a", *r) for r in rows], "experiment string, ord long, element string, attributes map<string,string>, text string")
    shown = lambda ignore: [(r.queue, r.id, r.text) for r in experiments.message_queues(df, ignore).orderBy("ord").collect()]
    want = [("error", 5, "bad -- errno 3"), ("warning", 201, "slow"), ("comment", None, "*** Note: hi"), ("comment", None, "*** Note: ho"), ("comment", 7, "more"), ("error", 8, "")]
    assert shown(False) == want
    assert shown(True) == [("comment", 201, "slow") if m == ("warning", 201, "slow") else m for m in want]


def test_descriptors(spark):
    df = spark.createDataFrame([("(I[[Ljava/lang/String;[D)V",), ("()V",), ("(Q)V",), ("(Lno",), (")(",), (None,), ("(L;",)], "d string")
    got = [r[0] for r in df.select(texts.method_name(F.lit("m"), "d")).collect()]
    assert got == ["m(int, java.lang.String[][], double[])", "m()", "m", "m", "m", "m", "m"]


def test_stored_bins_keep_late_rows_and_survive_a_restart(spark, tmp_path):
    day = lambda d: datetime.datetime(2024, 1, d)
    parts = [[("a", day(1), 1), ("a", day(5), 2)], [("a", day(5), 4), ("b", day(3), 8), ("a", None, 64)], [("b", day(9), 16)], [("a", day(2), 32), ("b", day(9), 128)]]
    schema = "k string, ts timestamp, v long"
    out = str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = store_bins(stream, out, "ts", "1 day", "1 day", ["k"], {"total": F.col("v")}).trigger(availableNow=True).start()
        query.awaitTermination()

    for i, rows in enumerate(parts):  # each run is a new query, which goes on from the checkpoint
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
        if i == 1:  # the micro-batch had been worked through but not committed: it is run again
            (tmp_path / "out/checkpoint/commits/1").unlink()
            (tmp_path / "out/checkpoint/commits/.1.crc").unlink(missing_ok=True)
            run()
    late = sorted((r.k, r.ts.day, r.v, r.batch) for r in late_rows(spark, out).collect())
    assert late == [("a", 2, 32, 3), ("b", 3, 8, 1)]
    bins = lambda late: sorted((r.k, r.start.day, r.n, r.total) for r in stored_bins(spark, out, ["k"], ["total"], late).collect())
    assert bins(False) == [("a", 1, 1, 1), ("a", 5, 2, 6), ("b", 9, 2, 144)]
    batch = streamed_bins(spark.createDataFrame([r for p in parts for r in p], schema), "ts", "1 day", "1 day", ["k"], {"total": F.col("v")})
    assert bins(True) == sorted((r.k, r.start.day, r.n, r.total) for r in batch.collect())


def test_stacks_are_ranked_lists(spark):
    """Chains, trees, links to nothing and circles, against a walk."""
    link = {i: i + 1 for i in range(1, 40)} | {100: 5, 101: 5, 102: 101, 103: 103, 104: 999, 105: 0, 106: None}
    link |= {200: 201, 201: 202, 202: 200, 203: 202, 204: 203, 205: 204, 206: 205, 207: 206, 300: 301, 301: 300} | {i: i + 1 for i in range(400, 406)} | {406: 400}
    link.setdefault(40, None)
    rows = [(e, i, [i, -i] if i % 3 else [i], n) for e in ("x", "y") for i, n in link.items() if e == "x" or i < 30]
    got = packets.flatten_stacks(spark.createDataFrame(rows, "experiment string, id long, values array<long>, link long")).collect()
    want = {}
    for e in ("x", "y"):
        mine = {i: (v, n) for f, i, v, n in rows if f == e}
        for start in mine:
            at, seen, stack = start, set(), []
            while at in mine and at not in seen:
                seen.add(at)
                stack += mine[at][0]
                at = mine[at][1]
            want[e, start] = stack
    assert {(r.experiment, r.id): r.stack for r in got} == want


def test_elements_are_parsed_once(spark, tmp_path):
    """previewed_runs, declared_states, scanned_declarations: users go over the elements again and again."""
    (tmp_path / "a.er").mkdir()
    (tmp_path / "a.er" / "log.xml").write_text("""<event kind="x" a='say "hi"' b="it's &lt;&amp;lt;" kind='y' c = "/>"> 1 &lt; 2 </event>\n<event/><field  name='' ><state value="1"/></field>""")
    found = experiments.read_elements(spark, f"{tmp_path}/*/log.xml")
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = [(r.ord, r.element, r.attributes, r.text) for r in found.orderBy("ord").collect()]
    assert got == [
        (0, "event", {"kind": "x", "a": 'say "hi"', "b": "it's <&lt;", "c": "/>"}, " 1 < 2 "),
        (1, "event", {}, ""),
        (2, "field", {"name": ""}, ""),
        (3, "state", {"value": "1"}, ""),
    ]


def test_stacks_decode_their_nodes_once(spark):
    """recorded_stacks: rounds of ranking go over the nodes, not over the files they come from."""
    decoded = spark.sparkContext.accumulator(0)

    def decode(batches):
        for batch in batches:
            decoded.add(len(batch))
            yield batch

    rows = [("x", i, [i], i + 1 if i < 20 else None) for i in range(1, 21)]
    schema = "experiment string, id long, values array<long>, link long"
    nodes = spark.createDataFrame(rows, schema).mapInPandas(decode, schema)
    got = {r.id: r.stack for r in packets.flatten_stacks(nodes).collect()}
    assert got == {i: list(range(i, 21)) for i in range(1, 21)}
    assert decoded.value == len(rows)


def test_records_of_one_uid_are_merged(spark):
    """Records that differ in a value, in length, or hold a null."""
    rows = [("uid", 1, [5, 6], 0), ("uid", 1, [5, 7, 8], 9), ("uid", 2, [None, 4], 0), ("uid", 2, [3, 4], 0), ("uid", 3, [], 1), ("uid", 0, [1], 1), ("frame", 4, [1], 1)]
    got = packets.merge_nodes(spark.createDataFrame([("x", *r) for r in rows], "experiment string, record string, id long, values array<long>, link long"))
    assert {r["id"]: (r["values"], r["link"]) for r in got.collect()} == {1: ([5, -1, 8], 9), 2: ([3, 4], 0)}
