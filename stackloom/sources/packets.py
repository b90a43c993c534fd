"""Binary recordings: event packets, frame packets, class files, snapshots.

Files are read as whole, one per task and row; what a file declares decides
which columns come out. Little-endian throughout.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the file format.
CHUNK = 16_384
FRAME_PACKET, UID_PACKET = 11, 17
STACK_INFO, JAVA_INFO, OMP_INFO, OMP2_INFO = 1, 2, 3, 5
COMPRESSED = 0x80000000
CLASS_RECORD, METHOD_RECORD = 10 << 8 | 3, 11 << 8 | 3
SNAPSHOT_SIZE = 8 + 20 * 16 + 22 * 8
CONFLICT = -1
_FORMATS = {"INT32": "<i", "UINT32": "<I", "INT64": "<q", "UINT64": "<q"}
#: counters of a snapshot, by offset: pairs of seconds and nanoseconds, then plain ones
_TIMES = {"create": 24, "term": 40, "rtime": 56, "utime": 72, "stime": 88, "ttime": 104, "tftime": 120, "dftime": 136, "kftime": 152, "ltime": 168, "slptime": 184, "wtime": 200, "stoptime": 216}
_COUNTS = {"minf": 328, "majf": 336, "nswap": 344, "inblk": 352, "oublk": 360, "msnd": 368, "mrcv": 376, "sigs": 384, "vctx": 392, "ictx": 400, "sysc": 408, "ioch": 416}
COUNTERS = (*_TIMES, *_COUNTS)
#: packets that are decoded at a time
BLOCK = 10_000


def _walk(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(offset, size, kind) of the packets of a file. Size 0 goes on at the
    next chunk; a packet that the file cuts short ends it."""
    at, end = 0, len(data)
    while end - at >= 4:
        size, kind = struct.unpack_from("<HH", data, at)
        if size == 0:
            at += CHUNK - at % CHUNK
            continue
        if at + size > end:
            return
        yield at, size, kind
        at += size


def packets(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, kind, packet) of a file."""
    for at, size, kind in _walk(data):
        yield at, kind, data[at : at + size]


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(experiment, content) of the files of a path."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"^(.*\.er)/", 1).alias("experiment"), "content")


def _decoded(files: DataFrame, decode: Callable[[bytes], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """The frames that decode makes of each file, with its experiment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for experiment, content in zip(batch["experiment"], batch["content"], strict=True):
                for out in decode(content):
                    out.insert(0, "experiment", experiment)
                    yield out

    return files.select("experiment", "content").mapInPandas(run, f"experiment string, {schema}")


def read_events(spark: SparkSession, path: str, fields: Mapping[int, Sequence[tuple[str, int, str]]]) -> DataFrame:
    """decode_events() of files."""
    return decode_events(files_of(spark, path), fields)


def decode_events(files: DataFrame, fields: Mapping[int, Sequence[tuple[str, int, str]]]) -> DataFrame:
    """(experiment, kind, row_id, one column for each declared field) of event
    packets; fields: kind -> (name, offset, type). Kinds that aren't declared
    are skipped; unsigned 32-bit values keep their value. Rows are numbered by
    kind, and the fields of BLOCK packets of a kind are taken out at a time."""
    fields = {k: list(v) for k, v in fields.items()}
    types = {n: t for fs in fields.values() for n, _, t in fs}

    def rows(data: bytes, kind: int, first: int, found: list[tuple[int, int]]) -> pd.DataFrame:
        at, size = np.array(found, dtype="int64").T
        out = {"kind": np.full(len(at), kind), "row_id": np.arange(first, first + len(at))}
        for name, t in types.items():
            out[name] = pd.array([None] * len(at), dtype=object if t == "STRING" else "Int64")
        for name, offset, t in fields[kind]:
            if t == "STRING":
                out[name] = [data[a + offset : a + s].split(b"\0", 1)[0].decode("ascii", "replace") or None for a, s in found]
            elif t in _FORMATS:
                out[name] = _integers(data, at + offset, offset + np.dtype(_FORMATS[t]).itemsize <= size, _FORMATS[t])
        return pd.DataFrame(out)

    def decode(data: bytes) -> Iterator[pd.DataFrame]:
        found: dict[int, list[tuple[int, int]]] = {k: [] for k in fields}
        done = dict.fromkeys(fields, 0)
        for at, size, kind in _walk(data):
            if kind in found:
                found[kind].append((at, size))
                if len(found[kind]) == BLOCK:
                    yield rows(data, kind, done[kind], found[kind])
                    done[kind] += BLOCK
                    found[kind] = []
        for kind, left in found.items():
            if left:
                yield rows(data, kind, done[kind], left)

    return _decoded(files, decode, "kind int, row_id long" + "".join(f", `{n}` {'string' if t == 'STRING' else 'long'}" for n, t in types.items()))


def _integers(data: bytes, at: np.ndarray, whole: np.ndarray, form: str) -> pd.api.extensions.ExtensionArray:
    """Integers of a format at places in data; NULL where one isn't whole."""
    places = at[whole, None] + np.arange(np.dtype(form).itemsize)
    values = np.zeros(len(at), dtype="int64")
    values[whole] = np.frombuffer(data, "uint8")[places].view(form)[:, 0]
    return pd.arrays.IntegerArray(values, ~whole)


def _stack(packet: bytes, at: int, size: int, wide: bool, java: bool) -> list[int]:
    if java and wide:  # method numbers of 32 bits and byte offsets of 64 bits take turns, 8 bytes each
        return [struct.unpack_from("<i" if i % 2 == 0 else "<q", packet, at + 8 * i)[0] for i in range(size // 8)]
    if wide:
        return list(struct.unpack_from(f"<{size // 8}q", packet, at))
    marks = {0xFFFFFFFF: -1, 0xFFFFFFFE: -2, 0xFFFFFFFD: -3}
    return [marks.get(v, v) for v in struct.unpack_from(f"<{size // 4}I", packet, at)]


def frame_records(data: bytes, wide: bool = True) -> Iterator[tuple]:
    """('frame', frinfo, uid_native, uid_java, omp_state, None, None) and ('uid',
    uid, None, None, None, values, link) of a file of frame packets."""
    for _, kind, p in packets(data):
        if kind == UID_PACKET and len(p) > 16:
            flags, uid = struct.unpack_from("<IQ", p, 4)
            size, link = len(p) - 16, 0
            if flags & COMPRESSED:
                size -= 8
                link = struct.unpack_from("<q", p, 16 + size)[0]
            yield "uid", uid, None, None, None, _stack(p, 16, size, wide, False), link
        elif kind == FRAME_PACKET:
            at, frame = struct.unpack_from("<Iq", p, 4)
            native = java = omp = None
            while at + 8 <= len(p):
                size, sub = struct.unpack_from("<II", p, at)
                if size == 0 or at + size > len(p):
                    break
                what = sub & ~COMPRESSED
                if what in (STACK_INFO, JAVA_INFO):
                    uid = struct.unpack_from("<q", p, at + 8)[0]
                    length, link = size - 16, 0
                    if length > 0:
                        if sub & COMPRESSED:
                            length -= 8
                            link = struct.unpack_from("<q", p, at + 16 + length)[0]
                        yield "uid", uid, None, None, None, _stack(p, at + 16, length, wide, what == JAVA_INFO), link
                    native, java = (uid, java) if what == STACK_INFO else (native, uid)
                elif what in (OMP_INFO, OMP2_INFO):
                    omp = struct.unpack_from("<I", p, at + 8)[0]
                at += size
            yield "frame", frame, native, java, omp, None, None


def read_frames(spark: SparkSession, path: str, wide: bool = True) -> DataFrame:
    """decode_frames() of files."""
    return decode_frames(files_of(spark, path), wide)


def decode_frames(files: DataFrame, wide: bool = True) -> DataFrame:
    """(experiment, record, id, uid_native, uid_java, omp_state, values, link)
    of frame files, as frame_records() gives them."""

    def decode(data: bytes) -> Iterator[pd.DataFrame]:
        for block in batched(frame_records(data, wide), BLOCK):
            out = pd.DataFrame(block, columns=["record", "id", "uid_native", "uid_java", "omp_state", "values", "link"])
            yield out.astype({c: "Int64" for c in ("id", "uid_native", "uid_java", "omp_state", "link")})

    return _decoded(files, decode, "record string, id long, uid_native long, uid_java long, omp_state long, values array<long>, link long")


def merge_nodes(uids: DataFrame) -> DataFrame:
    """(experiment, id, values, link): one row for each uid; where two records
    of one differ in a value, the conflict marker stands for it."""
    each = uids.where("record = 'uid' AND id <> 0").select("experiment", "id", "link", F.posexplode("values").alias("pos", "v"))
    per = each.groupBy("experiment", "id", "pos").agg(F.when(F.min("v") != F.max("v"), F.lit(CONFLICT)).otherwise(F.min("v")).cast("long").alias("v"), F.max("link").alias("link"))
    return per.groupBy("experiment", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("values"), F.max("link").alias("link"))


def flatten_stacks(nodes: DataFrame, rounds: int = 40) -> DataFrame:
    """(experiment, id, stack): values followed by those of all linked nodes.
    A link to itself, to nothing, or back into the chain ends it.

    Lists are ranked by jumps that double in length each round, on the numbers
    of nodes alone: what a node knows of the nodes less than 2^k ahead of it and what
    the node 2^k ahead knows of those ahead of itself are all nodes less than 2^(k+1)
    ahead. Values are joined once, at the end. In a chain that runs into a
    circle nodes come again at larger distances; their first place counts, and
    the rounds end where no node is new to any chain."""
    from stackloom.tables import stored

    key = ["experiment", "id"]
    nodes = stored(nodes, "nodes")  # every round asks for them, and they come from files
    link = F.when((F.col("link") != F.col("id")) & (F.col("link") != 0), F.col("link"))
    ids = nodes.select("experiment", F.col("id").alias("jump"))
    jumps = stored(nodes.select(*key, link.alias("jump")).where("jump IS NOT NULL").join(ids, ["experiment", "jump"], "left_semi").select(*key, "jump"), "jumps")
    known = [nodes.select(*key, F.col("id").alias("node"), F.lit(0).cast("long").alias("far"))]
    size = 1
    for _ in range(rounds):
        if jumps.isEmpty():
            break
        so_far = known[0]
        for part in known[1:]:
            so_far = so_far.unionByName(part)
        ahead = so_far.select("experiment", F.col("id").alias("jump"), "node", (F.col("far") + size).alias("far"))
        fresh = jumps.join(ahead, ["experiment", "jump"]).select(*key, "node", "far").join(so_far.select(*key, "node"), [*key, "node"], "left_anti")
        fresh = stored(fresh, "ranked")
        # a jump is of use as long as it led its node to something new
        useful = fresh.select(*key).distinct()
        further = jumps.select("experiment", F.col("id").alias("jump"), F.col("jump").alias("__next"))
        jumps = stored(jumps.join(useful, key, "left_semi").join(further, ["experiment", "jump"]).select(*key, F.col("__next").alias("jump")), "jumps")
        known.append(fresh)
        size *= 2
    else:
        if not jumps.isEmpty():
            raise RuntimeError(f"stacks are longer than {rounds} rounds can join")
    ranked = known[0]
    for part in known[1:]:
        ranked = ranked.unionByName(part)
    # within a round a circle can give a node two distances
    ranked = ranked.groupBy(*key, "node").agg(F.min("far").alias("far")) if len(known) > 1 else ranked
    pieces = ranked.join(nodes.select("experiment", F.col("id").alias("node"), "values"), ["experiment", "node"])
    return pieces.groupBy(*key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("far", "values"))), lambda p: p["values"])).alias("stack"))


def _text(packet: bytes, at: int) -> tuple[str, int]:
    """A string that ends with a zero, and where the next begins: padded to 4."""
    raw = packet[at:].split(b"\0", 1)[0]
    return raw.decode("utf-8", "replace"), at + ((len(raw) + 4) & ~3)


def class_records(data: bytes) -> Iterator[tuple]:
    """(ord, record, id, tstamp, name, extra) of a file of classes and methods."""
    for i, (_, kind, p) in enumerate(packets(data)):
        if kind in (CLASS_RECORD, METHOD_RECORD):
            name, at = _text(p, 24)
            extra, _ = _text(p, at)
            first, second = struct.unpack_from("<qq", p, 8)
            is_class = kind == CLASS_RECORD
            yield i, "class" if is_class else "method", first if is_class else second, second if is_class else None, name, extra


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """decode_classes() of files."""
    return decode_classes(files_of(spark, path))


def decode_classes(files: DataFrame) -> DataFrame:
    """(experiment, ord, record, id, tstamp, name, extra): classes with their
    source file, and methods, with their signature, after the class they belong
    to."""

    def decode(data: bytes) -> Iterator[pd.DataFrame]:
        for block in batched(class_records(data), BLOCK):
            yield pd.DataFrame(block, columns=["ord", "record", "id", "tstamp", "name", "extra"]).astype({"tstamp": "Int64"})

    return _decoded(files, decode, "ord long, record string, id long, tstamp long, name string, extra string")


def method_versions(classes: DataFrame) -> DataFrame:
    """(experiment, id, from_ns, function, signature): methods under the name
    of the class before them, from when that was loaded; methods of array
    classes are dropped."""
    from pyspark.sql import Window

    from stackloom.functions.text import dotted_name

    w = Window.partitionBy("experiment").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("record") == "class", F.struct("name", "tstamp")), True).over(w)
    rows = classes.withColumn("__class", owner).where("record = 'method' AND startswith(__class.name, 'L')")
    return rows.select("experiment", "id", F.col("__class.tstamp").alias("from_ns"), F.concat(dotted_name(F.col("__class.name")), F.lit("."), F.col("name")).alias("function"), F.col("extra").alias("signature"))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """decode_snapshots() of files."""
    return decode_snapshots(files_of(spark, path))


def decode_snapshots(files: DataFrame) -> DataFrame:
    """(experiment, rec, tstamp, COUNTERS) of resource usage files; a snapshot
    that the file cuts short is left out."""

    def decode(data: bytes) -> Iterator[pd.DataFrame]:
        n = len(data) // SNAPSHOT_SIZE
        words = np.frombuffer(data, "<i8", n * SNAPSHOT_SIZE // 8).reshape(n, SNAPSHOT_SIZE // 8)
        time = lambda at: words[:, at // 8] * 10**9 + words[:, at // 8 + 1]
        yield pd.DataFrame({"rec": np.arange(n), "tstamp": time(8)} | {c: time(at) for c, at in _TIMES.items()} | {c: words[:, at // 8] for c, at in _COUNTS.items()})

    return _decoded(files, decode, "rec long, tstamp long" + "".join(f", {c} long" for c in COUNTERS))


def write_events(events: DataFrame, path: str) -> None:
    """Decoded events as Parquet, one folder for each run and kind."""
    events.write.mode("overwrite").partitionBy("experiment", "kind").parquet(path)
