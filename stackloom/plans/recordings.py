"""Files of recordings made from the relational test data: what a run would
hold, in blocks of BLOCK keys, so that no file grows with the table."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.plans import fixtures as fx
from stackloom.sources import packets

BLOCK = 1000
EVENT, OTHER = 3, 9
FIELDS = {EVENT: [("tstamp", 4, "INT64"), ("thrid", 12, "UINT32"), ("name", 16, "STRING")]}


def packet(kind: int, body: bytes) -> bytes:
    body += bytes(-(4 + len(body)) % 8)
    return struct.pack("<HH", 4 + len(body), kind) + body


def packed(parts: Iterable[bytes]) -> bytes:
    """Packets one after another, none across the end of a chunk."""
    out = bytearray()
    for p in parts:
        room = packets.CHUNK - len(out) % packets.CHUNK
        out += p if len(p) <= room else bytes(room) + p
    return bytes(out)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block, event_id, tstamp, user_id, event_type)"""
    return fx._read(spark, sf_dir, "events").selectExpr(f"event_id DIV {BLOCK} AS block", "event_id", f"{fx._ns('ts')} AS tstamp", "user_id", "event_type")


def files(rows: DataFrame, order: str, encode: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    """(experiment, content): the file that encode makes of the rows of a block."""

    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"experiment": [f"{key[0]}.er"], "content": [encode(block.sort_values(order))]})

    return rows.groupBy("block").applyInPandas(run, "experiment string, content binary")


def event_file(block: pd.DataFrame) -> bytes:
    """An event packet for each row; every seventh has one of another kind before it."""
    parts = []
    for r in block.itertuples():
        if r.event_id % 7 == 0:
            parts.append(packet(OTHER, bytes(8)))
        parts.append(packet(EVENT, struct.pack("<qI", r.tstamp, r.user_id) + r.event_type.encode() + b"\0"))
    return packed(parts)


def frame_file(block: pd.DataFrame) -> bytes:
    """A frame for each row: its stack is the row's number, then the stack of
    the same user's row before."""
    parts, last = [], {}
    for r in block.itertuples():
        link = last.get(r.user_id)
        body = struct.pack("<qq", r.event_id + 1, r.event_id % 100) + (b"" if link is None else struct.pack("<q", link))
        kind = packets.STACK_INFO | (0 if link is None else packets.COMPRESSED)
        parts.append(packet(packets.FRAME_PACKET, struct.pack("<Iq", 16, r.event_id) + struct.pack("<II", 8 + len(body), kind) + body))
        last[r.user_id] = r.event_id + 1
    return packed(parts)


def class_file(block: pd.DataFrame) -> bytes:
    """A class for each order, its lines as methods; every seventh is an array class."""
    text = lambda s: s.encode() + bytes(4 - len(s) % 4)
    parts, open_order = [], None
    for r in block.itertuples():
        if r.l_orderkey != open_order:
            open_order = r.l_orderkey
            name = "[I" if open_order % 7 == 0 else f"Lshop/O{open_order};"
            parts.append(packet(packets.CLASS_RECORD, struct.pack("<Iqq", 0, open_order, open_order * 10) + text(name) + text("O.java")))
        parts.append(packet(packets.METHOD_RECORD, struct.pack("<Iqq", 0, open_order, r.row_id) + text(f"line{r.l_linenumber}") + text("(I)V")))
    return packed(parts)


def snapshot_file(block: pd.DataFrame) -> bytes:
    """A snapshot for each row."""
    out = bytearray(len(block) * packets.SNAPSHOT_SIZE)
    for i, r in enumerate(block.itertuples()):
        at = i * packets.SNAPSHOT_SIZE
        struct.pack_into("<qq", out, at + 8, r.tstamp // 10**9, r.tstamp % 10**9)
        struct.pack_into("<qq", out, at + 72, r.event_id, r.user_id)
        struct.pack_into("<q", out, at + 416, r.user_id)
    return bytes(out)


def log_files(rows: DataFrame, order: str, line: Column, head: str = "") -> DataFrame:
    """(experiment, value): a log of a line for each row of a block."""
    lines = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))).alias("lines"))
    value = F.concat(F.lit(head), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return lines.select(F.concat("block", F.lit(".er")).alias("experiment"), value.alias("value"))


def block_of(experiment: str = "experiment") -> Column:
    return F.regexp_extract(experiment, r"(\d+)\.er$", 1).cast("long").alias("block")


def seconds(ns: Column) -> Column:
    """Nanoseconds as the text of seconds that logs hold."""
    return F.concat(F.call_function("div", ns, F.lit(10**9).cast("long")), F.lit("."), F.lpad((ns % 10**9).cast("string"), 9, "0"))
