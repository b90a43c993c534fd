"""Experiments as directories of files: discovery, groups, logs and maps.

An experiment is a directory whose name ends in ".er". Every reader takes a
path that Spark can open and returns rows with the experiment's path. Logs are
read in splits, so that many tasks share a long one: Spark cuts the text where an element
may begin, and what goes on from one split into the next (an element's end, the profile
and packet that a field belongs to) is carried over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackloom.operators.ranges import Over, running, scan
from stackloom.tables import stored

SUFFIX = ".er"
#: Code, name and displayed name of the thread states of a run that declares none.
DEFAULT_STATES = [
    (0, "USER", "User CPU"), (1, "SYSTEM", "System CPU"), (2, "TRAP", "Trap CPU"), (3, "TFAULT", "Text Page Fault"), (4, "DFAULT", "Data Page Fault"), (5, "KFAULT", "Kernel Page Fault"),
    (6, "USER_LOCK", "User Lock"), (7, "SLEEP", "Sleep"), (8, "WAIT_CPU", "Wait CPU"), (9, "STOPPED", "Stopped"), (10, "LINUX_CPU", "User+System CPU"), (11, "KERNEL_CPU", "Kernel CPU"),
]
#: Fixed value: number of the warning that files are written to a file system that may distort a run.
WARN_FILE_SYSTEM = 201
#: Fixed value: the first line of a group file.
GROUP_HEADER = "#analyzer experiment group"
_ELEMENT = r"<([A-Za-z_][\w.-]*)((?:\s+[\w.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(?:/>|>([^<]*)</\1>|>)"
_TAG = r"^([A-Za-z_][\w.-]*)((?:\s+[\w.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*+)\s*(/?)>"
_ATTRIBUTE = r"([\w.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"


def _experiment(path: Column | str) -> Column:
    return F.regexp_extract(path, r"^(.*\.er)/", 1)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(experiment, n_files, n_bytes, status) of the experiments below a path;
    without a log the status says so."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    rows = files.where(F.col("path").rlike(r"\.er/[^/]+$")).withColumn("experiment", _experiment("path"))
    per = rows.groupBy("experiment").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"), F.max(F.col("path").endswith("/log.xml")).alias("__log"))
    return per.select("experiment", "n_files", "n_bytes", F.when(F.col("__log"), "ok").otherwise("no log").alias("status"))


def read_groups(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """group_entries() of group files."""
    return group_entries(spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("group"), "value"))


def group_entries(files: DataFrame) -> DataFrame:
    """(group, ord, experiment): the paths that group files (group, value)
    list. Files without the header list nothing; comments and empty lines are
    skipped."""
    text = files.select("group", F.split("value", "\r?\n").alias("lines"))
    lines = text.where(F.trim(F.element_at("lines", 1)) == GROUP_HEADER).select("group", F.posexplode("lines").alias("ord", "line"))
    kept = lines.where(~F.col("line").startswith("#") & (F.trim("line") != ""))
    return kept.select("group", "ord", F.split(F.trim("line"), r"\s+")[0].alias("experiment"))


def open_all(entries: DataFrame) -> DataFrame:
    """Adds exp_id to what group_entries() gives: the runs of all groups as one
    union, numbered 1, 2, 3 ... by group and place. A run that is listed twice
    is opened twice."""
    return running(entries, [], ["group", "ord"], {"exp_id": F.lit(1).cast("long")})


def number_experiments(experiments: DataFrame) -> DataFrame:
    """Adds exp_id: 1, 2, 3 ... by path."""
    numbers = experiments.select("experiment").distinct().withColumn("exp_id", F.row_number().over(Window.orderBy("experiment")))
    return experiments.join(numbers, "experiment")


def _unescape(c: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def read_elements(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """elements() of files of any size. A "<" begins a tag and nothing else, so
    the text is read as the pieces between them, which Spark deals to tasks by
    splits of the file; pieces are in order within a split, and splits by where they begin."""
    text = spark.read.option("lineSep", "<").text(paths if isinstance(paths, str) else list(paths))
    pieces = text.select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), "value")
    # a piece is matched once, and the length of its tag kept; what is made of it is written once, since users go over the elements several times
    pieces = pieces.withColumn("__tag", F.length(F.regexp_extract("value", _TAG, 0)))
    closes = F.when(F.col("value").startswith("/"), F.regexp_extract("value", r"^/([A-Za-z_][\w.-]*)>", 1)).otherwise(F.lit(""))
    made = {"ord": Over("total", F.when(F.col("__tag") > 0, 1).otherwise(0).cast("long")), "closed": Over("next", closes)}
    found = scan(pieces, ["file"], ["split", "place"], made, "split").where("__tag > 0")
    found = found.withColumn("tag", F.substring("value", F.lit(1), F.col("__tag"))).withColumn("element", F.regexp_extract("tag", r"^[A-Za-z_][\w.-]*", 0))
    # the text of an element that nothing else stands in
    inner = F.when(~F.col("tag").endswith("/>") & (F.col("closed") == F.col("element")), F.substring("value", F.col("__tag") + 1, F.length("value"))).otherwise(F.lit(""))
    return stored(found.select(_experiment("file").alias("experiment"), (F.col("ord") - 1).alias("ord"), "element", _attributes(F.col("tag")).alias("attributes"), _unescape(inner).alias("text")), "elements")


def _attributes(raw: Column) -> Column:
    """name="value" ... as a map; of a name that stands twice, the first counts."""
    names, quoted, single = (F.regexp_extract_all(raw, F.lit(_ATTRIBUTE), F.lit(g)) for g in (1, 2, 3))
    values = F.transform(F.zip_with(quoted, single, lambda d, s: F.concat(d, s)), lambda v: F.when(F.contains(v, F.lit("&")), _unescape(v)).otherwise(v))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    first = F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(names, p["k"]) == i + 1))
    return F.when(F.size(F.array_distinct(names)) == F.size(names), F.map_from_arrays(names, values)).otherwise(first)


def elements(files: DataFrame) -> DataFrame:
    """(experiment, ord, element, attributes map<string,string>, text) of files
    (experiment, value) of XML fragments without a root."""
    found = files.select("experiment", F.posexplode(F.regexp_extract_all("value", F.lit(_ELEMENT), F.lit(0))).alias("ord", "__raw"))
    raw = F.regexp_extract("__raw", _ELEMENT, 2)
    return found.select("experiment", "ord", F.regexp_extract("__raw", _ELEMENT, 1).alias("element"), _attributes(raw).alias("attributes"), _unescape(F.regexp_extract("__raw", _ELEMENT, 3)).alias("text"))


def log_events(elements: DataFrame) -> DataFrame:
    """(experiment, ord, kind, tstamp, attributes, text) of event elements."""
    from stackloom.functions.text import time_ns

    rows = elements.where("element = 'event'")
    return rows.select("experiment", "ord", F.col("attributes")["kind"].alias("kind"), time_ns(F.col("attributes")["tstamp"]).alias("tstamp"), "attributes", "text")


def schema_declarations(elements: DataFrame) -> DataFrame:
    """(experiment, profile, packet_kind, field, offset, type, ord): declared
    columns; a repeated declaration of a field is ignored."""
    a = F.col("attributes")
    rows = elements.where("element IN ('profile', 'profpckt', 'field')").select("experiment", "ord", "element", a["name"].alias("field"), a["kind"].alias("kind"), F.when(F.col("element") == "field", a["offset"]).cast("int").alias("offset"), a["type"].alias("type"))
    within = {"profile": Over("latest", F.when(F.col("element") == "profile", F.col("field"))), "packet": Over("latest", F.when(F.col("element") == "profpckt", F.col("kind")))}
    rows = scan(rows, ["experiment"], ["ord"], within)
    fields = rows.where("element = 'field'").select("experiment", "profile", F.col("packet").cast("int").alias("packet_kind"), "field", "offset", "type", "ord")
    return fields.groupBy("experiment", "profile", "packet_kind", "field").agg(F.min(F.struct("ord", "offset", "type")).alias("f")).select("experiment", "profile", "packet_kind", "field", "f.offset", "f.type", "f.ord")


def state_names(elements: DataFrame) -> DataFrame:
    """(experiment, field, value, name, uname) from state elements, which stand
    inside the field that they belong to."""
    a = F.col("attributes")
    rows = elements.where("element IN ('field', 'state')").select("experiment", "ord", "element", F.when(F.col("element") == "state", a["value"]).cast("int").alias("value"), a["name"].alias("name"), F.coalesce(a["uname"], a["name"]).alias("uname"))
    rows = scan(rows, ["experiment"], ["ord"], {"field": Over("latest", F.when(F.col("element") == "field", F.col("name")))})
    return rows.where("element = 'state'").select("experiment", "field", "value", "name", "uname")


def default_states(rows: DataFrame, field: str = "mstate") -> DataFrame:
    """(experiment, field, value, name, uname) for the experiments in rows: the
    thread states of a run whose log declares none."""
    listed = F.array(*[F.struct(F.lit(code).alias("value"), F.lit(name).alias("name"), F.lit(shown).alias("uname")) for code, name, shown in DEFAULT_STATES])
    return rows.select("experiment").distinct().select("experiment", F.lit(field).alias("field"), F.inline(listed))


def label_states(rows: DataFrame, states: DataFrame | None, field: str) -> DataFrame:
    """rows with the name of the code in a column of that name. Without
    declared states those of default_states count."""
    states = default_states(rows, field) if states is None else states
    names = states.where(F.col("field") == field).select("experiment", F.col("value").alias(field), F.col("uname").alias(f"{field}_name"))
    return rows.join(names, ["experiment", field], "left")


def messages(elements: DataFrame) -> DataFrame:
    """(experiment, ord, kind, id, errno, text) of errors, warnings and comments."""
    a = F.col("attributes")
    kinds = {"cerror": "error", "cwarn": "warning", "comment": "comment"}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[a["kind"]]
    rows = elements.where((F.col("element") == "event") & kind.isNotNull())
    return rows.select("experiment", "ord", kind.alias("kind"), a["id"].cast("int").alias("id"), a["ec"].cast("int").alias("errno"), F.coalesce(a["text"], F.nullif("text", F.lit("")), F.lit("")).alias("text"))


def messages_by_run(found: DataFrame) -> DataFrame:
    """(experiment, kind, n, texts) with the texts in the order of the log."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda m: m["text"])
    return found.groupBy("experiment", "kind").agg(F.count("*").alias("n"), texts.alias("texts"))


def message_queues(elements: DataFrame, ignore_fs_warnings: bool = False) -> DataFrame:
    """(experiment, ord, queue, id, text) as they are shown: a comment's text
    attribute is a note; what has no number is dropped else; an error's system error
    follows its text. Warnings of file systems that may distort a run can go to the comments."""
    a = F.col("attributes")
    queue = F.create_map(*[F.lit(x) for kv in {"cerror": "error", "cwarn": "warning", "comment": "comment"}.items() for x in kv])[a["kind"]]
    number, errno = a["id"].try_cast("int"), F.coalesce(F.when(a["kind"] == "cerror", a["ec"].try_cast("int")), F.lit(0))
    moved = F.lit(ignore_fs_warnings) & (queue == "warning") & (number == WARN_FILE_SYSTEM)
    said = F.concat(F.coalesce("text", F.lit("")), F.when(errno > 0, F.concat(F.lit(" -- errno "), errno.cast("string"))).otherwise(F.lit("")))
    note = F.struct(F.lit(0).alias("part"), F.lit("comment").alias("queue"), F.lit(None).cast("int").alias("id"), F.concat(F.lit("*** Note: "), a["text"]).alias("text"))
    message = F.struct(F.lit(1).alias("part"), F.when(moved, F.lit("comment")).otherwise(queue).alias("queue"), number.alias("id"), said.alias("text"))
    both = F.filter(F.array(F.when((queue == "comment") & a["text"].isNotNull(), note), F.when(number >= 0, message)), lambda m: m.isNotNull())
    rows = elements.where((F.col("element") == "event") & queue.isNotNull())
    return rows.select("experiment", "ord", F.inline(both)).select("experiment", (2 * F.col("ord") + F.col("part")).alias("ord"), "queue", "id", "text")


def map_records(elements: DataFrame) -> DataFrame:
    """(experiment, ord, kind, object_type, tstamp, base, size, name) of map and
    unmap events. Of segments only readable and executable ones stay, and those
    without a name are dropped."""
    from stackloom.functions.text import c_number, time_ns

    a = F.col("attributes")
    rows = elements.where((F.col("element") == "event") & a["kind"].isin("map", "unmap"))
    rows = rows.where((a["kind"] == "unmap") | (a["object"] != "segment") | ((c_number(a["modes"]) == 5) & (F.coalesce(a["name"], F.lit("")) != "")))
    return rows.select("experiment", "ord", a["kind"].alias("kind"), a["object"].alias("object_type"), time_ns(a["tstamp"]).alias("tstamp"), c_number(a["vaddr"]).alias("base"), c_number(a["size"]).alias("size"), a["name"].alias("name"))


def read_notes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(experiment, line) of notes files."""
    return spark.read.text(paths if isinstance(paths, str) else list(paths)).select(_experiment(F.input_file_name()).alias("experiment"), F.col("value").alias("line"))


def preview(spark: SparkSession, root: str, log: str = "log.xml", notes: str = "notes") -> DataFrame:
    """(experiment, ord, element, attributes, text) from logs, and notes as
    elements of their own; no event data is read. log and notes are the names of files,
    or of folders of files."""
    logs = read_elements(spark, f"{root}/*{SUFFIX}/{log}").select("experiment", "ord", "element", "attributes", "text")
    found = spark.read.option("recursiveFileLookup", "true")
    found = found.option("pathGlobFilter", notes).text(root) if notes == "notes" else found.text(f"{root}/*{SUFFIX}/{notes}")
    lines = found.select(_experiment(F.input_file_name()).alias("experiment"), F.monotonically_increasing_id().alias("ord"), F.lit("note").alias("element"), F.lit(None).cast("map<string,string>").alias("attributes"), F.col("value").alias("text"))
    return logs.unionByName(lines)


def preview_sections(found: DataFrame) -> DataFrame:
    """(experiment, section, place, text) of a preview: the lines of header,
    errors, warnings and notes of each run; a section without any says so."""
    titles = {"comment": ("Experiment header", "Empty header"), "error": ("Error message", "No errors"), "warning": ("Warning message", "No warnings"), "note": ("Notes", "")}
    notes = found.where("element = 'note'").select("experiment", "ord", F.lit("note").alias("queue"), "text")
    lines = message_queues(found.where("element <> 'note'")).select("experiment", "ord", "queue", "text").unionByName(notes)
    listed = F.array(*[F.struct(F.lit(q).alias("queue"), F.lit(title).alias("section"), F.lit(none).alias("none")) for q, (title, none) in titles.items()])
    every = found.select("experiment").distinct().select("experiment", F.inline(listed))
    placed = running(lines, ["experiment", "queue"], ["ord"], {"place": F.lit(1).cast("long")})
    return every.join(placed, ["experiment", "queue"], "left").select("experiment", "section", F.coalesce("place", F.lit(0)).alias("place"), F.coalesce("text", "none").alias("text"))
