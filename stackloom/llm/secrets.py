"""Secret scan with a random forest against false positives, in DataFrame
operations only.

Candidates are issued key formats wherever they stand, private key blocks (cut
off ones too), what is assigned to a key word, passwords in addresses, and other
runs of key-like characters with a digit in them. Each is described by its
length, its character transitions, how much of it dictionary words cover, its
path, and the words beside it. A random forest trained from labelled findings
scores every candidate; those that score at least a threshold are secrets.

``scan`` takes labelled findings: candidates with a label. Where there are none,
``seed_labels`` labels those that their format settles (issued formats, long keys
assigned to a key word; mail and host addresses, numbers, placeholders). What it
asks for (prefixes, placeholders, whole shapes) is not among the features, so
the forest has to carry it over by shape, path and neighbouring words. Training
uses at most ``sample`` findings, the first by a hash.

Null and empty texts have no candidates. Repeated rows, and rows with one id,
give a finding each; columns but id, text and path aren't looked at. A text may
hold any number of candidates: the work is linear in it. Empty tables, and
corpora with no candidate, give empty results.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import check_names, materialize, sample_keys

_NAMES = r"passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential|signature"
KEY_WORDS = rf"(?i)({_NAMES})"
#: formats that are issued to be keys
_ISSUED = r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,}+|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]*+"
#: A private key: lines that say how it is encrypted, then its body, cut off or not; breaks may be spelt out. All
#: groups of varying length are possessive, which the engine runs through in a loop; others it works through by recursion.
_BREAK = r"(?:\s|\\[nrt])*+"
_KEY = r"[A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
_HEADER = r"(?:Proc-Type: ?4,ENCRYPTED|DEK-Info: ?[A-Z0-9-]{1,40}(?:,[0-9A-Fa-f]++)?|(?:Comment|Version|Hash|Charset|MessageID|Subject|X-[A-Za-z-]{1,40}):[^\n\r\\]*+)"
_TAIL = rf"(?:{_BREAK}(?:[A-Za-z0-9+/=]{{1,15}}+(?={_BREAK}(?:-----END|\z)|(?:[ \t\r]*+(?:\n|\\n)){{2}})|(?=[A-Za-z/]{{0,15}}[0-9=+])[A-Za-z0-9+/=]{{1,15}}+))?+"
_BLOCK = rf"-----BEGIN {_KEY}(?:{_BREAK}{_HEADER})*+(?:{_BREAK}[A-Za-z0-9+/=]{{16,}}+)*+{_TAIL}(?:{_BREAK}-----END {_KEY})?+"
ISSUED = rf"^(?:{_ISSUED}|-----BEGIN .*)"
#: what stands before the value in a match: a key word and what assigns to it, or an address up to its password
_ASSIGN = rf"(?i:{_NAMES})[A-Za-z0-9_-]{{0,20}}[\"'`]?\s{{0,3}}(?::=|=>|[:=])\s{{0,3}}"
_LOGIN = r"://[^\s:/@]++:"
#: A run starts where none goes on, the look-ahead wants a digit in it, and it ends before an issued key.
_RUN = rf"(?<![A-Za-z0-9+/_.@-])(?=[A-Za-z+/_.@-]*+[0-9])(?:(?!{_ISSUED})[A-Za-z0-9+/_.@-]){{12,}}+={{0,2}}"
#: A value of any length; one whose quote isn't closed ends with its word. A key block isn't cut short by the word before it.
_VALUE = r"(?![\"'`]?-----BEGIN)(?:\"[^\"\n]{6,}+\"|'[^'\n]{6,}+'|[\"'`]?+[^\s\"'`,;]{6,}+)"
CANDIDATE = rf"{_BLOCK}|{_ISSUED}|{_ASSIGN}{_VALUE}|{_LOGIN}[^\s/@]{{3,}}+@|{_RUN}"
_BEFORE_VALUE = rf"^(?:{_ASSIGN}[\"'`]?|{_LOGIN})"
PLACEHOLDER = r"(?i)(example|sample|dummy|placeholder|changeme|x{6,}|your[_-]?|0{8,}|1234567|abcdef0)"
DICTIONARY = tuple(
    "account address admin and api app auth base bucket build cache change channel class client cloud code com config content count create customer data database date debug default delete demo dev device digest document domain edit email error event example false field file filter format get group hash head header home host html http https id image index info input item json key label lib link list local log login mail main map me message meta mode model module name net new node null number object option order org output page param pass password path photo plain policy port prefix print private product profile project proxy public query queue read record region release remote request response result role root rule sample schema script search secret section server service session set size source start state static status store string style system table tag task temp test text the time title token true type update upload url user utf value version video view web word work write xml year".split()
)
THRESHOLD = 0.5
SAMPLE = 20_000
FEATURES = ("length", "digit_share", "upper_share", "letter_digit_turns", "case_turns", "class_turns", "vowel_turns", "variety", "hex_share", "dictionary_share", "marks", "test_path", "config_path", "named_near", "assigned", "quoted", "digest_near", "example_near", "words_near")
_RESULTS = ("k", "start", "value", "before", "after", "path", *FEATURES, "label", "score", "is_secret")


def _count(column: str, pattern: str) -> Column:
    return F.regexp_count(F.col(column), F.lit(pattern)).cast("double")


#: Set around matches, so that one pass finds and cuts; a text that holds it is cut in two passes.
_MARK = "\x00\ue5a7\x00"


def _cut(text: Column | str) -> tuple[Column, Column]:
    """A text as between[0] found[0] between[1] ... between[n]; each of found as
    (lead, value, tail), where lead names the value and tail ends it."""
    text = F.col(text) if isinstance(text, str) else text
    marked = F.split(F.regexp_replace(text, f"({CANDIDATE})", f"{_MARK}$1{_MARK}"), _MARK, -1)
    pieces = F.when(
        text.contains(_MARK),
        F.flatten(F.transform(F.arrays_zip(F.split(text, CANDIDATE, -1).alias("b"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("f")), lambda p: F.when(p["f"].isNull(), F.array(p["b"])).otherwise(F.array(p["b"], p["f"])))),
    ).otherwise(marked)
    between, found = F.filter(pieces, lambda _, i: i % 2 == 0), F.filter(pieces, lambda _, i: i % 2 == 1)

    def parts(match: Column) -> Column:
        lead = F.regexp_extract(match, _BEFORE_VALUE, 0)
        # an address ends with @, a quoted value with its quote
        tail = F.when(lead.startswith("://"), F.lit("@")).otherwise(F.when(lead.rlike("[\"'`]$"), F.regexp_extract(match, "[\"'`]$", 0)).otherwise(F.lit("")))
        value = F.substring(match, F.length(lead) + 1, F.length(match) - F.length(lead) - F.length(tail))
        return F.struct(lead.alias("lead"), value.alias("value"), tail.alias("tail"))

    return between, F.transform(found, parts)


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(id, k int, start long, value string, before string, after string, path
    string) for each candidate; start counts characters from 0."""
    check_names(id_col, _RESULTS)
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    between, found = _cut("__text")
    rows = df.select(F.col(id_col), F.col(text_col).alias("__text"), path.alias("path")).where(F.col("__text").rlike(CANDIDATE))
    rows = rows.select(F.monotonically_increasing_id().alias("__row"), id_col, "path", between.alias("__between"), found.alias("__found"))
    n = F.size("__found")
    hits = F.arrays_zip(F.col("__found").alias("hit"), F.slice("__between", F.lit(1), n).alias("left"), F.slice("__between", F.lit(2), n).alias("right"))
    # only what is kept of a text's pieces goes into its candidates' rows
    few = F.transform(
        hits,
        lambda h: F.struct(
            h["hit"]["value"].alias("value"),
            F.right(F.concat(h["left"], h["hit"]["lead"]), F.lit(60)).alias("before"),
            F.left(F.concat(h["hit"]["tail"], h["right"]), F.lit(60)).alias("after"),
            F.length(F.concat(h["left"], h["hit"]["lead"])).cast("long").alias("gap"),
            F.length(F.concat(h["hit"]["value"], h["hit"]["tail"])).cast("long").alias("rest"),
        ),
    )
    flat = rows.select("__row", id_col, "path", F.posexplode(few).alias("k", "__hit")).select("__row", id_col, "k", "path", "__hit.*")
    so_far = Window.partitionBy("__row").orderBy("k")  # a text's candidates
    start = F.sum(F.col("gap") + F.col("rest")).over(so_far) - F.col("rest")
    return flat.select(id_col, "k", start.alias("start"), "value", "before", "after", "path")


def describe(found: DataFrame) -> DataFrame:
    """Adds the FEATURES to candidates."""
    words = "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w)))
    n = F.greatest(F.length("value"), F.lit(1)).cast("double")
    flag = lambda c: c.cast("double")
    near = lambda pattern: flag(F.col("before").rlike(pattern) | F.col("after").rlike(pattern))
    around = F.lower(F.concat("before", "after"))
    columns = {
        "length": n,
        "digit_share": _count("value", "[0-9]") / n,
        "upper_share": _count("value", "[A-Z]") / n,
        "letter_digit_turns": (_count("value", "[A-Za-z](?=[0-9])") + _count("value", "[0-9](?=[A-Za-z])")) / n,
        "case_turns": (_count("value", "[a-z](?=[A-Z])") + _count("value", "[A-Z](?=[a-z])")) / n,
        "class_turns": _count("value", "[A-Za-z0-9](?=[^A-Za-z0-9])") / n,
        "vowel_turns": (_count("value", "(?i)[aeiou](?=[b-df-hj-np-tv-z])") + _count("value", "(?i)[b-df-hj-np-tv-z](?=[aeiou])")) / n,
        "variety": F.size(F.array_distinct(F.split("value", ""))).cast("double") / F.least(n, F.lit(64.0)),
        "hex_share": _count("value", "[0-9a-fA-F]") / n,
        "dictionary_share": 1 - F.length(F.regexp_replace(F.lower("value"), words, "")).cast("double") / n,
        "marks": _count("value", "[^A-Za-z0-9]") / n,
        "test_path": flag(F.col("path").rlike(r"(?i)(test|example|sample|fixture|mock|docs?/)")),
        "config_path": flag(F.col("path").rlike(r"(?i)(\.env|conf|settings|secret|\.ya?ml|\.ini|\.pem)")),
        "named_near": near(KEY_WORDS),
        "assigned": flag(F.col("before").rlike(r"[=:]\s*[\"'`]?$")),
        "quoted": flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
        "digest_near": near(r"(?i)(sha-?[0-9]|md5|checksum|commit|digest|etag|revision|uuid|version)"),
        "example_near": near(r"(?i)(example|sample|e\.g\.)"),
        "words_near": 1 - F.length(F.regexp_replace(around, words, "")).cast("double") / F.greatest(F.length(around), F.lit(1)),
    }
    return found.withColumns(columns)


def settled(value: Column) -> Column:
    """True where the format alone makes a value a secret: an issued key that
    is no placeholder, or a private key with a body (whose digits may be any)."""
    block = value.startswith("-----BEGIN ") & (F.length(value) >= 200)
    return block | (value.rlike(ISSUED) & ~value.rlike(PLACEHOLDER))


def seed_labels(found: DataFrame) -> DataFrame:
    """Adds label int to candidates: 1 and 0 where the format settles it, else
    null."""
    named = F.col("before").rlike(KEY_WORDS + r"[A-Za-z0-9_-]{0,20}\W{0,6}$")
    value = F.col("value")
    no = value.rlike(PLACEHOLDER) | value.rlike(r"@[A-Za-z0-9-]+\.") | value.rlike(r"^[0-9.,:+/_-]+$") | value.rlike(r"^[^A-Za-z0-9]*+[A-Za-z0-9./-]*[A-Za-z0-9-]\.(com|org|net|html?|png|jpe?g|js|css)\b") | F.lower(value).isin(*DICTIONARY)
    long_key = value.rlike(r"^[A-Za-z0-9+/_-]{20,}={0,2}$") & value.rlike("[A-Za-z]") & value.rlike("[0-9]")
    yes = value.rlike(ISSUED) | (named & long_key) | (F.col("before").rlike(r"://[^\s:/@]+:$") & value.rlike("[0-9]"))
    return found.withColumn("label", F.when(settled(value), 1).when(no, 0).when(yes, 1))


def train(labelled: DataFrame, sample: int = SAMPLE, trees: int = 24, depth: int = 6, seed: int = 13) -> RandomForestClassificationModel | None:
    """A forest from described candidates with label int; rows without one are
    left out. None where the labels hold fewer than two classes."""
    rows = labelled.where(F.col("label").isNotNull()).select(*FEATURES, F.col("label").cast("double").alias("label"))
    rows = rows.groupBy(*FEATURES, "label").agg(F.count("*").alias("weight")).withColumn("id", F.struct(*FEATURES))
    few = sample_keys(rows, "id", sample // 2, "label")
    few = materialize(few.select(*FEATURES, "label", F.log1p("weight").alias("weight")).coalesce(1).sort(*FEATURES, "label"), "labelled")  # bounded, in one order
    if few.select("label").distinct().count() < 2:
        return None
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(few)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight", subsamplingRate=0.8).fit(data)


def score(found: DataFrame, model: RandomForestClassificationModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score double and is_secret boolean to described candidates. Without
    a model the score is the seed label, 0.5 where there is none. What its format
    settles is a secret whatever a model of few findings scores it."""
    if model is None:
        scored = seed_labels(found).withColumn("score", F.coalesce(F.col("label").cast("double"), F.lit(0.5))).drop("label")
        return scored.withColumn("is_secret", F.col("score") > 0.5)
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(found)
    model = model.copy().setFeaturesCol("__features").setPredictionCol("__prediction").setProbabilityCol("__probability").setRawPredictionCol("__raw")
    scored = model.transform(data).withColumn("score", vector_to_array("__probability")[1])
    return scored.drop("__features", "__prediction", "__probability", "__raw").withColumn("is_secret", (F.col("score") >= threshold) | settled(F.col("value")))


def scan(df: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Findings of every whole text: (id, k, start, value, before, after, path,
    FEATURES, score, is_secret). labels: described candidates with label int,
    else those that seed_labels settles."""
    found = materialize(describe(candidates(df, id_col, text_col, path_col)), "candidates")
    return score(found, train(labels if labels is not None else seed_labels(found)), threshold)


def redact(df: DataFrame, findings: DataFrame, mask: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with every value in findings that is_secret replaced in the text of
    the rows with its id (null is an id like any other); all other rows and
    columns stay as they are. Only rows with a candidate are joined."""
    values = findings.where("is_secret").groupBy(F.col(id_col).alias("__id")).agg(F.collect_set("value").alias("__values"))
    some = F.coalesce(F.col(text_col).rlike(CANDIDATE), F.lit(False))
    rows = df.where(some).join(values, F.col(id_col).eqNullSafe(F.col("__id")), "left")
    between, found = _cut(text_col)
    shown = F.transform(found, lambda h: F.concat(h["lead"], F.when(F.array_contains("__values", h["value"]), F.lit(mask)).otherwise(h["value"]), h["tail"]))
    joined = F.array_join(F.zip_with(between, F.concat(shown, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    columns = [F.when(F.col("__values").isNotNull(), joined).otherwise(F.col(text_col)).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    return df.where(~some).unionByName(rows.select(*columns))
