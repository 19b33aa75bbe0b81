"""Scans: lexicons, line files, JSON in strings, and tables of unknown text column."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nota
from .sinks import exists

# Columns that may hold the text, in the order of preference.
TEXT_COLUMNS = ("text", "sentence", "chunk_text", "content", "tweet", "utterance", "translation", "src", "tgt")
#: Switch of a configuration and the layer it turns off.
SWITCHES = {"apply_alef_maqsura": "alef", "apply_taa_marbuta": "taa", "apply_waw_plurality": "waw", "apply_hamza_drop": "hamza", "apply_negation_split": "negation", "apply_variant_map": "variant", "apply_overrides": "override"}
# End of fixed values.


def lexicon(spark: SparkSession, path: str, columns: int = 2) -> DataFrame:
    """``(ord, k[, v])`` of a tab-separated file: comments and rows of too few columns are
    left out, cells are stripped. Lexicons are small files; ``ord`` is the line's place."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line"))
    lines = lines.select("ord", F.regexp_replace("line", r'^"(.*)"$', "$1").alias("line")).where(~F.col("line").startswith("#") & (F.trim("line") != ""))
    cells = lines.select("ord", F.split("line", "\t").alias("c")).where(F.size("c") >= columns)
    return cells.select("ord", *[F.trim(F.col("c")[i]).alias(n) for i, n in enumerate("kv"[:columns])])


def lexicon_map(spark: SparkSession, path: str) -> dict[str, str]:
    """Key to value; the last of repeated keys counts."""
    return {r["k"]: r["v"] for r in lexicon(spark, path).orderBy("ord").collect()}


def lexicon_set(spark: SparkSession, path: str) -> list[str]:
    return sorted({r["k"] for r in lexicon(spark, path, 1).collect()})


def corrections(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Ordered replacement rules."""
    return [(r["k"], r["v"]) for r in lexicon(spark, path).orderBy("ord").collect()]


def code_switch_table(spark: SparkSession, path: str) -> dict[str, str]:
    """Latin word to Arabic form; words are looked up in lower case, so keys are lowered here."""
    return {k.lower(): v for k, v in lexicon_map(spark, path).items()}


def nota_lexicons(spark: SparkSession, folder: str, off: frozenset[str] = nota.OFF_BY_DEFAULT) -> nota.Nota:
    """The normaliser with the lexicons of a folder; a file that is not there is an empty one."""

    def there(name: str, read, empty):
        path = f"{folder.rstrip('/')}/{name}.tsv"
        return read(spark, path) if exists(spark, path) else empty

    return nota.Nota(
        overrides=there("coda_word_list", lexicon_map, {}),
        variants=there("variant_collapse_map", lexicon_map, {}),
        taa=there("taa_marbuta_ha_list", lexicon_map, {}),
        keep_alef=there("alef_maqsura_list", lexicon_set, []),
        waw_exceptions=there("waw_exceptions", lexicon_set, []),
        gaf=there("gaf_exceptions", lexicon_set, []),
        off=off,
    )


def load_config(path: str) -> dict:
    """A configuration of nested ``key: value`` lines, by indentation; comments, quotes,
    booleans, numbers and nulls as in YAML."""
    root: dict = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    with open(path, encoding="utf-8") as f:
        for raw in f:
            line = re.sub(r"(^|\s)#.*$", "", raw.rstrip("\n")).rstrip() if not re.search(r"""["'].*#.*["']""", raw) else raw.rstrip()
            if not line.strip():
                continue
            indent = len(line) - len(line.lstrip())
            key, _, value = line.strip().partition(":")
            while stack[-1][0] >= indent:
                stack.pop()
            if value.strip():
                stack[-1][1][key.strip()] = _scalar(value.strip())
            else:
                stack[-1][1][key.strip()] = child = {}
                stack.append((indent, child))
    return root


def _scalar(v: str):
    if v[0] in "\"'" and v[-1] == v[0] and len(v) > 1:
        return v[1:-1]
    if v.lower() in ("true", "false"):
        return v.lower() == "true"
    if v.lower() in ("null", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(v)
        except ValueError:
            continue
    return v


def nota_from_config(spark: SparkSession, config: dict, base: str = ".") -> nota.Nota:
    """The normaliser of a configuration's section ``nota``: its layer switches (a layer that is
    not named is on) and, where ``lexicons_dir`` is a folder below ``base``, its lexicons."""
    own = config.get("nota", {})
    off = frozenset(layer for key, layer in SWITCHES.items() if not own.get(key, True))
    folder = own.get("lexicons_dir")
    if folder and exists(spark, f"{base.rstrip('/')}/{folder}"):
        return nota_lexicons(spark, f"{base.rstrip('/')}/{folder}", off)
    return nota.Nota(off=off)


def sorted_lexicon(df: DataFrame, column: str = "k") -> DataFrame:
    """Distinct rows, by the lower-case key; inputs are never rewritten."""
    return df.drop("ord").dropDuplicates().orderBy(F.lower(column), column)


def text_of(df: DataFrame) -> DataFrame:
    """``(text)`` from the first known text column of ``df``, else from its first column."""
    name = next((c for c in TEXT_COLUMNS if c in df.columns), df.columns[0])
    return df.select(F.col(name).cast("string").alias("text"))


def with_source(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("source", F.lit(source))


def nested_json_texts(df: DataFrame, column: str = "data") -> DataFrame:
    """``(text)`` from JSON strings that hold an array of texts, an array of objects with a
    ``text`` or ``sentence``, or one such object; unreadable ones give no row."""
    c = F.col(column)
    objects = F.from_json(c, "array<struct<text string, sentence string>>")
    strings, one = F.from_json(c, "array<string>"), F.from_json(c, "struct<text string, sentence string>")
    of = lambda x: F.coalesce(x["text"], x["sentence"])
    texts = F.when(c.rlike(r"^\s*\[\s*\{"), F.transform(objects, of)).when(c.rlike(r"^\s*\["), strings).otherwise(F.array(of(one)))
    return df.select(F.explode(texts).alias("text")).where("text is not null")


def load_many(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """``(text, source)`` of all parquet paths, and the error of each source that can't be read."""
    out, failed = None, {}
    for name, path in paths.items():
        try:
            one = with_source(text_of(spark.read.parquet(path)), name)
        except AnalysisException as e:
            failed[name] = str(e).partition("\n")[0]
            continue
        out = one if out is None else out.unionByName(one)
    return (out if out is not None else spark.createDataFrame([], "text string, source string")), failed


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One row per line of JSON; lines that are no JSON are in ``_corrupt_record``."""
    r = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return (r.schema(schema) if schema else r).json(path)


def kb_entries(spark: SparkSession, path: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``(entry)``, the entries of a file that holds one JSON array as JSON texts, and the
    file's structural errors as ``(FILE, message)``: no file, no JSON, or a root that is no
    array. Such a file has no entries. A file is read by one task, as JSON arrays are."""
    none = spark.createDataFrame([], "entry string")
    if not exists(spark, path):
        return none, [("FILE", f"File not found: {path}")]
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "array<variant>")
    told = text.select(F.regexp_extract("value", r"^\s*(\S)", 1).alias("first"), F.json_array_length("value").isNull().alias("broken"), F.get_json_object("value", "$").isNull().alias("no_json")).first()
    if told is None or told["no_json"] or (told["first"] == "[" and told["broken"]):
        return none, [("FILE", "Invalid JSON")]
    if told["first"] != "[":
        return none, [("FILE", "Root must be a JSON array")]
    return text.select(F.explode(entries).alias("v")).select(F.to_json("v").alias("entry")), []


def kb_json(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON array file; unreadable ones in ``_corrupt_record``."""
    return spark.read.option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def kb_csv(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a CSV file, with the boolean and the comma-separated list read."""
    d = spark.read.option("header", True).option("escape", '"').csv(path)
    if "gender_sensitive" in d.columns:
        d = d.withColumn("gender_sensitive", F.lower("gender_sensitive") == "true")
    if "scripts" in d.columns:
        d = d.withColumn("scripts", F.transform(F.split("scripts", ","), lambda x: F.trim(x)))
    return d


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line, value)`` of a text file, stripped; one file is read by one task, as its lines are numbered."""
    d = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("line", "value"))
    return d.select("line", F.trim("value").alias("value"))


def synthetic(spark: SparkSession, n: int) -> DataFrame:
    """``n`` instruction pairs."""
    return spark.range(n).select(F.format_string("instruction %d", "id").alias("instruction"), F.format_string("response %d", "id").alias("response"))
