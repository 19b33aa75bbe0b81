"""Knowledge-base entries: validation, embedding text and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import numbered

# The fields that each type of entry must have.
BASE = ("id", "type", "term_arabic", "term_arabizi", "meaning", "example", "usage_context", "region", "register", "generation", "scripts", "source", "last_updated")
REQUIRED = {"expression": (*BASE, "severity", "gender_sensitive"), "proverb": (*BASE, "literal_meaning", "real_meaning", "when_used")}
OPTIONAL = {"expression": ("meaning_fr", "origin"), "proverb": ("meaning_fr", "msa_equivalent")}
EMBED = ("term_arabic", "term_arabizi", "meaning", "example", "usage_context")
EMBED_MORE = {"proverb": ("literal_meaning", "real_meaning", "when_used"), "expression": ("origin",)}
PREFIX = {"expression": "expr_", "proverb": "prov_"}
# End of fixed values.


def _kind(field: str) -> str:
    return "array<string>" if field == "scripts" else "boolean" if field == "gender_sensitive" else "string"


def _errors(kind: Column, problem) -> Column:
    """Array of the errors of an entry of type ``kind``: an unknown type, or what ``problem``
    says of each field of the type (null where it is right)."""
    cases = F.array(F.concat(F.lit("Unknown type: "), F.coalesce(kind, F.lit("UNKNOWN")), F.lit(". Must be 'expression' or 'proverb'")))
    for name, fields in REQUIRED.items():
        optional = OPTIONAL[name]
        cases = F.when(kind == name, F.array_compact(F.array(*[problem(f, True) for f in fields], *[problem(f, False) for f in optional]))).otherwise(cases)
    return cases


def errors(df: DataFrame) -> Column:
    """The errors of the entries of a table: an unknown type, required fields that are null or
    absent, and fields whose column has another type."""
    types = dict(df.dtypes)

    def problem(f: str, needed: bool) -> Column:
        if f not in types or types[f] == "void":
            return F.lit(f"{f}: missing") if needed else F.lit(None).cast("string")
        wrong = F.lit(f"{f}: wrong type") if types[f] != _kind(f) else F.lit(None).cast("string")
        return F.when(F.col(f).isNull(), F.lit(f"{f}: missing") if needed else F.lit(None)).otherwise(wrong)

    return _errors(F.col("type"), problem)


def validate(df: DataFrame) -> DataFrame:
    """``df`` with ``errors`` and ``valid``."""
    return df.withColumn("errors", errors(df)).withColumn("valid", F.size("errors") == 0)


def validate_json(df: DataFrame, column: str = "entry") -> DataFrame:
    """``(id, type, entry, errors, valid)`` of entries that are JSON texts, one by one, so that a
    wrong type is seen in the entry that has it. A text that is no JSON object has the error
    ``FILE`` as its id; an entry without id is ``UNKNOWN``."""
    d = df.select(F.col(column).alias("entry"), F.try_parse_json(F.col(column)).alias("_v"))
    shape = lambda f: F.expr(f"schema_of_variant(try_variant_get(_v, '$.{f}', 'variant'))")
    text = lambda f: F.expr(f"try_variant_get(_v, '$.{f}', 'string')")
    right = {"string": "STRING", "array<string>": "ARRAY<STRING>", "boolean": "BOOLEAN"}

    def problem(f: str, needed: bool) -> Column:
        absent = F.coalesce(shape(f) == "VOID", F.lit(True))
        return F.when(absent, F.lit(f"{f}: missing") if needed else F.lit(None)).when(shape(f) != right[_kind(f)], F.lit(f"{f}: wrong type"))

    broken = ~F.coalesce(F.expr("schema_of_variant(_v)").startswith("OBJECT"), F.lit(False))
    d = d.withColumn("errors", F.when(broken, F.array(F.lit("Invalid JSON"))).otherwise(_errors(text("type"), problem)))
    return d.select(F.when(broken, F.lit("FILE")).otherwise(F.coalesce(text("id"), F.lit("UNKNOWN"))).alias("id"), text("type").alias("type"), "entry", "errors", (F.size("errors") == 0).alias("valid"))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid entries, and ``(id, error)`` of all errors."""
    return validated.where("valid").drop("errors", "valid"), validated.where("not valid").select("id", F.explode("errors").alias("error"))


def embed_text(df: DataFrame) -> Column:
    """The text to embed: the fields of every entry and of its type that are not empty, joined by blanks."""
    own = [F.nullif(F.col(f), F.lit("")) for f in EMBED if f in df.columns]
    for kind, fields in EMBED_MORE.items():
        own += [F.when(F.col("type") == kind, F.nullif(F.col(f), F.lit(""))) for f in fields if f in df.columns]
    return F.concat_ws(" ", *own)


def next_number(target: DataFrame, prefix: str) -> DataFrame:
    """``(n)``: the greatest number of ids ``<prefix><number>``, 0 without any."""
    return target.where(F.col("id").startswith(prefix)).agg(F.coalesce(F.max(F.expr("try_cast(split_part(id, '_', 2) as int)")), F.lit(0)).alias("n"))


def assign_ids(entries: DataFrame, target: DataFrame, kind: str, order: str) -> DataFrame:
    """``entries`` whose null or ``temp_`` ids are replaced by the next ids of the target, in the
    total order ``order``; numbers of three digits at least. The places of the new entries come
    from sorted range partitions and their offsets."""
    prefix = PREFIX[kind]
    need = F.col("id").isNull() | F.col("id").startswith("temp_")
    first = next_number(target, prefix).first()[0]
    new = numbered(entries.where(need), [order], "_n").withColumn("_t", (F.col("_n") + first).cast("string"))
    new = new.withColumn("id", F.concat(F.lit(prefix), F.lpad("_t", 3, "0"))).withColumn("id", F.when(F.length("_t") > 3, F.concat(F.lit(prefix), F.col("_t"))).otherwise(F.col("id")))
    return entries.where(~need).unionByName(new.select(*entries.columns))


def import_entries(entries: DataFrame, target: DataFrame, kind: str, date: str, order: str) -> DataFrame:
    """The target with the valid new entries, numbered and dated."""
    new = validate(assign_ids(entries, target, kind, order).withColumn("last_updated", F.lit(date))).where("valid").drop("errors", "valid")
    return target.unionByName(new.select(*[c for c in new.columns if c in target.columns]), allowMissingColumns=True)
