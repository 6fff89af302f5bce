"""Sources: transcripts, loose JSON and versioned inputs as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.text import once


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: job_id (the folder's name) and text."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return spark.read.text(path, wholetext=True).select(name.alias("job_id"), F.col("value").alias("text"))


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC01: one object a file; an unreadable one gives a row of nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


#: What JSON can begin with. Text that begins otherwise isn't parsed: an error costs more than all the rest of a row.
_BEGUN = r"""^[\s\x{FEFF}]*[\[{"0-9tfnNI+.-]"""


def loads_loose(text: Column) -> Column:
    """SRC02: an object as VARIANT from a reply: the text itself, the text without its fences, or the first balanced object in it; else null."""

    def read(text: Column) -> Column:
        bare = F.array_join(F.transform(F.split(text, "\n"), _without_fence), "\n")
        parsed = lambda t: F.when(F.rlike(t, F.lit(_BEGUN)), F.try_parse_json(t))
        return F.coalesce(parsed(text), once(F.nullif(bare, text), parsed), F.try_parse_json(first_object(text)))

    return once(once(text, read), lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v))


def _without_fence(line: Column) -> Column:
    """A line without the fence that it begins with, the word json behind that, and one that it ends with."""
    plain, fence = F.trim(line, F.lit(" \t\r")), "`" * 3
    inner = F.when(F.startswith(plain, F.lit(f"{fence}json")), F.substr(plain, F.lit(8))).when(F.startswith(plain, F.lit(fence)), F.substr(plain, F.lit(4))).otherwise(plain)
    return F.when(F.endswith(inner, F.lit(fence)), F.substr(inner, F.lit(1), F.length(inner) - 3)).otherwise(inner)


def first_object(text: Column) -> Column:
    """The text from its first brace to the one that closes it, braces in strings apart; null if none does.

    The rest is cut into strings, braces and what stands between; a fold counts open braces until they are even.
    """
    rest = F.substr(text, F.instr(text, "{"))
    pieces = F.regexp_extract_all(rest, F.lit(r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}]|[^{}"]++|"'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(0).alias("end"))

    def step(a: Column, p: Column) -> Column:
        # A lone quotation mark opens a string that never ends: no brace behind it counts.
        depth = F.when(p == "{", a["depth"] + 1).when(p == "}", a["depth"] - 1).when(p == '"', 1 << 30).otherwise(a["depth"])
        length = a["length"] + F.length(p)
        return F.struct(depth.alias("depth"), length.alias("length"), F.when((a["end"] == 0) & (p == "}") & (depth == 0), length).otherwise(a["end"]).alias("end"))

    cut = once(F.aggregate(pieces, start, step, lambda a: a["end"]), lambda end: F.when(end > 0, F.substr(rest, F.lit(1), end)))
    return F.when(F.instr(text, "{") > 0, cut)


def agent_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC18: the objects of files that agents wrote, whatever stands around them: job_id and the object as VARIANT, null where there is none."""
    return transcripts(spark, path).select("job_id", loads_loose(F.col("text")).alias("value"))


# Fixed value: the file of a job's folder that tells what the job is.
SUMMARY = "job.json"


def archive(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """SRC14, SRC05: one row a job folder below path: job_id, its summary's fields, names (sorted) and bytes of its files, updated_at (milliseconds), error.

    Names and sizes come from the listing; only summaries are opened, many to a task. A folder whose summary is missing or no object is a row in
    state error that says so, and hides no other. Folders whose names begin with a dot and those without any file are left out.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    raw = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getRawPath().rstrip("/") + "/"
    below = F.substr("_metadata.file_path", F.instr("_metadata.file_path", raw) + len(raw))
    job = F.url_decode(F.replace(F.get(F.split(below, "/"), F.lit(0)), F.lit("+"), F.lit("%2B")))
    each = listed.select(job.alias("job_id"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("at"))
    files = each.where(~F.startswith("job_id", F.lit("."))).groupBy("job_id").agg(F.array_sort(F.collect_set("name")).alias("names"), F.sum("size").alias("bytes"), F.unix_millis(F.max("at")).alias("updated_at"))
    told = spark.read.option("pathGlobFilter", SUMMARY).option("recursiveFileLookup", True).text(path, wholetext=True).select(job.alias("job_id"), F.col("value").alias("summary"))
    object_ = F.startswith(F.schema_of_variant(F.try_parse_json("summary")), F.lit("OBJECT"))
    both = files.join(told, "job_id", "left").withColumn("_error", F.when(F.col("summary").isNull(), "missing").when(~F.coalesce(object_, F.lit(False)), "unreadable"))
    row = F.from_json(F.when(F.col("_error").isNull(), F.col("summary")), fields)
    names = [f.split()[0] for f in fields.split(",")]
    instead = {"state": F.lit("error"), "title": F.col("job_id")}
    rows = both.withColumn("_row", row)
    return rows.select("job_id", *(F.when(F.col("_error").isNotNull(), instead[n]).otherwise(F.col(f"_row.{n}")).alias(n) if n in instead else F.col(f"_row.{n}").alias(n) for n in names), "names", "bytes", "updated_at", F.col("_error").alias("error"))


def first_existing(*sources: Column) -> Column:
    """SRC06-07: the first source that is there."""
    return F.coalesce(*sources)


def names(spark: SparkSession, path: str) -> DataFrame:
    """SRC19: sorted names of the files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("_metadata.file_name").alias("name")).distinct().orderBy("name")


def park(messages: DataFrame, path: str) -> None:
    """SNK22: notices that weren't delivered, appended to a log."""
    header = F.concat(F.lit("=== "), F.date_format("at", "yyyy-MM-dd HH:mm:ss"), *(F.concat(F.lit(f" | {c}="), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))) for c in ("event", "mode")), F.lit(" | "), F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit("-")), F.lit(" ==="))
    messages.select(F.concat(header, F.lit("\n"), "message", F.lit("\n")).alias("value")).write.mode("append").text(path)
