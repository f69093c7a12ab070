"""Recordings of browsing sessions, and HTTP archives, as DataFrames."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import written

_BODY = "struct<ref:string,size:bigint,sha256:string,content_type:string,content_encoding:string>"
_HEADERS = "array<struct<name:string,value:string>>"
_TIME = "struct<t:bigint,wall:timestamp>"
EXCHANGE = (
    f"id string, seq bigint, session_id string, connection_id string, started_at {_TIME}, completed_at {_TIME}, "
    f"request struct<method:string,scheme:string,host:string,port:int,url:string,protocol:string,headers:{_HEADERS},body:{_BODY}>, "
    f"response struct<status:int,protocol:string,headers:{_HEADERS},body:{_BODY}>, timing struct<request_start:bigint,response_start:bigint,response_end:bigint>, error string"
)
SESSION = "format_version int, id string, status string, started_at timestamp, ended_at timestamp, exchanges int"
BODY_REF = r"^bodies/([0-9a-f]{64})\.bin\z"
SESSION_ID = r"^rec_\d{8}_\d{3,4}\z"


def sessions(spark: SparkSession, root: str) -> DataFrame:
    """Recordings below root by their session.json, oldest first; folders that are none are skipped."""
    rows = spark.read.schema(SESSION).option("multiLine", True).json(f"{root}/*/session.json")
    return rows.where(F.col("id").rlike(SESSION_ID)).orderBy("started_at", "id")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of growing files of JSON lines, of one file or of a folder of them.  Blank lines are skipped; a file's last line that can't be read and has no
    line end is being written, and left out; any other line that can't be read is an error.  No file: no rows.

    Whether a file ends with a line end follows from the lengths of its lines and of the file, in one pass.
    """
    try:
        lines = spark.read.option("lineSep", "\n").text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = lines.select("value", place.alias("at"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_path").alias("file"))
    rows = rows.withColumn("x", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("x._bad").isNotNull() & (F.trim(F.regexp_replace("value", r"[\r\t]", " ")) != "")
    seen = rows.groupBy("file").agg(
        F.count_if(bad).alias("bad"), F.max_by("value", F.when(bad, F.col("at"))).alias("line"), F.max("at").alias("last"),
        F.max(F.when(bad, F.col("at"))).alias("last_bad"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("size").alias("size"),
    )
    broken = seen.where("bad > 1 or (bad = 1 and (last <> last_bad or bytes = size))").orderBy("file").limit(1).collect()
    if broken:
        raise ValueError(f"unreadable line in {broken[0]['file']}: {broken[0]['line'][:80]}")
    return rows.where(F.col("x._bad").isNull() & (F.trim("value") != "")).select("x.*").drop("_bad")


def exchanges(spark: SparkSession, folder: str) -> DataFrame:
    """Exchanges of one recording.  A last line that is cut off is left out; any other line that can't be read is an error."""
    return json_lines(spark, f"{folder}/http.jsonl", EXCHANGE)


def bodies(spark: SparkSession, folder: str) -> DataFrame:
    """(sha256, content) of the stored bodies of a recording."""
    files = spark.read.format("binaryFile").load(f"{folder}/bodies/*.bin")
    return files.select(F.regexp_extract("path", r"([0-9a-f]{64})\.bin$", 1).alias("sha256"), "content").where("sha256 <> ''")


def body_reference(sha256: Column) -> Column:
    """The path of a stored body in its recording; null where the hash is none."""
    return F.when(sha256.rlike(r"^[0-9a-f]{64}\z"), F.concat(F.lit("bodies/"), sha256, F.lit(".bin")))


def store_bodies(contents: DataFrame, folder: str) -> DataFrame:
    """Appends contents (content) that the table in folder doesn't hold yet, once each, by their hash; gives (sha256, ref, size) of all."""
    spark = contents.sparkSession
    mine = contents.select(F.sha2("content", 256).alias("sha256"), "content", F.octet_length("content").cast("long").alias("size"))
    new = mine.dropDuplicates(["sha256"])
    try:
        new = new.join(spark.read.parquet(folder).select("sha256"), "sha256", "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").parquet(folder)
    return mine.select("sha256", body_reference(F.col("sha256")).alias("ref"), "size")


def append_exchanges(new: DataFrame, folder: str, session: str) -> DataFrame:
    """Appends exchanges (in the order of started_at and seq) to a recording's table, numbered on from what it holds; gives what was added.

    The numbers of one append follow the start times by a range sort, so they don't need one task.
    """
    spark = new.sparkSession
    try:
        held = spark.read.schema(EXCHANGE).json(f"{folder}/http.jsonl").agg(F.coalesce(F.max("seq"), F.lit(0)).alias("n")).first()["n"]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = 0
    ordered = written(new.repartitionByRange(F.col("started_at.t"), F.col("seq")).sortWithinPartitions("started_at.t", "seq").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = {r["_part"]: r["count"] for r in ordered.groupBy("_part").count().collect()}
    start, offsets = held, {}
    for part in sorted(sizes):
        offsets[part] = start
        start += sizes[part]
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    before = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair]) if offsets else F.create_map(F.lit(0), F.lit(0))
    numbered = ordered.withColumn("seq", (place + before[F.col("_part")]).cast("long")).drop("_part", "_at")
    numbered = numbered.withColumns({"id": F.format_string("ex_%06d", "seq"), "session_id": F.lit(session)})
    numbered.write.mode("append").json(f"{folder}/http.jsonl")
    return numbered


def next_session(spark: SparkSession, root: str, day: str) -> str:
    """The id of the next recording of a day (yyyymmdd) below root: rec_<day>_<number>, from 001."""
    try:
        taken = spark.read.schema(SESSION).option("multiLine", True).json(f"{root}/*/session.json")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return f"rec_{day}_001"
    last = taken.where(F.col("id").rlike(rf"^rec_{day}_\d{{3,4}}\z")).agg(F.max(F.substring_index("id", "_", -1).cast("int"))).first()[0]
    return f"rec_{day}_{(last or 0) + 1:03d}"


_PAIRS = "array<struct<name:string,value:string>>"
ENTRY = (
    "struct<startedDateTime:string,time:double,_resourceType:string,"
    f"request:struct<method:string,url:string,headers:{_PAIRS},queryString:{_PAIRS},cookies:{_PAIRS},postData:struct<mimeType:string,text:string>>,"
    f"response:struct<status:int,headers:{_PAIRS},cookies:{_PAIRS},redirectURL:string,content:struct<size:bigint,mimeType:string,text:string,encoding:string>>>"
)
ARCHIVE = f"log struct<entries:array<{ENTRY}>>"


def archive_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of HTTP archives in order, with decoded bodies; a file without entries, or with a bad base64 body, is an error."""
    logs = spark.read.schema(ARCHIVE).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("file", F.input_file_name())
    there = F.when(F.col("log.entries").isNull(), F.raise_error(F.lit("not an archive: no log.entries"))).otherwise(F.col("log.entries"))
    rows = logs.select("file", F.posexplode(there).alias("sequence", "e"))
    body = F.when(F.col("e.response.content.encoding") == "base64", F.to_binary("e.response.content.text", F.lit("base64"))).otherwise(F.encode("e.response.content.text", "UTF-8"))
    return rows.select(
        "file", "sequence", F.col("e.request.method").alias("method"), F.col("e.request.url").alias("url"), F.col("e._resourceType").alias("resource_type"),
        F.col("e.response.status").alias("status"), F.col("e.response.content.mimeType").alias("mime"), body.alias("body"), F.col("e.request.headers").alias("request_headers"),
        F.col("e.response.headers").alias("response_headers"), F.try_to_timestamp("e.startedDateTime").alias("started_at"), (F.col("e.time") * 1_000_000).cast("long").alias("duration"),
    )


def expected_description(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An expected description, one JSON document a file, strictly by schema: anything else is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
