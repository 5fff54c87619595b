"""Documents, annotations, splits and other inputs; tables with keyed writes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrain import dims
from lexigrain.functions import text as tx

SQUAD = (
    "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,"
    "answers:array<struct<text:string,answer_start:int>>,is_impossible:boolean>>>>>>"
)
CACHE = (
    "key string, meta struct<model:string,latency_ms:double,message_count:int>, response struct<content:array<struct<type:string,id:string,"
    "name:string,text:string>>,stop_reason:string,model:string,usage:struct<input_tokens:bigint,output_tokens:bigint,"
    "cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>>"
)


def read_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, text) of whole UTF-8 files; line ends stay as they are."""
    raw = spark.read.format("binaryFile").load(pattern)
    return raw.select("path", F.decode("content", "UTF-8").alias("text"))


# What ends a record and a key in a file of several texts, and the mark before their stand-ins.
RECORD, FIELD, MARK = "\x1e", "\x1f", "\x1b"
_STAND_INS = ((MARK, f"{MARK}A"), (RECORD, f"{MARK}B"), (FIELD, f"{MARK}C"))
_NULL = f"{MARK}N"
TEXTS_PER_FILE, LONG_TEXT = 200, 1 << 20


def write_texts(texts: DataFrame, folder: str) -> None:
    """Writes (key, text) to files of ``TEXTS_PER_FILE`` rows, texts of ``LONG_TEXT`` and more to files of their own.

    Line ends stay as they are; the marks between rows have stand-ins where a text holds them.  So there
    are far fewer files than texts, and none is too large to be read whole.
    """
    value = F.concat_ws(FIELD, *[F.coalesce(_marked(c, _STAND_INS), F.lit(_NULL)) for c in ("key", "text")])
    short = F.coalesce(F.length("text") < LONG_TEXT, F.lit(True))
    for rows, most, part in ((texts.where(short), TEXTS_PER_FILE, "short"), (texts.where(~short), 1, "long")):
        rows.select(value.alias("value")).write.option("lineSep", RECORD).option("maxRecordsPerFile", most).text(f"{folder}/{part}")


def read_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """(key, text) of what ``write_texts`` has written, each file read whole."""
    rows = read_texts(spark, f"{folder}/*/part-*").select(F.explode(F.split("text", RECORD)).alias("row")).where("row <> ''")
    parts = [F.get(F.split("row", FIELD), F.lit(i)) for i in (0, 1)]
    return rows.select(*[F.when(x != _NULL, _marked(x, [p[::-1] for p in reversed(_STAND_INS)])).alias(c) for x, c in zip(parts, ("key", "text"), strict=True)])


def _marked(c: Column | str, pairs) -> Column:
    out = F.col(c) if isinstance(c, str) else c
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def stem(path: Column | str) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.regexp_extract(F.url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), r"([^/]+)$", 1), r"\.[^.]*$", "")


def documents(spark: SparkSession, pattern: str, ids: DataFrame | None = None, metadata: dict[str, str] | None = None) -> DataFrame:
    """(document_id, text, source_path, metadata), ids in NFC; an empty id set matches nothing."""
    meta = F.create_map(*[F.lit(x) for kv in (metadata or {}).items() for x in kv]) if metadata else F.create_map().cast("map<string,string>")
    docs = read_texts(spark, pattern).select(tx.document_key(stem("path")).alias("document_id"), "text", F.col("path").alias("source_path"), meta.alias("metadata"))
    return keep_ids(docs, ids).orderBy("source_path")


def keep_ids(docs: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Semi-join on NFC ids; None keeps all, an empty frame keeps none."""
    if ids is None:
        return docs
    wanted = ids.select(tx.document_key("document_id").alias("document_id")).distinct()
    return docs.join(wanted, "document_id", "left_semi")


def annotations(nested: DataFrame) -> DataFrame:
    """(title, category, text, char_start): one row per answer, null answers for negatives.

    ``nested`` has the column ``data`` of the question-answering format.
    """
    q = nested.select(F.explode("data").alias("d")).select("d.title", F.explode(F.get("d.paragraphs", F.lit(0))["qas"]).alias("q"))
    category = F.get(F.split("q.id", "__", 2), F.lit(1))
    return q.select("title", category.alias("category"), F.explode_outer("q.answers").alias("a")).select(
        "title", "category", F.col("a.text").alias("text"), F.col("a.answer_start").alias("char_start"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return annotations(spark.read.schema(SQUAD).option("multiLine", True).json(path))


def load_split(spark: SparkSession, path: str, name: str) -> list[str]:
    """Ids of a named split; an unknown name lists those there are."""
    text = spark.read.text(path, wholetext=True).first()[0]
    found = json.loads(text)
    splits = found.get("splits", found)
    if name not in splits:
        raise KeyError(f"no split {name!r}; there are {', '.join(sorted(splits))}")
    return splits[name]


def text_index(files: DataFrame) -> DataFrame:
    """(key, path): the last path of each key."""
    return files.groupBy("key").agg(F.max("path").alias("path"))


def match_titles(titles: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(titles with their path or null, titles without one), joined on key."""
    joined = titles.join(index, "key", "left")
    return joined, titles.join(index, "key", "left_anti")


def master_answers(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Per answer column: filled and yes counts, whether it is boolean, top three values.

    Equal counts go to the value that appears first.
    """
    columns = [c for c in rows.columns if c not in (key, order)]
    long = rows.select(order, *[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot([order], columns, "category", "answer")
    long = long.where(F.coalesce("answer", F.lit("")) != "")
    values = long.groupBy("category", "answer").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    top = values.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "first")))
    ranked = F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "answer"))))
    return top.groupBy("category").agg(
        F.sum("n").alias("filled"), F.sum(F.when(F.col("answer") == "Yes", F.col("n")).otherwise(0)).alias("yes_count"),
        F.bool_and(F.col("answer").isin("Yes", "No")).alias("is_boolean"),
        F.array_join(F.transform(ranked, lambda x: x["answer"]), "|").alias("top_values"),
    )


def read_master_answers(spark: SparkSession, path: str, key: str = "Filename") -> DataFrame:
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn("_row", F.monotonically_increasing_id())
    answers = [c for c in rows.columns if c.endswith("Answer")]
    return master_answers(rows.select(key, "_row", *[f"`{c}`" for c in answers]), key, "_row")


def load_jurisdictions(spark: SparkSession, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(ids, aliases) from a JSON or YAML vocabulary, or the built-in one."""
    if path is None:
        return dims.jurisdictions(spark)
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        import yaml  # optional

        found = yaml.safe_load(text)
    ids = [(j["id"], j["canonical"], "jurisdiction") for j in found["jurisdictions"]] + [(s["id"], s["id"], "sentinel") for s in found.get("sentinels", [])]
    pairs = {(a.casefold(), j["id"]) for j in found["jurisdictions"] for a in [j["canonical"], *(j.get("aliases") or [])]}
    return spark.createDataFrame(ids, "id string, canonical string, kind string"), spark.createDataFrame(sorted(pairs), "alias string, id string")


def save_cases(cases: DataFrame, path: str) -> None:
    """One JSON object per case; parts are written where the rows are."""
    cases.write.mode("overwrite").json(path)


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    kind = ("case_id string, document_id string, clause_type string, present boolean, gold_spans array<struct<s:int,e:int>>, "
            "length_quartile int, document_chars int")  # fmt: skip
    return spark.read.schema(kind).json(path)


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded responses in shards of JSON files."""
    return spark.read.schema(CACHE).option("recursiveFileLookup", True).option("multiLine", True).json(folder)


def write_cache(entries: DataFrame, folder: str) -> None:
    """Appends entries, sharded by the first two digits of the key."""
    entries.withColumn("shard", F.substring("key", 1, 2)).write.mode("append").partitionBy("shard").json(folder)


def lookup_cache(requests: DataFrame, entries: DataFrame, mode: str = "read_write") -> DataFrame:
    """Adds hit; 'off' and 'refresh' hit nothing, a miss under 'read_only' raises."""
    if mode not in ("read_write", "read_only", "refresh", "off"):
        raise ValueError(f"unknown cache mode {mode!r}")
    if mode in ("refresh", "off"):
        return requests.withColumn("hit", F.lit(False))
    joined = requests.join(entries.select("key").distinct().withColumn("_k", F.lit(True)), "key", "left")
    hit = F.coalesce("_k", F.lit(False))
    if mode == "read_only":
        hit = F.when(hit, True).otherwise(F.raise_error(F.concat(F.lit("not in the cache: "), F.col("key"))).cast("boolean"))
    return joined.withColumn("hit", hit).drop("_k")


def freeze(spark: SparkSession, values: dict, path: str) -> None:
    """A small baseline as JSON, one object, written where driver and executors read."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_frozen(spark: SparkSession, path: str, name: str = "metric", value: str = "value") -> DataFrame:
    """(name, value) of a frozen baseline."""
    kept = json.loads(spark.read.text(path, wholetext=True).first()[0])
    kind = "long" if all(isinstance(v, int) for v in kept.values()) else "double"
    return spark.createDataFrame([(k, v if kind == "long" else float(v)) for k, v in kept.items()], f"{name} string, {value} {kind}")


# keyed tables


def upsert(old: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of ``new`` replace all chunks of their documents; documents without new chunks keep theirs."""
    return upsert(old, new, "document_id")


def current(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """The version of a table that the folder's pointer names."""
    fs, path = _fs(spark, f"{folder}/{name}/CURRENT")
    if not fs.exists(path):
        return None
    version = spark.read.text(f"{folder}/{name}/CURRENT").first()[0]
    return spark.read.parquet(f"{folder}/{name}/{version}")


def publish(df: DataFrame, folder: str, name: str, partition_by: str | None = None) -> None:
    """Writes a whole new version, then moves the pointer to it in one rename."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    writer.parquet(f"{folder}/{name}/{version}")
    fs, path = _fs(spark, f"{folder}/{name}/CURRENT")
    tmp = path.suffix(f".{version}")
    out = fs.create(tmp, True)
    out.write(bytearray(version.encode()))
    out.close()
    if fs.exists(path):
        fs.delete(path, False)
    fs.rename(tmp, path)


def index_documents(spark: SparkSession, folder: str, docs: DataFrame, chunks: DataFrame) -> None:
    """Documents and their chunks, published together: chunks first, so no document lacks them."""
    for name, new, merge in (("chunks", chunks, replace_chunks), ("documents", docs, upsert)):
        old = current(spark, folder, name)
        publish(new if old is None else merge(old, new), folder, name)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def create_tables(spark: SparkSession, dimension: int = 768, database: str = "default") -> None:
    """Catalog tables for documents, chunks and review items, if absent."""
    if dimension <= 0:
        raise ValueError("dimension must be positive")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.documents (document_id STRING, text STRING, source_path STRING, metadata MAP<STRING,STRING>, content_hash STRING, indexed_at TIMESTAMP) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.chunks (chunk_id STRING, document_id STRING, text STRING, char_start INT, char_end INT, ordinal INT, heading STRING, token_count INT, embedding ARRAY<FLOAT>) USING parquet TBLPROPERTIES ('embedding.dimension' = '{dimension}')")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.review_items (id BIGINT, document_id STRING, reasons ARRAY<STRING>, status STRING, reviewer STRING, note STRING, created_at TIMESTAMP, resolved_at TIMESTAMP) USING parquet")


def drop_tables(spark: SparkSession, database: str = "default") -> None:
    for name in ("documents", "chunks", "review_items"):
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")


def manifest(files: DataFrame) -> DataFrame:
    """(path, sha256, bytes) of binary files."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))


def manifest_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of only one of two manifests; empty if they are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def log_histogram(values: DataFrame, column: str) -> DataFrame:
    """(bin, n): bin k holds values from 2**k up to 2**(k + 1)."""
    return values.where(F.col(column) > 0).groupBy(F.floor(F.log2(F.col(column).cast("double"))).cast("int").alias("bin")).agg(F.count("*").alias("n"))


