"""Readers and writers of the library's inputs: reports, corpora, events, journals, index files, caches, manifests.

Readers are lazy and push what they can into the scan; nothing here lists or opens files on the driver but the manifest writer, which
reads one file's checksum through Spark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def report_csv(spark: SparkSession, path: str, numbers: list[str], times: list[str], header: bool = True) -> DataFrame:
    """A CSV with every column as text (only an empty cell is missing, "NA" is text), numbers and times cast, NULL where they don't parse."""
    raw = spark.read.csv(path, header=header, inferSchema=False, nullValue="", emptyValue="", multiLine=True, escape='"')
    number = {c: F.expr(f"nullif(try_cast(`{c}` AS DOUBLE), double('NaN'))") for c in numbers}
    return raw.withColumns(number | {c: F.try_to_timestamp(c) for c in times})


def pruned(spark: SparkSession, path: str, columns: list[str], day: str, start: str, text: str | None = None, least: int = 0) -> DataFrame:
    """A parquet scan of some columns from a day on, with texts of at least `least` characters."""
    rows = spark.read.parquet(path).where(F.col(day) >= F.lit(start))
    return (rows.where(F.char_length(text) >= least) if text else rows).select(*columns)


def looked_up(rows: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """rows with the text of their key, "" where there is none; of repeated keys the greatest text counts."""
    one = texts.groupBy(key).agg(F.max(text).alias(text))
    return rows.join(one, key, "left").withColumn(text, F.coalesce(text, F.lit("")))


def corpus(df: DataFrame, name: str, key: str, author: str, text: str, least: int = 0, where: Column | None = None) -> DataFrame:
    """An adapter's rows in the common form corpus, doc_id, author, text, with texts of `least` characters or more."""
    rows = df if where is None else df.where(where)
    return rows.where(F.char_length(text) >= least).select(F.lit(name).alias("corpus"), F.col(key).cast("string").alias("doc_id"), F.col(author).cast("string").alias("author"), F.col(text).alias("text"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def individuals(df: DataFrame, author: str, groups: str, placeholders: list[str]) -> DataFrame:
    """Rows of single people: no collection whose name matches `groups`, no placeholder author."""
    return df.where(~F.coalesce(F.col(author).rlike(groups), F.lit(True)) & ~F.col(author).isin(*placeholders))


def event_families(spark: SparkSession, paths: list[str], start: str | None = None, end: str | None = None, least_magnitude: float | None = None, countries: list[str] | None = None) -> DataFrame:
    """Event tables of several families under one set of columns, screened; a NULL magnitude counts as 0, dates are texts that may not parse."""
    e = union([spark.read.parquet(p) for p in paths]).withColumn("day", F.expr("try_to_date(calendar_date_start)"))
    if start:
        e = e.where(F.col("day") >= F.lit(start).cast("date"))
    if end:
        e = e.where(F.col("day") <= F.lit(end).cast("date"))
    if least_magnitude is not None:
        e = e.where(F.coalesce("magnitude", F.lit(0.0)) >= least_magnitude)
    return e.where(F.col("iso3").isin(*countries)) if countries else e


def level_csv(spark: SparkSession, path: str, day: str, value: str) -> DataFrame:
    """A landed series file whose "." stands for no value: day, value."""
    return spark.read.csv(path, header=True).select(F.expr(f"try_to_date(`{day}`)").alias("day"), F.expr(f"try_cast(nullif(`{value}`, '.') AS DOUBLE)").alias("value")).where("day IS NOT NULL AND value IS NOT NULL")


def index_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Fixed-layout lines (year month day, then eight three-hourly values and the day's index last): day, most, mean, index, storm flags at 5 and 6."""
    parts = F.split(F.trim(line), r"\s+")
    rows = lines.select(line, parts.alias("p")).where(~F.trim(line).startswith("#") & (F.size("p") >= 12)).select(F.expr("try_to_date(concat_ws('-', p[0], p[1], p[2]))").alias("day"), F.transform(F.slice(parts, 4, 8), lambda x: x.try_cast("double")).alias("k"), F.element_at(parts, -1).try_cast("double").alias("daily_index"))
    most = F.array_max("k")
    return rows.select("day", most.alias("k_max"), (F.aggregate("k", F.lit(0.0), lambda a, x: a + x) / 8).alias("k_mean"), "daily_index", (most >= 5).cast("int").alias("storm_minor"), (most >= 6).cast("int").alias("storm_strong"))


def journal(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown files with front matter: doc_id (file name), day (front matter's or the name's), title, text, lang, lucid, mood, symbols, tags; empty narratives are left out."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").withColumn("file", F.input_file_name())
    head = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n", 1)
    body = F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", "")
    narrative = F.trim(F.regexp_replace(F.regexp_replace(body, r"(?m)^#.*$", ""), r"\n{3,}", "\n\n"), F.lit(WHITE))

    def field(name: str) -> Column:
        v = F.trim(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(.*)$", 1), r"^[\"']|[\"']$", ""))
        return F.nullif(v, F.lit(""))

    def listed(name: str) -> Column:
        inline = F.split(F.regexp_replace(F.coalesce(field(name), F.lit("")), r"[\[\]\"']", ""), ",")
        block = F.regexp_extract_all(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*\n((?:[ \t]*- .*(?:\n|\z))+)", 1), F.lit(r"- *(.*)"))
        return F.filter(F.transform(F.when(F.size(block) > 0, block).otherwise(inline), lambda x: F.trim(x)), lambda x: x != "")

    name = F.regexp_extract("file", r"([^/]+)\.md$", 1)
    day = F.coalesce(F.expr("try_to_date(d)"), F.expr("try_to_date(regexp_extract(doc_id, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1))"))
    rows = raw.select(name.alias("doc_id"), field("date").alias("d"), field("title").alias("title"), narrative.alias("text"), field("lang").alias("lang"), field("lucid").alias("lucid"), field("mood_on_waking").alias("mood"), listed("symbols").alias("symbols"), listed("tags").alias("tags"))
    return rows.where(F.col("text") != "").withColumn("day", day).drop("d")


def posts(df: DataFrame) -> DataFrame:
    """Forum posts: title and body as one text, the author's deletions left out, epoch seconds as a time, flair kept."""
    text = F.trim(F.concat_ws("\n", "title", F.when(~F.col("selftext").isin("[deleted]", "[removed]"), F.col("selftext"))))
    return df.where(~F.coalesce("author", F.lit("[deleted]")).isin("[deleted]", "AutoModerator")).select("author", F.timestamp_seconds(F.col("created_utc").cast("double")).alias("ts"), text.alias("text"), F.col("link_flair_text").alias("flair")).where(F.char_length("text") >= 15)


def head_of_corpus(df: DataFrame, order: str, sentences: str, n: int, least: int = 4) -> DataFrame:
    """The first n documents, in a stated order, that have `least` sentences."""
    return df.where(F.size(sentences) >= least).orderBy(order).limit(n)


def distinct_prefix(df: DataFrame, text: str, key: str, chars: int = 120) -> DataFrame:
    """One row for each beginning of a text: that with the least key."""
    least = df.groupBy(F.substring(text, 1, chars).alias("_p")).agg(F.min(key).alias(key))
    return df.join(least.select(key), key, "left_semi")


def capped_paragraphs(df: DataFrame, key: str, text: str, cap: int, least: int = 300, spaces: int = 30) -> DataFrame:
    """Paragraphs (parted by blank lines) of enough characters and spaces, the first `cap` of each document: key, pos, text."""
    from pyspark.sql import Window

    p = df.select(key, F.posexplode(F.split(text, r"\n\s*\n")).alias("pos", "text")).withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))
    p = p.where((F.char_length("text") >= least) & (F.regexp_count("text", F.lit(" ")) > spaces))
    return p.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("_n") <= cap).drop("_n")


def lead_section(text: Column, chars: int = 400, paragraphs: int = 3) -> Column:
    """A text's opening: its lines without headings, until `chars` characters or `paragraphs` of them are reached."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^(=+.*=+|#+ .*)$"))
    none = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("size"))

    def step(acc: Column, line: Column) -> Column:
        done = (acc["size"] >= chars) | (F.size(acc["kept"]) >= paragraphs)
        return F.when(done, acc).otherwise(F.struct(F.concat(acc["kept"], F.array(line)).alias("kept"), (acc["size"] + F.char_length(line)).alias("size")))

    return F.array_join(F.aggregate(lines, none, step)["kept"], "\n")


# ---- caches and sinks ----------------------------------------------------------------------------


def content_key(text: Column) -> Column:
    return F.sha1(F.coalesce(text, F.lit("")))


def missing(rows: DataFrame, cache: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key the cache lacks, one for each key."""
    one = rows.dropDuplicates([key])
    return one if cache is None else one.join(cache.select(key), key, "left_anti")


def extended_cache(spark: SparkSession, rows: DataFrame, path: str, key: str, compute) -> DataFrame:
    """rows with what compute(rows) gives for their keys: only keys that the cache at `path` lacks are computed, then appended."""
    try:
        cache = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        cache = None
    compute(missing(rows, cache, key)).write.mode("append").parquet(path)
    return rows.join(spark.read.parquet(path), key)


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Appends rows whose key isn't there yet: a run that is taken up again writes only the rest."""
    spark = rows.sparkSession
    try:
        there = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        there = None
    missing(rows, there, key).write.mode("append").parquet(path)


def write_reports(df: DataFrame, path: str, by: str = "lang") -> None:
    """Report level, partitioned by what analyses stratify by, so that a stratum's scan prunes the rest."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def write_panel(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


#: ASCII white space.
WHITE = " \t\n\x0b\x0c\r"
CARD = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "source", "license", "sensitivity", "notes", "path", "sha256", "size")] + [T.StructField("bytes", T.LongType()), T.StructField("extra", T.MapType(T.StringType(), T.StringType()))])


def human_size(n: int) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024 or unit == "GB":
            return f"{n:.1f} {unit}" if unit != "B" else f"{n} B"
        n /= 1024
    raise AssertionError


def data_card(spark: SparkSession, name: str, source: str, license: str, sensitivity: str, path: str | None = None, notes: str = "", extra: dict | None = None) -> DataFrame:
    """A one-row card on a data set; with a path its bytes and the hash of its files' hashes, in order of names."""
    size = digest = None
    if path:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("p"), "length", F.sha2("content", 256).alias("h"))
        r = files.agg(F.sum("length").alias("n"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda s: s["h"])), 256).alias("h")).first()
        size, digest = r.n, r.h
    return spark.createDataFrame([(name, source, license, sensitivity, notes, path, digest, human_size(size) if size is not None else None, size, extra or {})], CARD)


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CARD).json(path, multiLine=False)
