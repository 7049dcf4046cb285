"""The file manifest of a cohort: names, sequences, completeness and renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Sequence names of the newer naming and of the older one.
RENAME = {"t1n": "t1", "t1c": "t1ce", "t2w": "t2", "t2f": "flair", "seg": "seg"}
REQUIRED = ("t1", "t1ce", "t2", "flair")
UNAVAILABLE = ("DWI", "ADC", "MRS", "Perfusion")
NEW = r"^(.+-\d{5}-\d{3})-(t1n|t1c|t2w|t2f|seg)\.(nii(?:\.gz)?)$"
OLD = r"^(.+)_(t1|t1ce|t2|flair|seg)\.(nii\.gz)$"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, size)`` of all volume files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.nii*").load(folder)
    return files.select("path", F.col("length").alias("size"))


def _map(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def manifest(files: DataFrame, *keep: str) -> DataFrame:
    """``(path, dir, name, case_id, seq, naming, needs_compression)`` and the columns to keep; files of neither naming have null seq."""
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", "/[^/]*$", "")
    f = files.withColumns({"name": name, "dir": folder})
    part = lambda p, k: F.nullif(F.regexp_extract("name", p, k), F.lit(""))
    old, new = part(OLD, 2), _map(RENAME, part(NEW, 2))
    return f.select(
        "path", "dir", "name", F.coalesce(part(OLD, 1), part(NEW, 1), F.element_at(F.split("dir", "/"), -1)).alias("case_id"),
        F.coalesce(old, new).alias("seq"), F.when(old.isNotNull(), "older").when(new.isNotNull(), "newer").alias("naming"),
        (new.isNotNull() & ~F.col("name").endswith(".gz")).alias("needs_compression"), *keep,
    )


def case_ids(m: DataFrame) -> DataFrame:
    """A folder's case: by its T1 file of the older naming, else of the newer, else the folder's name."""
    t1 = lambda n: F.min(F.when((F.col("seq") == "t1") & (F.col("naming") == n), F.col("case_id")))
    return m.groupBy("dir").agg(F.coalesce(t1("older"), t1("newer"), F.element_at(F.split("dir", "/"), -1)).alias("case_id"))


def sequence_paths(m: DataFrame) -> DataFrame:
    """One row per case with a path per sequence (older naming preferred) and the missing ones."""
    pick = [F.coalesce(F.min(F.when((F.col("seq") == s) & (F.col("naming") == "older"), F.col("path"))), F.min(F.when(F.col("seq") == s, F.col("path")))).alias(s) for s in (*REQUIRED, "seg")]
    w = m.groupBy("case_id").agg(*pick)
    missing = F.filter(F.array(*[F.when(F.col(s).isNull(), F.lit(s)) for s in REQUIRED]), lambda v: v.isNotNull())
    return w.withColumn("missing", F.concat_ws(",", missing)).withColumn("complete", F.size(missing) == 0)


def complete_cases(m: DataFrame) -> DataFrame:
    """The manifest rows of cases with all required sequences."""
    need = F.array(*[F.lit(s) for s in REQUIRED])
    ok = m.groupBy("case_id").agg(F.collect_set("seq").alias("s")).where(F.size(F.array_except(need, "s")) == 0)
    return m.join(ok, "case_id", "left_semi")


def new_name(name: Column) -> Column:
    """A name of the newer naming in the older one (always compressed); null for others."""
    seq = _map(RENAME, F.nullif(F.regexp_extract(name, NEW, 2), F.lit("")))
    return F.concat(F.nullif(F.regexp_extract(name, NEW, 1), F.lit("")), F.lit("_"), seq, F.lit(".nii.gz"))


def rename_plan(m: DataFrame) -> DataFrame:
    """``(path, target, action)``: rename, skip (not of the newer naming) or error (the target exists or is claimed twice)."""
    p = m.withColumn("target", F.concat("dir", F.lit("/"), new_name(F.col("name"))))
    taken = m.select(F.col("path").alias("__path"))
    p = p.join(taken, F.col("target") == F.col("__path"), "left")
    twice = F.count("target").over(Window.partitionBy("target")) > 1
    return p.select("path", "target", F.when(F.col("target").isNull(), "skip").when(F.col("__path").isNotNull() | twice, "error").otherwise("rename").alias("action"))


def rename_counts(plan: DataFrame) -> DataFrame:
    return plan.agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in (("rename", "renamed"), ("skip", "skipped"), ("error", "errors"))])


def accepted_upload(name: Column, job: Column, kinds: tuple[str, ...] = ("nii", "nii.gz")) -> Column:
    """Whether an uploaded file has one of the extensions and comes with a job's name."""
    ends = F.lit(False)
    for k in kinds:
        ends = ends | F.endswith(F.lower(name), F.lit("." + k))
    return F.coalesce(ends & (F.trim(job) != ""), F.lit(False))


def folders(m: DataFrame) -> DataFrame:
    return m.where("seq is not null").select("dir").distinct()


def inventory(m: DataFrame) -> DataFrame:
    return m.groupBy("case_id").agg(F.count("*").alias("files"), F.max(F.coalesce(F.col("seq") == "seg", F.lit(False))).alias("has_ground_truth"))


def availability(m: DataFrame) -> DataFrame:
    """Sequences performed and not available, and whether contrast was given."""
    names = {"t1": "T1", "t1ce": "T1ce", "t2": "T2", "flair": "FLAIR"}
    s = m.groupBy("case_id").agg(F.collect_set("seq").alias("s"))
    have = F.filter(F.array(*[F.when(F.array_contains("s", k), F.lit(n)) for k, n in names.items()]), lambda v: v.isNotNull())
    lack = F.concat(F.filter(F.array(*[F.when(~F.array_contains("s", k), F.lit(n)) for k, n in names.items()]), lambda v: v.isNotNull()), F.array(*[F.lit(u) for u in UNAVAILABLE]))
    return s.select("case_id", F.concat_ws(",", have).alias("performed"), F.concat_ws(",", lack).alias("not_available"), F.array_contains("s", "t1ce").alias("contrast"))


def locate(m: DataFrame, root: str) -> DataFrame:
    """Per session below ``root``, the folder of its case: itself, else its only subfolder, else the first with volumes."""
    rest = F.regexp_replace(F.substring("dir", len(root) + 2, 1 << 20), "/.*$", "")
    d = m.groupBy(rest.alias("session"), "dir").agg(F.max(F.col("seq").isNotNull()).alias("volumes"))
    w = Window.partitionBy("session").orderBy((F.col("dir") == F.concat(F.lit(root + "/"), "session")).desc(), F.desc("volumes"), "dir")
    return d.where("volumes").withColumn("k", F.row_number().over(w)).where("k = 1").select("session", F.col("dir").alias("folder"))
