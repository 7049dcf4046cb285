"""Text and record sinks, and the values read back from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def volume_text(volumes: DataFrame) -> DataFrame:
    """``(case_id, text)``: the volume table of a case as printed lines."""
    line = lambda name, c: F.format_string(f"  {name:<29}%10.2f cm³", F.col(c))
    rows = (("Necrotic Core (NCR):", "ncr_cm3"), ("Peritumoral Edema (ED):", "ed_cm3"), ("Enhancing Tumor (ET):", "et_cm3"), ("Tumor Core (TC = NCR + ET):", "tc_cm3"), ("Whole Tumor (WT = all):", "wt_cm3"))
    return volumes.select("case_id", F.concat_ws("\n", F.lit("Tumor Regions:"), *[line(n, c) for n, c in rows]).alias("text"))


def score_text(labels: DataFrame, compounds: DataFrame, mean: DataFrame) -> DataFrame:
    """``(case_id, text)``: the printed evaluation of a case."""
    per = labels.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "dice", "iou"))), lambda r: F.format_string("Label %d\n  Dice Score:      %.4f (%.2f%%)\n  IoU (Jaccard):   %.4f (%.2f%%)", r["label"], r["dice"], r["dice"] * 100, r["iou"], r["iou"] * 100)), "\n\n").alias("a"))
    com = compounds.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("compound", "dice"))), lambda r: F.format_string("%s\n  Dice Score:      %.4f (%.2f%%)", r["compound"], r["dice"], r["dice"] * 100)), "\n\n").alias("b"))
    end = F.format_string("Mean Dice Score (WT, TC, ET): %.4f (%.2f%%)", F.col("mean_dice"), F.col("mean_dice") * 100)
    return mean.join(per, "case_id", "left").join(com, "case_id", "left").select("case_id", F.concat_ws("\n\n", "a", "b", end).alias("text"))


def parse_mean_dice(text: Column) -> Column:
    """The percentage of the mean-Dice line of a printed evaluation, or null."""
    return F.nullif(F.regexp_extract(text, r"(?m)^.*Mean Dice Score.*?(\d+\.\d+)%", 1), F.lit("")).cast("double")


def run_record(summary: DataFrame, metrics: DataFrame, root: str) -> DataFrame:
    """``(case_id, record)``: the JSON record of a case's run."""
    j = summary.select("case_id").join(metrics.select("case_id", "mean_dice"), "case_id", "left")
    folder = F.concat(F.lit(root + "/results/"), F.col("case_id").cast("string"))
    return j.select("case_id", F.to_json(F.struct("case_id", folder.alias("output_folder"), F.concat(folder, F.lit("/feature_extraction")).alias("feature_extraction_folder"), F.struct("mean_dice").alias("metrics"))).alias("record"))


def write_text(rows: DataFrame, folder: str, column: str = "text") -> None:
    """One folder per case with its text."""
    rows.select("case_id", F.col(column).alias("value")).write.mode("overwrite").partitionBy("case_id").text(folder)


def write_report_json(reports: DataFrame, folder: str, method: str = "template") -> None:
    reports.select("case_id", "report", F.lit(method).alias("method")).write.mode("overwrite").json(folder)


def without_summary(cases: DataFrame, summaries: DataFrame) -> DataFrame:
    """Cases that have no summary."""
    return cases.select("case_id").distinct().join(summaries.select("case_id"), "case_id", "left_anti")


def report_of_job(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Each job's report text by its case; null while there is none."""
    return jobs.join(reports.select("case_id", "report"), "case_id", "left").select("job_id", "case_id", "report")


def save_vectors(vectors: DataFrame, folder: str) -> None:
    """Replaces a vector store: one row per article, its id the file's stem (of several the one with the smallest hash)."""
    first = Window.partitionBy("id").orderBy(F.xxhash64(*vectors.columns))
    vectors.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k").write.mode("overwrite").parquet(folder)


def load_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """An existing vector store; Spark raises an error if there is none."""
    return spark.read.parquet(folder)


def article_files(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """``(path, value)`` of all article files below a folder, in the order of their paths."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value").orderBy("path")


def articles(files: DataFrame) -> DataFrame:
    """Articles of (path, value): front matter before ``---`` and the text that stands for each."""
    parts = F.split("value", "---", 2)
    has = F.size(parts) > 1
    field = lambda k: F.when(has, F.trim(F.regexp_extract(parts[0], rf"(?m)^{k}:(.*)$", 1))).otherwise("")
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    a = files.select(name.alias("id"), field("TITLE").alias("title"), field("KEYWORDS").alias("keywords"), field("VERSION").alias("version"), F.col("path").alias("source"), F.trim(F.when(has, parts[1]).otherwise(F.col("value")), F.lit(" \n\r\t")).alias("body"))
    text = F.concat_ws("\n\n", F.when(F.col("title") != "", F.concat(F.lit("Title: "), "title")), F.when(F.col("keywords") != "", F.concat(F.lit("Keywords: "), "keywords")), "body")
    return a.withColumn("document_text", text)


def fallback_value(field: Column, allowed: Column, edema_cm3: Column, hemisphere: Column, lesions: Column) -> Column:
    """A slot field's value without a model: by rule for three fields, else the first allowed one."""
    degree = F.when(edema_cm3 < 5, "Minimal").when(edema_cm3 < 15, "Moderate").when(edema_cm3 < 30, "Significant").otherwise("Extensive")
    return (
        F.when(F.size(allowed) == 0, "").when(field == "edema_degree", degree).when(field == "hemisphere", F.coalesce(hemisphere, allowed[0]))
        .when(field == "distribution", F.when(lesions > 1, "multifocal").otherwise("focal")).otherwise(allowed[0])
    )
