"""File sources (SRC-1..16): predictions, statuses, results, reports,
trajectories, evaluator reports and logs, listings.

Every reader returns a DataFrame with a fixed schema plus ordering columns
(``file``, ``pos``/``seq``) where the governed tool's semantics depend on
input order; Spark itself never relies on row order. Whole-file formats
(JSON documents, YAML) are read one file per row (``wholetext`` /
``binaryFile``) so files parse in parallel; line formats are split by Spark.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavel.functions.text import looks_like_diff, py_rstrip, py_strip
from gavel.session import written

RESULT_SCHEMA = "instance_id string, resolved boolean, resolved_status string, cri string"
REPORT_SCHEMA = ("instance_id string, task string, repo string, base_commit string, scan_scope string, "
                 "scan_failed boolean, scan_ok boolean, scan_error string, skipped boolean, skip_reason string, "
                 "changed_files array<string>, new_violations string, "
                 "files array<struct<path:string, before_violations:array<string>, after_violations:array<string>, "
                 "new_violations:array<string>>>, _corrupt_record string")


ID_KEYS = ("instance_id", "task", "id", "task_id")


def _id_of(rec, fallback):
    """SRC-2 over a parsed struct of strings."""
    return F.coalesce(*[F.nullif(rec[c], F.lit("")) for c in ID_KEYS], fallback)


def _truthy_text(v: Column) -> Column:
    """Text of a variant that Python counts as true, else null: no null, false,
    zero, empty string, list or object. The string "0" counts."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    false = (kind.isNull() | (kind == "VOID") | ((kind == "BOOLEAN") & (text == "false")) | text.isin("", "[]", "{}")
             | ((kind != "STRING") & (F.try_variant_get(v, "$", "double") == 0)))
    return F.when(~F.coalesce(false, F.lit(False)), text)


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def variant_id(v: Column, fallback: Column) -> Column:
    """SRC-2: first truthy of instance_id, task, id, task_id, else fallback."""
    return F.coalesce(*[_truthy_text(_field(v, k)) for k in ID_KEYS], fallback)


# ------------------------------------------------------------------ SRC-1
def predictions_of(units: DataFrame) -> DataFrame:
    """SRC-1: one normaliser for a whole file (``line`` null) and for a line of
    a JSONL file. ``units``: file, line, json (valid JSON text). Rows
    (file, seq, instance_id, model_patch, provider, tau_step), seq a struct
    (line, position); duplicates are kept, the patch is raw (TXT-1 follows)."""
    t = py_strip(F.col("json"))
    is_list, is_object = t.startswith("["), t.startswith("{")
    members = F.map_entries(F.from_json(F.when(is_object, t), "map<string,variant>"))
    keyed = is_object & F.exists(members, lambda m: m["key"].isin(*ID_KEYS))
    whole = F.try_element_at(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<variant>"), F.lit(1))

    def item(v, pos, key=None):
        """(record or patch, its key in a map, its place)"""
        return F.struct(v.alias("v"), (F.lit(None).cast("string") if key is None else key).alias("key"), pos.alias("pos"))

    falsy = F.col("line").isNotNull() & _truthy_text(F.col("whole")).isNull()
    items = (F.when(falsy | (t == "null"), F.array().cast("array<struct<v:variant,key:string,pos:int>>"))
             .when(is_list, F.transform(F.from_json(F.when(is_list, t), "array<variant>"),
                                        lambda e, i: item(e, (i + 1).cast("int"))))
             .when(keyed | ~is_object, F.array(item(F.col("whole"), F.lit(0))))
             .otherwise(F.transform(members, lambda m, i: item(m["value"], (i + 1).cast("int"), m["key"]))))
    rows = units.withColumn("whole", whole).select("file", "line", falsy.alias("falsy"), F.explode_outer(items).alias("x"))
    return _records(rows.where("falsy or x is not null").select("file", "line", "falsy", "x.*"))


def _records(rows: DataFrame) -> DataFrame:
    """Prediction rows of items (file, line, falsy, v, key, pos)."""
    record = F.schema_of_variant("v").startswith("OBJECT")
    # in a map the key is the id unless the payload has an instance_id of its own
    named = F.schema_of_variant(_field(F.col("v"), "instance_id")).isNotNull()
    place = F.concat(F.lit("instance_"), F.col("pos").cast("string"))
    fallback = F.when(F.col("pos") == 0, F.lit("instance_unknown")).otherwise(place)
    ident = (F.when(F.col("falsy"), F.concat(F.lit("line_"), F.col("line").cast("string")))
             .when(F.col("key").isNotNull() & (~record | ~named), F.coalesce(F.nullif("key", F.lit("")), place))
             .otherwise(F.when(record, variant_id(F.col("v"), fallback)).otherwise(fallback)))
    patch = F.when(record, F.try_variant_get("v", "$.model_patch", "string")).otherwise(F.try_variant_get("v", "$", "string"))
    return rows.select("file", F.struct(F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("pos", F.lit(0)).alias("pos")).alias("seq"),
                       ident.alias("instance_id"), F.coalesce(patch, F.lit("")).alias("model_patch"),
                       F.when(record, F.try_variant_get("v", "$.provider", "string")).alias("provider"),
                       F.when(record, F.try_variant_get("v", "$.tau_step", "bigint")).alias("tau_step"))


def _valid_json(text: Column) -> Column:
    # wrapping in brackets makes trailing values (JSONL) a parse error
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()


def _checked_lines(lines: DataFrame) -> DataFrame:
    """Stripped, non-blank lines; a malformed one fails the job."""
    raw = F.col("json")
    return lines.withColumn("json", py_strip(F.regexp_replace(raw, "^\ufeff", ""))).where("json <> ''").withColumn(
        "json", F.when(_valid_json(raw), raw).otherwise(F.raise_error(F.concat(
            F.lit("malformed JSON on line "), F.col("line").cast("string"), F.lit(" of "), F.col("file"))).cast("string")))


def parse_prediction_texts(files: DataFrame) -> DataFrame:
    """SRC-1 over (file, text): a JSON document, else JSONL; a blank text has
    no rows."""
    clean = files.select("file", F.regexp_replace("text", "^\ufeff", "").alias("text")).where(py_strip(F.col("text")) != "")
    clean = clean.withColumn("ok", _valid_json(F.col("text")))
    parts = F.when(F.col("ok"), F.array(F.col("text"))).otherwise(F.split("text", "\n"))
    units = clean.select("file", "ok", F.posexplode(parts).alias("i", "json")).select(
        "file", F.when(~F.col("ok"), (F.col("i") + 1).cast("bigint")).alias("line"), "json")
    return predictions_of(_checked_lines(units))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: polymorphic predictions file(s), read whole: one task per file,
    a file below Spark's 2 GB row limit. Large JSONL files go to
    ``read_predictions_jsonl``, large arrays and maps to
    ``read_predictions_json``."""
    return parse_prediction_texts(spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))


# ------------------------------------------------------------------ SRC-3
def _yaml_as_json(batches):
    """(path, YAML bytes) -> (file, JSON text); scalars as their text."""
    import json

    import yaml

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items() if k is not None}
        return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x if x is None else str(x)

    for pdf in batches:
        texts = []
        for content in pdf["content"]:
            try:
                texts.append(json.dumps(plain(yaml.safe_load(bytes(content).decode("utf-8")))))
            except (yaml.YAMLError, UnicodeDecodeError):
                texts.append(None)
        yield pd.DataFrame({"file": pdf["path"], "text": texts})


def status_rows(files: DataFrame) -> DataFrame:
    """SRC-3 over (file, text) with JSON mappings: {id: status}, or {status:
    [ids]} under ``instances_by_exit_status``. Rows (file, pos, instance_id,
    status); other texts and null ids or statuses have no rows."""
    group = "instances_by_exit_status"
    whole = F.from_json(F.when(F.col("text").startswith("{"), F.col("text")), "map<string,string>")
    flat = F.transform(F.map_entries("m"), lambda e: F.struct(e["key"].alias("id"), e["value"].alias("status")))
    by_status = F.map_entries(F.from_json(F.when(F.col("m")[group].startswith("{"), F.col("m")[group]), "map<string,string>"))
    nested = F.flatten(F.transform(by_status, lambda e: F.transform(
        F.coalesce(F.from_json(F.when(e["value"].startswith("["), e["value"]), "array<string>"), F.array().cast("array<string>")),
        lambda i: F.struct(i.alias("id"), e["key"].alias("status")))))
    pairs = F.when(F.map_contains_key("m", group), nested).otherwise(flat)
    rows = files.withColumn("m", whole).where("m is not null").select("file", F.posexplode(pairs).alias("pos", "x"))
    return rows.select("file", F.col("pos").cast("bigint").alias("pos"), F.col("x.id").alias("instance_id"),
                       F.col("x.status").alias("status")).where("instance_id is not null and status is not null")


def read_statuses(spark: SparkSession, path_glob: str) -> DataFrame:
    """SRC-3: exit_statuses_*.yaml; unreadable files have no rows. Python turns
    YAML into JSON text, Spark does the rest."""
    raw = spark.read.format("binaryFile").load(path_glob).select("path", "content")
    return status_rows(raw.mapInPandas(_yaml_as_json, "file string, text string").where("text is not null"))


def merge_statuses(rows: DataFrame, order=("file", "pos")) -> DataFrame:
    """SRC-3 / WIN-4: null ids or statuses dropped, last write wins by
    (file order, position). ``max_by`` aggregates partially on the map side,
    so a hot instance id costs one row per task before the shuffle."""
    return (rows.where(F.col("instance_id").isNotNull() & F.col("status").isNotNull())
            .groupBy(F.col("instance_id").cast("string").alias("instance_id"))
            .agg(F.max_by(F.col("status").cast("string"), F.struct(*[F.col(c) for c in order])).alias("status")))


# ------------------------------------------------------------------ SRC-4, SRC-11
def parse_json_lines(lines: DataFrame, schema: str, mode: str = "PERMISSIVE") -> DataFrame:
    """SRC-11 over (file, line, value): blank lines skipped. Modes: FAILFAST
    (a malformed line fails the job), DROPMALFORMED (dropped) or PERMISSIVE
    (kept with ``_corrupt_record`` beside its line number)."""
    lines = lines.where(py_strip(F.col("value")) != "")
    if mode == "FAILFAST":
        return lines.select("file", "line", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("file", "line", "r.*")
    parsed = lines.select("file", "line", F.from_json("value", schema + ", _corrupt_record string", {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("file", "line", "r.*")
    return parsed.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record") if mode == "DROPMALFORMED" else parsed


def read_jsonl(spark: SparkSession, path: str, schema: str, mode: str = "PERMISSIVE") -> DataFrame:
    """SRC-11: JSONL files with exact 1-based line numbers."""
    return parse_json_lines(numbered_lines(spark, path), schema, mode)


def last_results(rows: DataFrame) -> DataFrame:
    """SRC-4: rows without id dropped, the last row per id wins."""
    return (rows.where(F.coalesce(F.col("instance_id"), F.lit("")) != "").groupBy("instance_id")
            .agg(F.max_by(F.struct("resolved", "resolved_status", "cri"), F.struct("file", "line")).alias("x"))
            .select("instance_id", "x.*"))


def read_instance_results(spark: SparkSession, path: str) -> DataFrame:
    return last_results(read_jsonl(spark, path, RESULT_SCHEMA, mode="PERMISSIVE"))


# ------------------------------------------------------------------ SRC-5, 6
def parse_reports(files: DataFrame) -> DataFrame:
    """SRC-5/6 over (file name, text): the id is the file's stem; a scalar
    ``new_violations`` counts as one finding, a falsy one as none; an
    unreadable report becomes corrupt=true."""
    r = F.from_json("text", REPORT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = files.select(F.regexp_replace("file", r"\.json$", "").alias("stem"), "text", r.alias("r")).select("stem", "text", "r.*")
    raw = F.col("new_violations")
    listed = (F.when(raw.startswith("["), F.from_json(F.when(raw.startswith("["), raw), "array<string>"))
              .when(~raw.isin("", "0", "false", "{}"), F.array(raw)))
    corrupt = F.col("_corrupt_record").isNotNull() | F.col("text").isNull() | ~py_strip(F.col("text")).startswith("{")
    return rows.select(F.col("stem").alias("instance_id"), "scan_scope", "scan_failed", "scan_ok", "scan_error", listed.alias("new_violations"),
                       corrupt.alias("corrupt"), "files", "changed_files")


def read_reports(spark: SparkSession, directory: str) -> DataFrame:
    """SRC-5/6: one security report per '<id>.json'."""
    return parse_reports(spark.read.text(f"{directory}/*.json", wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")))


# ------------------------------------------------------------------ SRC-7
def parse_trajectories(files: DataFrame) -> DataFrame:
    """SRC-7 over (file name, text): info.submission kept only when it looks
    like a diff (right-stripped plus one newline); an unreadable text has no
    row."""
    rows = files.where(_valid_json(F.col("text")) & py_strip(F.col("text")).startswith("{"))
    sub = F.coalesce(F.try_variant_get(F.try_parse_json("text"), "$.info.submission", "string"), F.lit(""))
    return rows.select(F.regexp_replace("file", r"\.traj\.json$", "").alias("instance_id"),
                       F.lit("extracted_from_trajectory").alias("model_name_or_path"),
                       F.when(looks_like_diff(sub), F.concat(py_rstrip(sub), F.lit("\n"))).otherwise(F.lit(""))
                       .alias("model_patch"), F.octet_length(sub).cast("bigint").alias("submission_bytes"))


def read_trajectories(spark: SparkSession, root: str) -> DataFrame:
    """SRC-7: '*.traj.json' in root, else in root/trajectories, else anywhere
    below; the first level that has files is read."""
    listing = list_files(spark, root, "*.traj.json")
    folder = F.regexp_replace(F.regexp_extract("path", "^(.*)/[^/]+$", 1), "^(file:)?/*", "/")
    base = "/" + root.removeprefix("file:").strip("/")
    level = F.when(folder == base, 0).when(folder == f"{base}/trajectories", 1).otherwise(2)
    best = listing.agg(F.min(level).alias("n")).first()["n"]  # one number
    found = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.traj.json").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return parse_trajectories(found.where(level == F.lit(best)).select("file", "text"))


# ------------------------------------------------------------------ SRC-9, 10, 14, 16
def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Listing (path, mtime, length) without reading contents."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
            .load(root).select("path", F.col("modificationTime").alias("mtime"), "length"))


def newest_per_key(listing: DataFrame, key_regex: str) -> DataFrame:
    """SRC-9/10 / WIN-7: newest file per key extracted from the path."""
    k = listing.withColumn("key", F.regexp_extract("path", key_regex, 1)).where(F.col("key") != "")
    return k.groupBy("key").agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def discover_artifacts(listing: DataFrame, root: str, candidates: dict) -> DataFrame:
    """SRC-14/16: per (instance, kind) the first existing candidate path in
    priority order. ``candidates`` maps kind -> list of relative path
    templates with one '{id}'. A path is held against all templates in its row, so the
    listing is scanned once however many there are."""
    under = F.regexp_replace("path", "^file:(//)?", "")
    prefix = root.removeprefix("file://").removeprefix("file:").rstrip("/") + "/"
    rel = F.when(F.col("_under").startswith(prefix), F.expr(f"substring(_under, {len(prefix) + 1})")).otherwise(F.col("_under"))

    def match(kind, prio, template):
        pre, post = template.split("{id}")
        fits = F.col("rel").startswith(pre) & F.col("rel").endswith(post) & (F.length("rel") > len(pre) + len(post))
        return F.when(fits, F.struct(F.lit(kind).alias("kind"), F.lit(prio).alias("prio"), F.col("rel").substr(
            F.lit(len(pre) + 1), F.length("rel") - (len(pre) + len(post))).alias("instance_id")))

    hits = F.array(*[match(k, n, t) for k, templates in candidates.items() for n, t in enumerate(templates)])
    found = listing.select(under.alias("_under")).select(rel.alias("rel")).select(
        "rel", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    return found.groupBy("h.instance_id", "h.kind").agg(F.min_by("rel", F.struct("h.prio", "rel")).alias("path"))


def artifact_columns(found: DataFrame, kinds: list[str]) -> DataFrame:
    """``discover_artifacts`` with a column per kind (null: none found), a row per instance."""
    return found.groupBy("instance_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("path"))).alias(k) for k in kinds])


# ------------------------------------------------------------------ SRC-12, 13
def subset_lines(df: DataFrame, col: str = "value") -> DataFrame:
    """SRC-12: one id per line; blanks and '#' comments ignored."""
    s = py_strip(F.col(col))
    return df.select(s.alias("id")).where((F.col("id") != "") & ~F.col("id").startswith("#"))


def read_subset(spark: SparkSession, path: str) -> DataFrame:
    return subset_lines(spark.read.text(path))


def read_dataset_index(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: id -> (repo, base_commit); rows without id dropped."""
    d = spark.read.parquet(path)
    return d.select(F.col("instance_id").cast("string"), "repo", "base_commit").where(
        F.coalesce(F.col("instance_id"), F.lit("")) != "")


# ------------------------------------------------------------------ SRC-8
EVAL_PAYLOAD = ("instance_id string, task string, id string, task_id string, resolved boolean, "
                "patch_successfully_applied boolean")


EVAL_SECTIONS = ("report", "results", "instances")


def parse_evaluator_reports(files: DataFrame) -> DataFrame:
    """SRC-8 / SET-4 over (file, text): instance entries of reports. Sections
    'report', 'results', 'instances' (each a map id -> payload or a list of
    payloads) are read in that order and later entries override earlier
    ones; a top-level list is read as one section; a lone object with an
    instance_id is the fallback. One row per (file, instance).

    A text is parsed once into its sections, the entries of all sections meet
    in one array of the row and leave by one explode: one scan, one shuffle."""
    trimmed = py_strip(F.col("text"))
    as_object = F.when(trimmed.startswith("["), F.concat(F.lit('{"top":'), "text", F.lit("}"))).when(trimmed.startswith("{"), F.col("text"))
    schema = ", ".join(f"{s} string" for s in (*EVAL_SECTIONS, "top")) + ", " + EVAL_PAYLOAD

    def entry(rank, pos, ident, p):
        return F.struct(F.lit(rank).alias("rank"), pos.alias("pos"), ident.alias("instance_id"), p["resolved"].alias("resolved"),
                        p["patch_successfully_applied"].alias("patch_successfully_applied"))

    def parsed(text, build):
        return F.transform(F.array(F.from_json(F.when(text.startswith("{"), text), EVAL_PAYLOAD)), build)[0]

    def section(text, rank):
        of_map = F.transform(F.map_entries(F.from_json(F.when(text.startswith("{"), text), "map<string,string>")), lambda e, i: parsed(
            e["value"], lambda p: F.when(e["value"].startswith("{"), entry(rank, i, e["key"], p))))
        of_list = F.transform(F.from_json(F.when(text.startswith("["), text), "array<string>"), lambda e, i: parsed(
            e, lambda p: F.when(e.startswith("{"), entry(rank, i, _id_of(p, F.lit(None).cast("string")), p))))
        return F.coalesce(of_map, of_list, F.array())

    def entries(r):
        listed = F.concat(*[section(r[name], rank) for rank, name in enumerate((*EVAL_SECTIONS, "top"))])
        named = F.filter(listed, lambda e: F.coalesce(e["instance_id"], F.lit("")) != "")
        lone = F.array(entry(-1, F.lit(0), r["instance_id"], r))
        return F.transform(F.array(named), lambda n: F.when(F.size(n) > 0, n).when(
            F.coalesce(r["instance_id"], F.lit("")) != "", lone))[0]

    found = files.select("file", F.explode(F.transform(F.array(F.from_json(as_object, schema)), entries)[0]).alias("e"))
    return (found.groupBy("file", "e.instance_id")
            .agg(F.max_by(F.struct("e.resolved", "e.patch_successfully_applied"), F.struct("e.rank", "e.pos")).alias("x"))
            .select("file", "instance_id", "x.*"))


def read_evaluator_report(spark: SparkSession, path: str) -> DataFrame:
    return parse_evaluator_reports(spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))


# ------------------------------------------------------------------ SRC-15
def task_catalogue(spark: SparkSession) -> DataFrame:
    """SRC-15: the task dimension (idx, name, language, security_rules); a
    fixed 11-row table, so broadcasting it has a proven size bound."""
    from gavel.constants import TASK_CATALOGUE
    return spark.createDataFrame([(i, n, lang, list(rules)) for i, (n, lang, rules) in enumerate(TASK_CATALOGUE)],
                                 "idx int, name string, language string, security_rules array<string>")


# ------------------------------------------------------------------ SRC-9, 10, 16
EVAL_LOG_KEY = r"/([^/]+)/run_instance\.log$"


def newest_texts(files: DataFrame, key_regex: str) -> DataFrame:
    """SRC-9 over (path, mtime, text): the newest file's text per key. The choice
    is made on paths alone; only chosen texts meet it."""
    chosen = newest_per_key(files.select("path", "mtime"), key_regex)
    return files.select("path", "text").join(chosen, "path").select("key", "path", "text")


def read_chosen(spark: SparkSession, chosen: DataFrame) -> DataFrame:
    """(path, text) of the files of a listing that were chosen; no other file is
    opened. Their names pass the driver, as those of every read do (Spark
    plans a scan from the names of its files)."""
    names = [r["path"] for r in chosen.select("path").where("path is not null").distinct().toLocalIterator()]
    if not names:
        return spark.createDataFrame([], "path string, text string")
    literal = [re.sub(r"([\\\[\]{}*?])", r"\\\1", n) for n in names]  # no pattern
    return spark.read.text(literal, wholetext=True).select(
        F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("text"))


def _plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def read_eval_logs(spark: SparkSession, root: str) -> DataFrame:
    """SRC-9: newest ``<id>/run_instance.log`` per instance under root (by
    modification time), with its text; older logs are listed, not opened."""
    newest = written(newest_per_key(list_files(spark, root, "run_instance.log"), EVAL_LOG_KEY), "newest-logs")
    texts = read_chosen(spark, newest).select(_plain_path(F.col("path")).alias("_plain"), "text")
    return newest.withColumn("_plain", _plain_path(F.col("path"))).join(texts, "_plain").select(
        F.col("key").alias("instance_id"), "path", F.col("text").alias("log_text"))


def newest_report(listing: DataFrame, run_id: str) -> DataFrame:
    """SRC-10 over a listing: the newest ``*.<run_id>.json`` (one row, null if none)."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return listing.where(name.endswith(f".{run_id}.json")).agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def newest_report_path(spark: SparkSession, outdir: str, run_id: str) -> DataFrame:
    """SRC-10: the newest ``*.<run_id>.json`` report (one row)."""
    return newest_report(list_files(spark, outdir, f"*.{run_id}.json"), run_id)


def choose_prediction_file(listing: DataFrame) -> DataFrame:
    """SRC-16: per directory, preds_filled.json before preds.json."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    d = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    prio = F.when(name == "preds_filled.json", 0).when(name == "preds.json", 1)
    return (listing.select(d.alias("dir"), "path", prio.alias("prio")).where(F.col("prio").isNotNull())
            .groupBy("dir").agg(F.min_by("path", "prio").alias("path")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with exact 1-based per-file line numbers, split
    across tasks. Each split (file block) knows its start offset; rows per
    block are counted, a running sum over the small per-file block table
    gives each block's first line, and the row's position inside its block
    comes from ``monotonically_increasing_id`` (consecutive within a task)."""
    rows = (spark.read.text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("mid"), "value"))
    blocks = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("mid0"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0)) + 1)
    return (rows.join(blocks.select("file", "block", "mid0", "first"), ["file", "block"])
            .select("file", (F.col("first") + F.col("mid") - F.col("mid0")).alias("line"), "value"))


def read_predictions_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1 for large JSONL files: lines are split across tasks, with exact
    line numbers, and go through the same normaliser."""
    return predictions_of(_checked_lines(numbered_lines(spark, path).select("file", "line", F.col("value").alias("json"))))


# ------------------------------------------------------------------ SRC-1, one large array or map
SPAN_BITS = 15
TASK_BYTES = 16 << 20  # of text that one task sorts or gathers


def _tasks(spark: SparkSession, path: str) -> int:
    """So many tasks that none holds more than ``TASK_BYTES``; file contents are not read."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("n")).first()["n"] or 0
    return max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """Members of JSON files that hold one array or one map each, however
    large: (file, opens, element, text); ``opens`` is ``[`` or ``{``, ``element``
    counts from 1, ``text`` is a value or, in a map, ``"key": value``.

    The text reader cuts byte ranges at commas, so a file spreads over tasks.
    A piece between two commas is a function of the state at its start: whether
    it begins inside a string, and at which depth. (An escape never crosses a
    comma in valid JSON.) It flips the first by its bare quotes and moves the
    depth by the brackets outside strings, counted for both cases. The functions
    compose by running sums inside a span of a byte range (``2 ** SPAN_BITS`` pieces
    at most) and over the spans of a file; a piece that begins outside a string at
    depth 1 opens an element. Only an element's own pieces are ever gathered.
    The number of tasks follows the files' bytes, so a task's share stays as it is."""
    tasks = _tasks(spark, path)
    raw = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')

    def depth(odd):  # net brackets of every other part
        text = F.array_join(F.filter("parts", lambda x, i: i % 2 == odd), "")
        return F.length(F.regexp_replace(text, r"[^\[{]", "")) - F.length(F.regexp_replace(text, r"[^\]}]", ""))

    span = F.shiftright("at", SPAN_BITS)  # of a byte range, so that a task's rows do not grow with it
    place = ["file", "block", "span"]
    here = Window.partitionBy(*place).orderBy("at")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    pieces = raw.withColumn("parts", parts).select(
        "file", "block", span.alias("span"), "at", "value", (F.size("parts") - 1).alias("quotes"), depth(0).alias("out"), depth(1).alias("inside"))
    pieces = pieces.repartition(tasks, *place)
    odd = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    pieces = pieces.withColumn("odd", odd).select(
        "file", "block", "span", "at", "value", "quotes", "odd",
        F.when(F.col("odd") == 0, F.col("out")).otherwise(F.col("inside")).alias("move0"),
        F.when(F.col("odd") == 0, F.col("inside")).otherwise(F.col("out")).alias("move1"))
    pieces = written(pieces.select("*", *[F.coalesce(F.sum(f"move{k}").over(before), F.lit(0)).alias(f"depth{k}") for k in (0, 1)]),
                     "json-pieces")

    earlier = Window.partitionBy("file").orderBy("block", "span").rowsBetween(Window.unboundedPreceding, -1)  # a row a span
    ranges = pieces.groupBy(*place).agg(F.sum("quotes").alias("quotes"), F.sum("move0").alias("m0"), F.sum("move1").alias("m1"))
    ranges = ranges.withColumn("start", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    ranges = ranges.select("file", "block", "span", "start", F.coalesce(F.sum(
        F.when(F.col("start") == 0, F.col("m0")).otherwise(F.col("m1"))).over(earlier), F.lit(0)).alias("base"))
    state = (F.col("start") + F.col("odd")) % 2
    at_depth = F.col("base") + F.when(F.col("start") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    opened = pieces.join(F.broadcast(ranges), place).select(
        "file", "block", "span", "at", "value", ((state == 0) & (at_depth == 1)).cast("long").alias("opens"),
        F.when(F.col("block") == 0, F.ascii(_lstripped(F.col("value")))).alias("code"))  # a number: the aggregate hashes instead of sorting
    counts = opened.groupBy(*place).agg(F.sum("opens").alias("n"), F.min_by("code", "at").alias("first"))
    whole = Window.partitionBy("file")
    counts = counts.select("file", "block", "span", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"),
                           (F.sum("n").over(whole) + 1).alias("last"),
                           F.min_by("first", F.struct("block", "span")).over(whole).alias("first"))
    numbered = opened.join(F.broadcast(counts), place).repartition(tasks, *place).select(
        "file", "block", "at", "value", "last", F.when(F.col("first") == ord("["), "[").when(F.col("first") == ord("{"), "{").alias("opens"),
        (F.col("earlier") + F.sum("opens").over(here) + 1).alias("element"))
    texts = numbered.repartition(tasks, "file", "element").groupBy("file", "element", "last", "opens").agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["value"]), ",")
    rows = texts.select("file", "element", "last", "opens", joined.alias("t"))
    rows = rows.withColumn("t", F.when(F.col("element") == 1, _lstripped(F.col("t")).substr(F.lit(2), F.length("t"))).otherwise(F.col("t")))
    rows = rows.withColumn("t", F.when(F.col("element") == F.col("last"), py_rstrip(F.col("t"))).otherwise(F.col("t")))
    closing = F.when(F.col("opens") == "[", "]").when(F.col("opens") == "{", "}")
    bad = F.col("element").eqNullSafe(F.col("last")) & ~F.coalesce(F.substring("t", -1, 1) == closing, F.lit(False))
    rows = rows.withColumn("t", F.when(bad, F.raise_error(F.concat(F.lit("neither a JSON array nor a map: "), F.col("file"))).cast("string"))
                           .when(F.col("element") == F.col("last"), F.expr("substr(t, 1, length(t) - 1)")).otherwise(F.col("t")))
    empty = (F.col("last") == 1) & (py_strip(F.col("t")) == "")
    return rows.where(~empty).select("file", "opens", "element", F.col("t").alias("text"))


def _lstripped(c: Column) -> Column:
    return F.regexp_replace(c, "^\ufeff?[ \t\r\n]*", "")


def read_predictions_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1 for large files that hold one array or one map: members are found
    and parsed in parallel (``json_elements``) and go through the normaliser of
    ``read_predictions``. A map that is one prediction (it has an id key) is put
    together again. A malformed member fails the job; of equal keys of a map
    the last one counts, as in the whole-file reader."""
    members = written(json_elements(spark, path), "json-members")
    brackets = F.when(F.col("opens") == "[", F.concat(F.lit("["), F.col("text"), F.lit("]"))).otherwise(
        F.concat(F.lit("{"), F.col("text"), F.lit("}")))
    fault = F.raise_error(F.concat(F.lit("malformed JSON in member "), F.col("element").cast("string"), F.lit(" of "), F.col("file")))
    checked = members.withColumn("json", F.when(_valid_json(brackets), brackets).otherwise(fault.cast("string")))
    values = F.from_json(F.when(F.col("opens") == "[", F.col("json")), "array<variant>")
    entries = F.map_entries(F.from_json(F.when(F.col("opens") == "{", F.col("json")), "map<string,variant>"))
    odd = F.when(F.coalesce(F.size(values), F.lit(1)) != 1, fault.cast("string"))
    items = checked.select("file", "opens", "element", "text", F.coalesce(odd, F.lit("")).alias("one"), entries[0]["key"].alias("key"),
                           F.coalesce(F.try_element_at(values, F.lit(1)), entries[0]["value"]).alias("v"))
    single = items.where("opens = '{'").groupBy("file").agg(F.max(F.col("key").isin(*ID_KEYS)).alias("single")).where("single")
    single = F.broadcast(single)  # names of files; dealt by file, the members of one file would meet in one task
    plain = items.where("opens = '['").unionByName(items.where("opens = '{'").join(single, "file", "left_anti"))
    later = plain.where("opens = '{'").groupBy("file", "key").agg(F.max("element").alias("element"), F.min("element").alias("first"))
    plain = plain.where("opens = '['").withColumn("first", F.col("element")).unionByName(
        plain.where("opens = '{'").join(later, ["file", "key", "element"]).select(*plain.columns, "first"))
    records = _records(plain.where("one = ''").select("file", F.lit(None).cast("bigint").alias("line"), F.lit(False).alias("falsy"), "v", "key",
                                    F.col("first").cast("int").alias("pos")))
    whole = members.join(single, "file", "left_semi").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("element", "text"))).alias("p"))
    units = whole.select("file", F.lit(None).cast("bigint").alias("line"), F.concat(
        F.lit("{"), F.array_join(F.transform("p", lambda x: x["text"]), ","), F.lit("}")).alias("json"))
    return records.unionByName(predictions_of(units))
