"""Reading a corpus of Markdown files with frontmatter, and the small file formats around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_filled, string_list

LISTS = ("tags", "relatedDocs", "relatedFiles", "relatedSlugs", "entities", "supersedes", "relations")
SCALARS = ("title", "navTitle", "shortTitle", "category", "updatedAt", "summary", "description", "intro", "project", "type", "status", "evidenceLevel", "verifiedAt", "canonicalFor", "supersededBy", "portfolio_use", "evidence_type", "wikiVisibility", "visibility")

# Rank of the categories in document order.
CATEGORY_ORDER = ("Overview", "Project", "Architecture", "AI Pipeline", "Backend", "Frontend", "Infra", "Experiments", "Bugs", "ADR", "Daily Log", "Portfolio")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(slug, source_path, raw) of every ``*.md`` below a folder; one row a file."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    at = F.col("_metadata.file_path")
    return files.select(F.regexp_extract(at, r"([^/]+)\.md$", 1).alias("slug"), at.alias("source_path"), F.col("value").alias("raw"))


def split_frontmatter(raw: Column) -> tuple[Column, Column]:
    """(frontmatter, body); both null without an opening and a closing line."""
    clean = F.regexp_replace(F.regexp_replace(raw, "^﻿", ""), r"(?U)^\s+", "")
    pattern = r"(?s)\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n(.*))?\z"
    ok = clean.rlike(pattern)
    return F.when(ok, F.regexp_extract(clean, pattern, 1)), F.when(ok, F.regexp_extract(clean, pattern, 2))


def unquote(value: Column) -> Column:
    """Nested matching quotes off, up to three layers."""
    out = F.trim(value)
    for _ in range(3):
        out = F.trim(F.regexp_replace(out, r"(?s)\A(?:\"(.*)\"|'(.*)')\z", "$1$2"))
    return out


def fields(block: Column) -> Column:
    """map of key to value (null for ``null`` and ``~``); indented ``- item`` lines join the key before them."""
    state = F.struct(F.lit(None).cast("string").alias("key"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("m"))

    def put(m: Column, key: Column, value: Column) -> Column:
        return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value))

    def step(acc: Column, line: Column) -> Column:
        item = F.regexp_extract(line, r"^\s+-\s*(.*)$", 1)
        at = F.instr(line, ":")
        key, value = F.trim(F.substring(line, F.lit(1), at - 1)), F.trim(F.substring(line, at + 1, F.length(line)))
        in_list = acc["key"].isNotNull() & line.rlike(r"^\s+-\s*")
        grown = F.concat_ws("\n", F.when(acc["m"][acc["key"]] != "", acc["m"][acc["key"]]), F.concat(F.lit("- "), item))
        nothing = F.lit(None).cast("string")
        bad = (at == 0) | (key == "")
        absent = value.isin("null", "~")
        new_key = F.when(in_list, acc["key"]).when(bad | absent | (value != ""), nothing).otherwise(key)
        new_map = F.when(in_list, put(acc["m"], acc["key"], grown)).when(bad, acc["m"]).otherwise(put(acc["m"], key, F.when(~absent, value)))
        return F.struct(new_key.alias("key"), new_map.alias("m"))

    return F.aggregate(F.split(block, r"\r?\n"), state, step, lambda s: s["m"])


def parse(files: DataFrame) -> DataFrame:
    """Typed documents; files without frontmatter keep their row with ``parse_error``."""
    block, body = split_frontmatter(F.col("raw"))
    rows = files.withColumn("_block", block).withColumn("body", body)
    rows = rows.withColumn("parse_error", F.when(F.col("_block").isNull(), "missing frontmatter"))
    rows = rows.withColumn("_f", fields(F.coalesce("_block", F.lit(""))))
    rows = rows.withColumns({c: unquote(F.col("_f")[c]) for c in SCALARS}).withColumns({c: string_list(F.col("_f")[c]) for c in LISTS})
    title = first_filled(F.col("navTitle"), F.col("shortTitle"), F.col("title"), F.col("slug"))
    rank = F.array_position(F.array(*[F.lit(c) for c in CATEGORY_ORDER]), F.col("category"))
    order = F.coalesce(F.col("_f")["order"].cast("int"), F.when(rank > 0, rank.cast("int")), F.lit(999))
    shown = F.coalesce(F.when(F.trim(unquote(F.col("_f")["displayTitle"])) != "", unquote(F.col("_f")["displayTitle"])), title)
    return rows.withColumn("displayTitle", shown).withColumn("order", order).drop("_block", "_f")


def is_excluded(status: Column, visibility: Column) -> Column:
    """Archived documents and internal ones do not enter the public index."""
    flat = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (flat(status) == "archived") | (flat(visibility) == "internal")


def load(spark: SparkSession, path: str) -> DataFrame:
    """Public documents of a folder."""
    docs = parse(scan(spark, path)).where("parse_error IS NULL")
    return docs.where(~is_excluded(F.col("status"), F.coalesce("wikiVisibility", "visibility")))


def read_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One record a line; blank lines are skipped."""
    lines = spark.read.schema(schema) if schema else spark.read
    return lines.json(path)


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def latest_run(runs: DataFrame) -> DataFrame:
    """Rows of the newest run; run ids sort by time."""
    return runs.join(F.broadcast(runs.agg(F.max("run_id").alias("run_id"))), "run_id", "left_semi")


def setting(spark: SparkSession, key: str, fallback, kind=str):
    """A session setting as text, number or boolean, with a fallback for absent or malformed values."""
    value = spark.conf.get(key, None)
    if value is None or value == "":
        return fallback
    if kind is bool:
        return value.strip().lower() in ("1", "true", "yes", "on")
    try:
        return kind(value)
    except ValueError:
        return fallback


def typed(parsed: DataFrame, types=None, statuses=None, evidence=None) -> DataFrame:
    """Parsed documents by the strict contract: title, category and updatedAt are required and the category must be
    known, or ``parse_error`` says so; unknown types, statuses and evidence levels become null; the description is the
    first of description, summary and intro, and the excerpt that or the body's beginning."""
    from ..functions.text import excerpt, plain_body
    from ..operators.quality import EVIDENCE, STATUSES, TYPES

    missing = F.col("title").isNull() | F.col("category").isNull() | F.col("updatedAt").isNull()
    error = F.coalesce("parse_error", F.when(missing, "title, category, and updatedAt are required").when(~F.col("category").isin(*CATEGORY_ORDER), F.concat(F.lit("unknown category: "), "category")))
    known = lambda c, allowed: F.when(F.col(c).isin(*allowed), F.col(c))
    rows = parsed.withColumn("parse_error", error)
    rows = rows.withColumns({"type": known("type", types or TYPES), "status": known("status", statuses or STATUSES), "evidenceLevel": known("evidenceLevel", evidence or EVIDENCE)})
    rows = rows.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in ("verifiedAt", "canonicalFor", "supersededBy")})
    rows = rows.withColumn("description", F.coalesce("description", "summary", "intro"))
    return rows.withColumn("excerpt", F.coalesce("description", excerpt(plain_body(F.col("body")), 180)))


def indexable(parsed: DataFrame) -> DataFrame:
    """(slug) of the documents that enter the index."""
    return parsed.where("parse_error IS NULL").where(~is_excluded(F.col("status"), F.coalesce("wikiVisibility", "visibility"))).select("slug")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_index(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame | None:
    """A stored index, in Parquet or JSON; nothing if it does not exist or cannot be read."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.format(kind).load(path) if exists(spark, path) else None
    except AnalysisException:
        return None


def parse_settings(text: str) -> dict:
    """Settings of a small indented file: ``key: value``, nested keys, ``[a, b]`` and ``- item`` lists, numbers,
    booleans and null; ``#`` begins a comment."""

    def value(raw: str):
        raw = raw.strip()
        if raw[:1] == raw[-1:] and raw[:1] in "\"'" and len(raw) > 1:
            return raw[1:-1]
        if raw.startswith("[") and raw.endswith("]"):
            return [value(x) for x in raw[1:-1].split(",") if x.strip()]
        if raw.lower() in ("", "null", "~"):
            return None
        if raw.lower() in ("true", "false"):
            return raw.lower() == "true"
        for kind in (int, float):
            try:
                return kind(raw)
            except ValueError:
                pass
        return raw

    out: dict = {}
    levels: list[tuple[int, dict, str | None]] = [(-1, out, None)]  # indent, place, key that waits for its value
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        indent, said = len(bare) - len(bare.lstrip()), bare.strip()
        while levels[-1][0] > indent or levels[-1][0] == indent and not said.startswith("- "):
            levels.pop()
        if said.startswith("- "):
            while levels[-1][2] is None and len(levels) > 1:
                levels.pop()
            _, place, key = levels[-1]
            if key is not None:
                if not isinstance(place.get(key), list):
                    place[key] = []
                place[key].append(value(said[2:]))
            continue
        key, _, rest = said.partition(":")
        _, place, waits = levels[-1]
        if waits is not None:
            if not isinstance(place.get(waits), dict):
                place[waits] = {}
            place = place[waits]
        place[key.strip()] = value(rest)
        levels.append((indent, place, key.strip() if not rest.strip() else None))
    return out


def run_stamp(now=None) -> str:
    """Id of a run that sorts by time."""
    from datetime import datetime, timezone

    return (now or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%SZ")
