"""Markdown to units and chunks.

Line-level structure (fences, tables, headings, islands of equal kind) is native:
windows over the lines of a document. What is sequential by nature (packing text
to a size, cutting at the last blank) runs in Arrow-batched functions, a document
at a time.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import chunk_type, code_symbols, fnv1a, heading_id, index_tokens, referenced_files, strings, strip_blocks, strip_inline, tech_terms

OVERVIEW = "문서 개요"
LEGACY_CHARS, STRUCTURED_CHARS, SHORT_CHARS = 1100, 1400, 80
SCHEMAS = ("legacy-v1", "structure-aware-v1", "structure-aware-contextual-v1")


def lines(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, pos, line)."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("pos", "line"))


def islands(rows: DataFrame, key: str, kind: str, pos: str = "pos") -> DataFrame:
    """``rows`` with ``island``: the number of the run of equal ``kind`` a row is in."""
    w = Window.partitionBy(key).orderBy(pos)
    change = F.coalesce((F.col(kind) != F.lag(kind).over(w)).cast("int"), F.lit(1))
    return rows.withColumn("_c", change).withColumn("island", F.sum("_c").over(w)).drop("_c")


def table_blocks(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, block, kind, text): runs of lines with a bar are tables, others text, joined by blanks and stripped."""
    rows = lines(docs, key, text).withColumn("kind", F.when(F.contains(F.trim("line"), F.lit("|")), "table").otherwise("text"))
    runs = islands(rows, key, "kind").groupBy(key, "island", "kind").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    body = lambda sep: F.array_join(F.transform("l", lambda x: x["line"]), sep)
    out = runs.select(key, F.col("island").alias("block"), "kind", F.when(F.col("kind") == "table", body("\n")).otherwise(strip_blocks(body(" "))).alias("text"))
    return out.where(F.trim("text") != "")


def units(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, unit, kind, heading_path, heading, section, text) of prose, tables and fenced code.

    Fence state is the parity of fences before a line; headings inside code do not
    count. A heading's path holds the last heading of each smaller level since.
    ``section`` numbers the H2 and H3 headings of a document; null before the
    first and after an H1.
    """
    w = Window.partitionBy(key).orderBy("pos")
    rows = lines(docs, key, text)
    rows = rows.withColumn("fence", F.col("line").rlike(r"^```\w*\s*$"))
    rows = rows.withColumn("fences", F.sum(F.col("fence").cast("int")).over(w))
    rows = rows.withColumn("code", ~F.col("fence") & (F.col("fences") % 2 == 1))
    rows = rows.withColumn("level", F.when(~F.col("code") & ~F.col("fence"), F.nullif(F.length(F.regexp_extract("line", r"^(#{1,4})\s+.+$", 1)), F.lit(0))))
    rows = rows.withColumn("title", F.when(F.col("level").isNotNull(), strip_inline(F.regexp_extract("line", r"^#{1,4}\s+(.+)$", 1))))
    rows = rows.withColumn("heads", F.sum(F.col("level").isNotNull().cast("int")).over(w))
    trimmed = F.trim("line")
    table = ~F.col("code") & F.contains(trimmed, F.lit("|")) & (trimmed.startswith("|") | F.col("line").rlike(r"\|.+\|"))
    rows = rows.withColumn("kind", F.when(F.col("fence") | F.col("level").isNotNull(), "mark").when(F.col("code"), "code").when(table, "table").otherwise("prose"))
    # The path: for each level the last heading, if no smaller level came after it.
    at = lambda n: F.max(F.when(F.col("level") == n, F.col("pos"))).over(w)
    rows = rows.withColumns({f"_p{n}": at(n) for n in (1, 2, 3, 4)})
    rows = rows.withColumns({f"_t{n}": F.last(F.when(F.col("level") == n, F.col("title")), ignorenulls=True).over(w) for n in (1, 2, 3, 4)})
    live = lambda n: F.when(F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(f"_p{m}", F.lit(-1)) for m in range(1, n)]) < F.col(f"_p{n}"), F.col(f"_t{n}"))
    path = F.concat_ws(" > ", live(1), live(2), live(3), live(4))
    section = F.sum(F.col("level").isin(2, 3).cast("int")).over(w)
    rows = rows.withColumn("heading_path", F.when(path == "", OVERVIEW).otherwise(path))
    own = F.greatest(F.coalesce("_p2", F.lit(-1)), F.coalesce("_p3", F.lit(-1)))
    rows = rows.withColumn("section", F.when(own > F.coalesce("_p1", F.lit(-1)), section))
    rows = rows.withColumn("_k", F.concat_ws("|", "kind", F.col("heads").cast("string"), F.col("fences").cast("string")))
    runs = islands(rows, key, "_k").where("kind <> 'mark'")
    out = runs.groupBy(key, "island", "kind").agg(F.first("heading_path").alias("heading_path"), F.first("section").alias("section"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    out = out.select(key, F.col("island").alias("unit"), "kind", "heading_path", "section", F.when(F.col("kind") == "prose", F.regexp_replace(body, r"(?U)\A\s+|\s+\z", "")).otherwise(body).alias("text"))
    return out.where("kind <> 'prose' OR text <> ''")


def headings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, n, level, text, base_id, heading_id) of H2 and H3. base_id may repeat; heading_id numbers repeats and
    steps over ids that are taken."""
    rows = lines(docs, key, text)
    rows = rows.withColumn("level", F.length(F.regexp_extract("line", r"^(#{2,3})[ \t]+.+$", 1))).where("level > 0")
    rows = rows.withColumn("text", strip_inline(F.regexp_extract("line", r"^#{2,3}[ \t]+(.+)$", 1))).withColumn("base_id", heading_id(F.col("text")))
    all_of = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "level", "text", "base_id"))).alias("h"))
    return all_of.select(key, F.posexplode(F.transform(allocated(F.col("h")), lambda h: h)).alias("n", "h")).select(key, "n", "h.level", "h.text", "h.base_id", "h.heading_id")


def allocated(heads: Column) -> Column:
    """Heading structs with ``heading_id``: base, base-2, base-3 ..., the first that is free. Sequential, a document at a time."""
    none = F.array().cast("array<struct<level:int,text:string,base_id:string,heading_id:string>>")

    def step(acc: Column, h: Column) -> Column:
        used = F.transform(acc, lambda x: x["heading_id"])
        name = lambda i: F.when(i == 1, h["base_id"]).otherwise(F.concat(h["base_id"], F.lit("-"), i.cast("string")))
        free = F.filter(F.transform(F.sequence(F.lit(1), F.size(acc) + 1), name), lambda n: ~F.array_contains(used, n))
        return F.concat(acc, F.array(F.struct(h["level"].alias("level"), h["text"].alias("text"), h["base_id"].alias("base_id"), free[0].alias("heading_id"))))

    return F.aggregate(heads, none, step)


def cut_text(text: str, most: int, least: float) -> list[str]:
    """Parts of at most ``most`` characters, cut behind the last blank if that stands beyond ``least``."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text):
            back = text.rfind(" ", at, end) - at
            if back > least:
                end = at + back + 1
        if part := text[at:end].strip():
            out.append(part)
        at = end
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_long(texts: pd.Series, most: pd.Series) -> pd.Series:
    """Prose in parts of at most ``most`` characters; a short text is one part."""
    return pd.Series([None if t is None else [t] if len(t) <= m else cut_text(t, int(m), 0.4 * m) for t, m in zip(texts, most)])


def fixed_parts(docs: DataFrame, key: str, text: Column, width: int) -> DataFrame:
    """(key, part, text): every ``width`` characters of a text."""
    n = F.ceil(F.length(text) / width).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(text, i * width + 1, F.lit(width)))
    return docs.where(F.length(text) > 0).select(key, F.posexplode(pieces).alias("part", "text"))


def _merge_short(pdf: pd.DataFrame) -> pd.DataFrame:
    out: list[dict] = []
    for row in pdf.sort_values("unit").to_dict("records"):
        last = out[-1] if out else None
        same = last and row["kind"] == "prose" == last["kind"] and len(row["text"]) < SHORT_CHARS and (last["section"] == row["section"] or pd.isna(last["section"]) and pd.isna(row["section"]))
        if same:
            note = "" if last["heading_path"] == row["heading_path"] else f"({row['heading_path']})\n"
            last["text"] = f"{last['text']}\n\n{note}{row['text']}".strip()
        else:
            out.append(row)
    return pd.DataFrame(out, columns=pdf.columns)


def merge_short(found: DataFrame, key: str) -> DataFrame:
    """Prose of under 80 characters joins the prose before it in its section, with its path noted if that differs."""
    return found.groupBy(key).applyInPandas(_merge_short, found.schema)


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    out, order = [], 0
    for section, group in pdf.sort_values(["section_no", "block"]).groupby("section_no", sort=True):
        held, title = "", group["section"].iloc[0]
        found = []
        for kind, text in zip(group["kind"], group["text"]):
            if kind == "table":
                found += [held.strip(), text]
                held = ""
            elif len(held) + len(text) + 2 <= LEGACY_CHARS:
                held = f"{held} {text}" if held else text
            else:
                found.append(held.strip())
                held, at = "", 0
                while at < len(text):
                    part = text[at : at + LEGACY_CHARS]
                    cut = part.rfind(" ") if len(part) == LEGACY_CHARS else len(part)
                    end = at + (cut if cut > 300 else len(part))
                    found.append(text[at:end].strip())
                    at = end
        for text in [*found, held.strip()]:
            if text:
                out.append((pdf.iloc[0, 0], title, order, text))
                order += 1
    return pd.DataFrame(out, columns=[pdf.columns[0], "section", "chunk_order", "text"])


_FENCE = re.compile(r"```(\w*)\r?\n(.*?)```", re.S)


# What a code block is summed up by, in order: languages (none: any), label, pattern, least length of an
# item and most items. The first row of its language that finds something, or asks for no item, is taken.
SUMMARIES = (
    (("json",), "JSON Payload Keys", r'"([^"]+)"\s*:', 1, 15, False),
    (("bash", "sh", "cmd", "text"), "Commands", r"(npm run \S+|npm test|npm install|tsc --noEmit|vite build|serve_ai_overlay\.py\s+\S+)", 1, None, True),
    ((), "Code Keywords", r"([A-Za-z0-9_-]+)", 4, 15, False),
)


def json_keys(code: str) -> list[str] | None:
    import json

    try:
        return [str(k) for k in json.loads(code)]
    except (ValueError, TypeError, RecursionError):
        return None


def fence_summary(code: str, lang: str) -> str:
    """One line that stands for a code block."""
    code = code.strip()
    for languages, label, pattern, least, most, needed in SUMMARIES:
        if languages and lang not in languages:
            continue
        items = json_keys(code) if lang == "json" else None
        if items is None:
            found = dict.fromkeys(re.findall(pattern, code))
            items = [x for x in found if len(x) >= least][:most]
        if items or not needed:
            return f"[{label}: {', '.join(items)}]"
    return ""


@F.pandas_udf(T.StringType())
def inline_fences(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _FENCE.sub(lambda m: f"\n{fence_summary(m[2], m[1])}\n", t))


def legacy_chunks(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, section, chunk_order, text): sections at H1 to H3, tables on their own, text packed to 1,100 characters."""
    rows = lines(docs, key, text)
    w = Window.partitionBy(key).orderBy("pos")
    head = F.regexp_extract("line", r"^#{1,3}\s+(.+)$", 1)
    rows = rows.withColumn("head", F.when(head != "", head)).withColumn("section_no", F.sum(F.col("line").rlike(r"^#{1,3}\s+.+$").cast("int")).over(w))
    rows = rows.withColumn("section", F.coalesce(F.last("head", ignorenulls=True).over(w), F.lit(OVERVIEW))).where("head IS NULL")
    bodies = rows.groupBy(key, "section_no", "section").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    bodies = bodies.select(key, "section_no", "section", inline_fences(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("body")).where(F.trim("body") != "")
    whole = bodies.withColumn("_s", F.struct(key, "section_no", "section"))
    blocks = table_blocks(whole, "_s", F.col("body")).select(f"_s.{key}", "_s.section_no", "_s.section", "block", "kind", "text")
    kind = docs.schema[key].dataType.simpleString()
    return blocks.groupBy(key).applyInPandas(_pack, f"`{key}` {kind}, section string, chunk_order int, text string")


def structured_chunks(docs: DataFrame, key: str, contextual: bool = False, most: int = STRUCTURED_CHARS) -> DataFrame:
    """Chunks of units: tables and code whole, prose in parts, with types, symbols, hashes and, if asked, a contextual prefix.

    ``docs`` holds key and body, and may hold title, category, summary, tags, entities and relatedDocs.
    """
    have = lambda c, empty: F.col(c) if c in docs.columns else empty
    found = merge_short(units(docs, key, F.col("body")), key)
    parts = F.when(F.col("kind") == "prose", split_long(strip_inline(F.col("text")), F.lit(most))).otherwise(F.array(F.trim("text")))
    rows = found.select(key, "unit", "kind", "heading_path", "section", F.posexplode(parts).alias("part", "content"))
    meta = docs.select(
        key,
        have("title", F.col(key).cast("string")).alias("title"),
        have("category", F.lit("Unknown")).alias("category"),
        have("summary", F.lit("")).alias("summary"),
        have("tags", strings(())).alias("tags"),
        have("entities", strings(())).alias("entities"),
        have("relatedDocs", strings(())).alias("related"),
    )
    rows = rows.join(meta, key)
    rows = rows.withColumns({
        "chunk_type": chunk_type(F.col("heading_path"), F.col("content"), F.col("kind")),
        "code_symbols": F.when(F.col("kind") == "code", code_symbols(F.col("content"))).otherwise(code_symbols(F.col("content"), 8)),
        "referenced_files": referenced_files(F.concat_ws("\n", "content", "summary")),
        "tech_terms": tech_terms(F.concat_ws("\n", "content", F.array_join("entities", " ")), F.col("tags")),
    })
    some = lambda label, values, n: F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(F.slice(values, 1, n), ", ")))
    prefix = F.concat_ws(
        "\n",
        F.concat(F.lit("문서: "), "title"),
        F.concat(F.lit("분류: "), F.coalesce("category", F.lit("Unknown"))),
        F.concat(F.lit("섹션: "), "heading_path"),
        some("관련 기술: ", "tech_terms", 8),
        some("관련 파일: ", "referenced_files", 6),
        some("관련 문서: ", "related", 6),
    )
    rows = rows.withColumn("contextual_prefix", prefix if contextual else F.lit(""))
    rows = rows.withColumn("text", F.when(F.col("contextual_prefix") != "", F.concat_ws("\n\n", "contextual_prefix", "content")).otherwise(F.col("content")))
    return hashed(rows, key, contextual)


def hashed(rows: DataFrame, key: str, contextual: bool) -> DataFrame:
    """Chunk rows with content_hash, chunk_hash, chunk_id, schema version and chunk_order."""
    sha = lambda c: F.substring(F.sha1(c), 1, 16)
    rows = rows.withColumn("content_hash", sha(F.col("content")))
    mark = F.lit("ctx1" if contextual else "ctx0")
    rows = rows.withColumn("chunk_hash", sha(F.concat_ws("|", F.col(key).cast("string"), "heading_path", "chunk_type", "content_hash", mark, F.lit(SCHEMAS[1]))))
    order = F.row_number().over(Window.partitionBy(key).orderBy("unit", "part")) - 1
    return rows.withColumn("chunk_id", F.concat_ws("#", F.col(key).cast("string"), "chunk_hash")).withColumn("chunk_schema_version", F.lit(SCHEMAS[2] if contextual else SCHEMAS[1])).withColumn("chunk_order", order)


def legacy_chunk_id(key: Column, section: Column, text: Column) -> Column:
    return F.concat_ws("#", key.cast("string"), F.lower(F.hex(fnv1a(F.concat_ws(":", section, text)))))


def token_count(text: Column) -> Column:
    return F.size(index_tokens(text))
