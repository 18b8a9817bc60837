"""Markdown as rows: blocks, tables, inline tokens, wiki links and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .answer import url_part

#: Kinds of lines by their beginning, first match wins; all others that are not blank are paragraphs.
LINE_KINDS = (("heading", r"^#{1,3}\s+.+$"), ("table", r"^\|"), ("list", r"^[-*]\s+"), ("quote", r"^>"))
#: A pipe behind an even number of backslashes.
PIPE = r"(?<!(?<!\\)(?:\\\\){0,32}\\)\|"
#: Links to a document of the same folder; the only ones that become routes.
HREF = r"(?:\./)?([^./\\?#\s\x00-\x1f\x7f][^/\\?#\s\x00-\x1f\x7f]*)\.md(?:#([^#\s\x00-\x1f\x7f]+))?"
INLINE = r"(`[^`\r\n]+`|\*\*[^*\r\n]+\*\*|\[[^\]\r\n]+\]\((?:\./)?[^./\\?#()\s][^/\\?#()\s]*\.md(?:#[^#()\s]+)?\))"


def blocks(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, block, kind, level, text, items, rows, alignments) of each block of a text, in order.

    Kinds: heading, paragraph, list, code, table, quote. A paragraph's lines are
    joined by blanks, behind a hard break (two blanks or a backslash) by a line end.
    Tables that do not hold together are code of language ``text``. A fence runs to
    the next one, or to the end.
    """
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("pos", "line"))
    along = Window.partitionBy(key).orderBy("pos")
    fence = F.startswith("line", F.lit("```"))
    lines = lines.withColumn("fences", F.sum(fence.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    opens, inside = fence & (F.col("fences") % 2 == 1), (F.col("fences") % 2 == 1) | fence
    kind = F.when(inside, "code").when(F.trim("line") == "", "blank")
    for name, pattern in LINE_KINDS:
        kind = kind.when(F.col("line").rlike(pattern), name)
    lines = lines.withColumn("kind", kind.otherwise("paragraph")).withColumn("opens", opens).withColumn("fence", fence)
    new = opens | (F.col("kind") == "heading") | ~F.col("kind").eqNullSafe(F.lag("kind").over(along))
    lines = lines.withColumn("block", F.sum(new.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    found = lines.where("kind <> 'blank'").groupBy(key, "block", "kind").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "fence"))).alias("l"))
    said = F.transform("l", lambda x: x["line"])
    code = F.transform(F.filter("l", lambda x: ~x["fence"]), lambda x: x["line"])
    cells = F.transform(said, table_row)
    header, ruled = F.get(cells, F.lit(0)), alignments(F.get(cells, F.lit(1)))
    sound = ruled.isNotNull() & F.forall(header, lambda c: c != "") & F.forall(cells, lambda r: F.coalesce(F.size(r) == F.size(header), F.lit(False)))
    sound = F.coalesce(sound, F.lit(False)) & (F.col("kind") == "table")
    broken = (F.col("kind") == "table") & ~sound
    heading = F.regexp_extract(said[0], r"^(#{1,3})\s+(.+)$", 2)
    body = F.when(F.col("kind") == "heading", F.trim(heading)).when(broken, F.array_join(said, "\n")).when(F.col("kind") == "code", F.array_join(code, "\n")).when(F.col("kind") == "paragraph", paragraph(said))
    items = F.when(F.col("kind") == "list", F.transform(said, lambda x: F.regexp_replace(x, r"^[-*]\s+", ""))).when(F.col("kind") == "quote", F.transform(said, lambda x: F.regexp_replace(x, r"^>\s?", "")))
    language = F.when(broken, "text").when(F.col("kind") == "code", F.trim(F.substring(said[0], 4, 1 << 20)))
    order = F.row_number().over(Window.partitionBy(key).orderBy("block")).alias("block")
    return found.select(
        key,
        order,
        F.when(broken, "code").otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("kind") == "heading", F.length(F.regexp_extract(said[0], "^(#{1,3})", 1))).alias("level"),
        language.alias("language"),
        body.alias("text"),
        items.alias("items"),
        F.when(sound, F.filter(cells, lambda r, i: i != 1)).alias("rows"),
        F.when(sound, ruled).alias("alignments"),
    )


def table_row(line: Column) -> Column:
    """Cells of a table line, trimmed, with escaped pipes as pipes; null if it is none."""
    inner = F.substring(line, F.lit(2), F.length(line) - 2)
    cells = F.transform(F.split(inner, PIPE), lambda c: F.trim(F.regexp_replace(c, r"\\\|", "|")))
    return F.when(line.rlike(r"^\|(?s:.*)" + PIPE + "$"), cells)


def alignments(cells: Column) -> Column:
    """left, center, right or none of each cell of a table's second line; null if it is no such line."""
    side = lambda c: F.when(c.rlike("^:.*:$"), "center").when(c.rlike(":$"), "right").when(c.rlike("^:"), "left").otherwise("none")
    return F.when(F.forall(cells, lambda c: c.rlike("^:?-{3,}:?$")), F.transform(cells, side))


def paragraph(lines: Column) -> Column:
    """Lines of a paragraph as one text."""
    hard = lambda x: x.rlike(r"\\$|  $")
    bare = lambda x: F.when(x.rlike(r"\\$"), F.regexp_replace(x, r"\s*\\$", "")).when(x.rlike("  $"), F.regexp_replace(x, "  $", "")).otherwise(F.regexp_replace(x, r"\s+$", ""))
    return F.array_join(F.transform(lines, lambda x, i: F.concat(bare(x), F.when(i == F.size(lines) - 1, "").when(hard(x), "\n").otherwise(" "))), "")


def resolve_href(href: Column) -> Column:
    """Route of a link to a document of the same folder; null for all others."""
    whole = rf"^{HREF}$"
    slug, section = (F.regexp_extract(href, whole, i) for i in (1, 2))
    return F.when(href.rlike(whole) & ~href.rlike(r"(?i)^[a-z][a-z\d+.-]*:"), route(slug, F.when(section != "", section)))


def route(slug: Column, section: Column) -> Column:
    """``#/slug`` or ``#/slug/section``."""
    return F.concat(F.lit("#/"), url_part(slug), F.when(section.isNotNull(), F.concat(F.lit("/"), url_part(section))).otherwise(""))


# Routes of views, by view.
VIEWS = (("search", ("__search__", "__search")), ("rag", ("__rag__", "__rag")))


def parse_route(value: Column) -> Column:
    """struct(view, slug, section) of a route; what cannot be decoded stays as it is."""
    raw = F.trim(F.regexp_replace(value, "^#/?", ""))
    raw = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    view = F.lit("doc")
    for name, words in VIEWS:
        view = F.when(raw.isin(*words), name).otherwise(view)
    at = F.instr(raw, "/")
    slug = F.when(at > 0, F.substring(raw, F.lit(1), at - 1)).otherwise(raw)
    section = F.when(at > 0, F.substring(raw, at + 1, F.length(raw)))
    is_doc = view == "doc"
    return F.struct(view.alias("view"), F.when(is_doc, slug).otherwise("").alias("slug"), F.when(is_doc & (section != ""), section).alias("section"))


def inline_tokens(text: Column) -> Column:
    """array of struct(kind, value, href): code, strong, links to documents, and the text between them, in order."""
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), INLINE, "\0$1\0"), "\0"), lambda x: x != "")

    def token(x: Column) -> Column:
        is_link = x.rlike(f"^{INLINE}$") & F.startswith(x, F.lit("["))
        label, href = (F.regexp_extract(x, r"^\[([^\]]+)\]\(([^()]+)\)$", i) for i in (1, 2))
        is_code, is_strong = x.rlike(r"^`[^`\r\n]+`$"), x.rlike(r"^\*\*[^*\r\n]+\*\*$")
        kind = F.when(is_code, "code").when(is_strong, "strong").when(is_link, "wiki-link").otherwise("text")
        value = F.when(is_code, F.substring(x, F.lit(2), F.length(x) - 2)).when(is_strong, F.substring(x, F.lit(3), F.length(x) - 4)).when(is_link, label).otherwise(x)
        return F.struct(kind.alias("kind"), value.alias("value"), F.when(is_link, resolve_href(href)).alias("href"))

    return F.transform(parts, token)


def title_key(text: Column) -> Column:
    """What titles are compared by: lower case, no quotes, words with single blanks. For text in NFKC."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[“”\"‘’'`]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)[^\p{L}\p{N}\s]+", " "), r"(?U)\s+", " "))


def is_title_again(heading: Column, *titles: Column) -> Column:
    """Whether a first heading only repeats one of the document's titles."""
    own = title_key(heading)
    same = F.lit(False)
    for t in titles:
        same = same | (title_key(t) == own)
    return (own != "") & same


def active_heading(headings: DataFrame, by: str, place: str = "pos", top: str = "top", anchor: float = 96) -> DataFrame:
    """(by, heading): of headings in order, the last before the first one below the anchor; the first if there is none."""
    along = Window.partitionBy(by).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    rows = headings.withColumn("_below", F.max((F.col(top) > anchor).cast("int")).over(along))
    last = F.max_by("heading", F.when(F.col("_below") == 0, F.col(place)))
    return rows.groupBy(by).agg(F.coalesce(last, F.min_by("heading", place)).alias("heading"))
