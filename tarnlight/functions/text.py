"""Column functions on text. The three tokenizers differ on purpose and are kept apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words the index tokenizer drops.
INDEX_STOP = (
    "the", "and", "for", "with", "that", "this", "what", "how", "are", "is",
    "은", "는", "이", "가", "을", "를", "에", "의", "와", "과", "로", "으로", "어떻게", "무엇", "인가요", "되나요",
)

# Words the answer gate drops.
GATE_STOP = (
    "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도", "로", "으로", "에서",
    "하다", "있는", "하는", "대한", "위해", "통해", "또한", "그리고", "또는",
    "무엇", "어떻게", "왜", "언제", "어디서", "누가", "인가요", "했나요", "되나요",
    "됩니다", "습니다", "있나요", "할까요", "인가", "오늘", "내일", "어제",
    "the", "a", "an", "is", "are", "was", "were", "be", "to", "of", "in", "for",
    "on", "and", "or", "what", "how", "why", "does", "do", "did", "can", "will",
    "with", "from", "that", "this", "it", "as", "at", "by",
)

# Words too general to ground an answer.
GATE_GENERIC = (
    "정책", "방식", "회사", "대응", "문제", "결과", "처리", "상태", "기능", "사용",
    "관련", "시스템", "운영", "규정", "알고리즘", "방법", "내용", "정보", "기준",
    "대상", "경우", "부분", "전체", "기본", "설정", "구조", "흐름", "적용", "구현",
    "필요", "가능", "확인", "지원", "제공", "관리", "개선", "발생", "수행", "진행",
    "실제", "현재", "이전", "이후", "다음", "이상", "이하", "정도", "수준",
    "전략", "장애", "면접", "오늘", "경기", "사용량", "감소", "증가", "이내",
    "구매", "가격", "얼마", "누구", "어떤", "항상", "정확히", "발생하면",
    "javascript", "policy", "system", "method", "result", "status", "function", "support",
    "actual", "current", "how", "what", "why", "problem", "strategy",
)

# Words document search drops.
SEARCH_STOP = (
    "이", "가", "을", "를", "은", "는", "에", "의", "와", "과", "도", "로", "으로",
    "및", "등", "그", "저", "수", "것", "때", "더", "좀", "위해", "대한", "있는",
    "하는", "한", "된", "하는가", "어떻게", "무엇", "어떤", "왜",
    "a", "an", "the", "and", "or", "of", "to", "in", "on", "for", "with", "is", "are",
    "was", "were", "be", "as", "by", "from", "that", "this", "it", "at", "how", "what",
    "why", "when", "which",
)

# Endings taken off a gate token, one pass after another.
GATE_ENDINGS = (
    "(았나요|었나요|였나요|인가요|됐나요|했나요|되나요|할까요)$",
    "(합니다|입니다|됩니다|습니다)$",
    "(되어|되는|하는|있는|했던|시킨)$",
    "(부터|까지|에서|으로|로서)$",
    "(을|를|이|가|은|는|의|에|로|와|과|도|만)$",
)
# The one particle document search takes off a token.
SEARCH_PARTICLE = "(이|가|을|를|은|는|와|과|의|로|으로|에서|에게|께|한테|까지|부터|만|도|라도|이나|나)$"

#: White space as the texts' own rules see it (Unicode).
SPACE = r"(?U)\s"
#: Edges of a word of ASCII letters, digits and underscore, whatever Java's \b takes for a letter.
EDGE_L, EDGE_R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def index_tokens(text: Column, stop: Sequence[str] = INDEX_STOP) -> Column:
    """Tokens of index and BM25: lower case, runs of a-z, 0-9 and Hangul, two characters or more, no stop words."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9가-힣]+")
    return F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(*stop))


def gate_token(token: Column) -> Column:
    """A token without its Korean endings; tokens of Latin letters, digits and signs stay."""
    bare = token
    for ending in GATE_ENDINGS:
        bare = F.regexp_replace(bare, ending, "")
    return F.when(token.rlike("[a-z0-9_./-]") & ~token.rlike("[가-힣]"), token).otherwise(bare)


def gate_tokens(text: Column) -> Column:
    """Tokens of the answer gate, in order, with repeats."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_./-]+", " ")
    words = F.filter(F.split(clean, " +"), lambda t: F.length(t) >= 2)
    return F.filter(F.transform(words, gate_token), lambda t: F.length(t) >= 2)


def meaningful_tokens(text: Column) -> Column:
    return F.array_except(F.array_distinct(gate_tokens(text)), strings(GATE_STOP))


def content_tokens(text: Column) -> Column:
    return F.array_except(meaningful_tokens(text), strings(GATE_GENERIC))


def search_text(text: Column) -> Column:
    """Normal form of document search for text that is already in NFKC (see ``nfkc``)."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[_/\\.+]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"(?U)[^\p{L}\p{N}\s-]", " "), rf"{SPACE}+", " "))


def strip_particle(token: Column) -> Column:
    return F.regexp_replace(token, SEARCH_PARTICLE, "")


def fnv1a(text: Column) -> Column:
    """FNV-1a with 32 bits over the characters (code points of the basic plane), unsigned."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    codes = F.when(text == "", F.array().cast("array<bigint>")).otherwise(codes)
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def heading_id(text: Column) -> Column:
    """Anchor of a heading: runs of anything but a-z, 0-9 and Hangul become a dash; ``section`` if nothing is left."""
    base = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9가-힣]+", "-"), "^-+|-+$", "")
    return F.when(base == "", "section").otherwise(base)


def strip_inline(text: Column) -> Column:
    """Markdown links to their labels, no emphasis or code marks, white space collapsed."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1"), "[`*_~]", "")
    return F.trim(F.regexp_replace(plain, rf"{SPACE}+", " "))


def strip_blocks(text: Column) -> Column:
    """Like strip_inline, with heading, quote and bracket marks to blanks."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1"), r"[#>*`\[\]()]", " ")
    return F.trim(F.regexp_replace(plain, rf"{SPACE}+", " "))


def summary(text: Column, width: int = 180) -> Column:
    """The text, or its first ``width`` characters and three dots."""
    return F.when(F.length(text) > width, F.concat(F.rtrim(F.substring(text, 1, width)), F.lit("..."))).otherwise(text)


def excerpt(text: Column, width: int = 220) -> Column:
    """The text, or what stands before the last blank of its first ``width`` characters, and an ellipsis."""
    head = F.substring(text, 1, width)
    back = F.locate(" ", F.reverse(head))
    cut = F.when(back > 0, F.substring(head, F.lit(1), F.lit(width) - back)).otherwise(head)
    return F.when(F.length(text) > width, F.concat(F.rtrim(cut), F.lit("…"))).otherwise(text)


def capped_count(text: Column, token: Column, cap: int = 2) -> Column:
    """Non-overlapping places of a token, at most ``cap``."""
    n = (F.length(text) - F.length(F.replace(text, token, F.lit("")))) / F.length(token)
    return F.when(F.length(token) > 0, F.least(F.lit(cap), n.cast("int"))).otherwise(0)


def string_list(value: Column) -> Column:
    """Frontmatter list: ``[a, b]``, lines of ``- a``, or one value; blanks are no items."""
    v = F.trim(F.coalesce(value, F.lit("")))
    bare = lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")
    inline = F.transform(F.split(F.regexp_replace(v, r"^\[|\]$", ""), ","), bare)
    lines = F.transform(F.filter(F.split(v, r"\r?\n"), lambda x: x.rlike(r"^\s*-\s+")), lambda x: bare(F.regexp_replace(x, r"^\s*-\s+", "")))
    items = F.when(v.rlike(r"(?s)^\[.*\]$"), inline).when(v.rlike(r"^-\s+"), lines).otherwise(F.array(bare(v)))
    return F.filter(items, lambda x: x != "")


def first_filled(*values: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values])


def truthy(value: Column) -> Column:
    """Null for an empty string, as ``||`` chains see it."""
    return F.when(value != "", value)


# Cascade of chunk types, first match wins.
CHUNK_TYPES = (
    ("decision", f"decision|판단|결정|{EDGE_L}adr{EDGE_R}"),
    ("metric", "metric|지표|latency|hit@|recall|mrr|ndcg|benchmark"),
    ("bug", "bug|장애|오류|fix|rollback"),
    ("architecture", "architecture|아키텍처|pipeline|흐름|data-flow"),
)


def chunk_type(heading: Column, body: Column, kind: Column) -> Column:
    hay = F.lower(F.concat_ws("\n", heading, body))
    out = F.when(kind.isin("code", "table"), kind)
    for name, pattern in CHUNK_TYPES:
        out = out.when(hay.rlike(pattern), name)
    return out.otherwise("prose")


# Words of programs that are no symbols.
KEYWORDS = ("const", "function", "return", "import", "export", "class", "true", "false")


def code_symbols(text: Column, most: int = 24) -> Column:
    """Identifiers of four characters or more that are no keywords, first come first, at most ``most``."""
    # An identifier ends in a word character: signs at its end are not part of it.
    found = F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_.-]+[A-Za-z0-9_]){EDGE_R}"), 1)
    keep = F.filter(found, lambda t: (F.length(t) > 3) & ~F.lower(t).isin(*KEYWORDS))
    return F.slice(F.array_distinct(keep), 1, most)


# Endings of files that count as references.
FILE_ENDINGS = "py|ts|tsx|js|mjs|java|yml|yaml|md|json|sh|bat"


def referenced_files(text: Column, most: int = 20) -> Column:
    """Path-like names with a known ending, first come first, at most ``most``."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"([A-Za-z0-9_./-]+\.(?:{FILE_ENDINGS})){EDGE_R}"), 1)), 1, most)


# Names that count as technical terms, in this order.
TECH_TERMS = ("YOLO[A-Za-z0-9_.-]*", "LSTM", "ByteTrack", "RTSP", "WebRTC", "MQTT", "MediaMTX", "TensorRT", "pgvector", "VLM", "cameraLoginId")


def tech_terms(text: Column, tags: Column, most: int = 20) -> Column:
    found = [F.regexp_extract_all(text, F.lit(f"(?i){EDGE_L}({t})" + ("" if "*" in t else EDGE_R)), 1) for t in TECH_TERMS]
    return F.slice(F.array_distinct(F.concat(tags, *found)), 1, most)


# Forms and names of exact symbols in a question.
SYMBOLS = (
    rf"{EDGE_L}([A-Za-z][A-Za-z0-9]*(?:[A-Z][A-Za-z0-9]+)+){EDGE_R}",
    rf"{EDGE_L}([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+){EDGE_R}",
    rf"{EDGE_L}([A-Za-z][A-Za-z0-9]*/[A-Za-z0-9_./-]*[A-Za-z0-9_]){EDGE_R}",
    rf"(?i){EDGE_L}(TensorRT|PyTorch|ByteTrack|WebRTC|MQTT|YOLO|LSTM|RTSP|MJPEG|frameId|cameraLoginId|streamRunId|workerRunId|VIDEO_EOF){EDGE_R}",
)


def exact_symbols(text: Column) -> Column:
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in SYMBOLS]))


# What asks for a number or a state.
NUMERIC_INTENT = (
    r"몇\s*퍼센트", r"몇\s*%", r"(?i)몇\s*ms", r"몇\s*와트", r"몇\s*초", r"정확히\s*얼마", "얼마인가요", "얼마인가",
    r"가격은\s*얼마", r"비용은\s*얼마", "항상", r"실제\s*적용", "적용됐", "적용되었", "완료됐", "완료되었", r"운영\s*중",
    "검증됐", "검증되었", "감소했", "증가했", r"\d+\s*%", r"(?i)\d+\s*ms", r"\d+\s*초",
)


def numeric_intent(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for p in NUMERIC_INTENT))


FENCE = r"(?s)```.*?```"


def plain_body(text: Column, blank: str = " ") -> Column:
    """A Markdown body without fences and heading marks, white space made ``blank``."""
    bare = F.regexp_replace(F.regexp_replace(text, FENCE, " "), r"(?m)^#+\s+", "")
    return F.trim(F.regexp_replace(bare, rf"{SPACE}+", blank))


def searchable(text: Column) -> Column:
    """A Markdown body for search: fences inlined with their language, marks to blanks."""
    inlined = F.regexp_replace(text, r"(?s)```([A-Za-z0-9_]+)?\r?\n(.*?)```", " $1 $2 ")
    return F.trim(F.regexp_replace(F.regexp_replace(inlined, r"[#>*`|\[\]()]", " "), rf"{SPACE}+", " "))


def is_excerpt_again(body: Column, excerpt_text: Column, width: int = 30) -> Column:
    """Whether an excerpt begins as its body does, in their first ``width`` characters without white space."""
    own, said = plain_body(body, ""), F.regexp_replace(F.regexp_replace(F.coalesce(excerpt_text, F.lit("")), "…$", ""), rf"{SPACE}+", "")
    n = F.least(F.lit(width), F.length(own), F.length(said))
    return F.coalesce((n > 0) & (F.substring(own, F.lit(1), n) == F.substring(said, F.lit(1), n)), F.lit(False))


def newest_dated(slugs: Column) -> Column:
    """Of slugs that begin with a date, the latest (of one date, the first); null if none does."""
    dated = F.filter(slugs, lambda s: s.rlike(r"^\d{4}-\d{2}-\d{2}"))
    last = F.array_max(F.transform(dated, lambda s: F.substring(s, 1, 10)))
    return F.get(F.filter(dated, lambda s: F.substring(s, 1, 10) == last), F.lit(0))


def content_hash(*columns: Column) -> Column:
    """Hash of a document's content: changes with any of the columns, nulls and empty texts told apart."""
    return F.sha1(F.to_json(F.struct(*[c.cast("string").alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}))
