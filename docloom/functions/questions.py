"""Sentences, question classifiers, sizes and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.sources.tables import WHITE, stripped

# Word lists of the sentence and question classifiers.
CRITICAL = [
    r"is defined as|refers to|means that|is known as|can be described as",
    r"[0-9]+\.?[0-9]*%|[0-9]+\.[0-9]+|[0-9]{2,}",
    r"conclude that|found that|shows that|demonstrates|indicates that|suggests that",
    r"results show|evidence suggests|data indicate|analysis reveals",
    r"key finding|main result|important|critical|essential|significant|notable",
    r"primary|fundamental|crucial|vital|major",
    r"figure [0-9]+|table [0-9]+|equation [0-9]+|chart [0-9]+|graph [0-9]+",
    r"see figure|as shown in|according to table",
    r"average|mean|median|standard deviation|correlation|p-value|significance",
    r"hypothesis|probability|distribution|sample size",
    r"compared to|in contrast|whereas|however|although|while",
    r"relationship between|correlation with|associated with|linked to",
    r"method|procedure|approach|technique|algorithm|protocol",
    r"because|therefore|thus|hence|consequently|as a result",
    r"leads to|results in|causes|affects|influences",
]
DETAIL = [
    r"what is the exact|specific|precisely|particular",
    r"exactly|specifically|in particular",
    r"definition of|what is|what are|define|meaning of",
    r"how much|how many|what percentage|what number",
    r"what rate|what value|what amount",
    r"statistic|number|value|amount|rate|percentage|figure",
    r"average|mean|median|total|sum",
    r"which (?:figure|table|equation|chart)",
    r"according to|as shown in|reference to",
]
COMPARING = ["compare", "contrast", "relationship", "difference", "versus", "vs", "both", "either"]
KEYWORD_WORDS = r"definition|specific|exact|what is|code|name|id"
SEMANTIC_WORDS = r"explain|why|how|describe|compare|relationship|discuss"
ASKS_NUMBER = r"how much|how many|number|percentage"
RETRYABLE = ["rate limit", "timeout", "connection", "network", "temporary", "server error", "internal error", "service unavailable", "bad gateway", "gateway timeout"]
QUERY_TYPES = ["factual", "analytical", "comparative", "follow-up", "clarification"]
LEVELS = {"simple": 0, "moderate": 1, "complex": 2}
TOKEN_CAPS = {"simple": 1200, "moderate": 2000, "complex": 3000}
TYPE_SIZES = {"header": 650, "paragraph": 1250, "table": 1000, "list": 1000, "code": 1200}
COLOURS = {"highlight": "rgba(255, 235, 59, 0.4)", "circle": "rgba(33, 150, 243, 0.5)", "box": "rgba(76, 175, 80, 0.3)", "underline": "rgba(244, 67, 54, 0.5)"}
PRICES = {"gpt-4o": (0.0025, 0.01), "gpt-4o-mini": (0.00015, 0.0006), "gpt-4": (0.03, 0.06)}


def lookup(key: Column, table: dict, default) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


_WORD = r"[\p{L}\p{N}_]"


def has_words(text: Column, alternatives: str) -> Column:
    """Whether one of the alternatives, which begin with a word character, stands between word boundaries."""
    end = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
    return text.rlike(rf"(?i)(?<!{_WORD})(?=[0-9a-z])(?:{alternatives}){end}")


def _sum(flags: list[Column]) -> Column:
    return sum((f.cast("int") for f in flags), F.lit(0))


def split_sentences(text: Column) -> Column:
    """Array of stripped, non-empty sentences; a break follows . ! or ? and white space before a capital A-Z."""
    parts = F.split(text, r"(?<=[.!?])[\t-\r\x1C-\x20\x85\pZ]+(?=[A-Z])", -1)
    return F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(WHITE))), lambda s: s != "")


def critical_matches(text: Column) -> Column:
    """How many of the critical patterns occur; one search for all of them rules most sentences out first."""
    return F.when(has_words(text, "|".join(CRITICAL)), _sum([has_words(text, p) for p in CRITICAL])).otherwise(F.lit(0))


def is_detail_query(q: Column) -> Column:
    return _sum([has_words(q, p) for p in DETAIL]) > 0


def word_number(q: Column) -> Column:
    return F.regexp_count(q, F.lit(r"[^\t-\r\x1C-\x20\x85\pZ]+"))


def is_complex_query(q: Column) -> Column:
    low = F.lower(q)
    comparing = low.rlike("|".join(COMPARING))
    questions = F.length(q) - F.length(F.replace(q, F.lit("?"), F.lit("")))
    return _sum([word_number(q) > 15, low.contains(" and "), low.contains(" or "), questions > 1, comparing]) >= 2


def adaptive_weights(q: Column) -> tuple[Column, Column]:
    """(semantic, keyword) weights: keyword-minded, semantic-minded or balanced."""
    keyword = _sum([q.rlike(r'"[\p{L}\p{N}_\t-\r\x1C-\x20\x85\pZ]+"'), q.rlike("[0-9]"), has_words(F.lower(q), KEYWORD_WORDS), word_number(q) < 5]) / F.lit(4.0)
    semantic = _sum([has_words(F.lower(q), SEMANTIC_WORDS), word_number(q) > 10, q.contains("?")]) / F.lit(3.0)
    pick = lambda a, b, c: F.when(keyword > semantic + 0.3, F.lit(a)).when(semantic > keyword + 0.3, F.lit(b)).otherwise(F.lit(c))
    return pick(0.4, 0.85, 0.7), pick(0.6, 0.15, 0.3)


def route_query(kind: Column, complexity: Column, rerank: bool = True) -> tuple[Column, Column]:
    """(route, chunk limit)."""
    route = F.when(kind.isin("follow-up", "clarification"), "context_aware_path").when(complexity == "complex", "reasoning_path").otherwise("fast_path")
    return route, F.when(route == "fast_path", 3).when(route == "reasoning_path", 40 if rerank else 10).otherwise(5)


def normalise_classification(json: Column, threshold: str = "moderate", enabled: bool = True) -> tuple[Column, Column, Column]:
    """(query_type, complexity, requires_cot) from a classifier's JSON answer."""
    got = F.from_json(json, "query_type string, complexity string")
    kind = F.when(got["query_type"].isin(*QUERY_TYPES), got["query_type"]).otherwise("factual")
    level = F.when(got["complexity"].isin(*LEVELS), got["complexity"]).otherwise("simple")
    return kind, level, (lookup(level, LEVELS, 0) >= LEVELS[threshold]) & F.lit(enabled)


def token_cap(complexity: Column) -> Column:
    return lookup(complexity, TOKEN_CAPS, TOKEN_CAPS["moderate"])


def adaptive_size(kind: Column) -> tuple[Column, Column]:
    """(chunk size, overlap) of a content type."""
    size = F.greatest(F.lit(500), F.least(F.lit(2000), lookup(kind, TYPE_SIZES, 1000)))
    base = (size * F.lit(0.15)).cast("int")
    scaled = F.when(kind == "header", (base * F.lit(0.7)).cast("int")).when(kind.isin("table", "code"), (base * F.lit(1.2)).cast("int")).otherwise(base)
    return size, F.least(F.greatest(F.lit(50), F.least(F.lit(400), scaled)), F.floor(size / 2).cast("int"))


def hierarchical_sizes(base: Column, overlap: Column) -> dict[str, Column]:
    """Sizes of parent and child chunks from the recommended size and overlap."""
    parent = F.greatest(F.lit(500), F.least(F.lit(3000), (base * F.lit(1.5)).cast("int")))
    parent_overlap = (overlap * F.lit(1.5)).cast("int")
    child = F.greatest(F.lit(250), F.least(F.lit(600), (parent * F.lit(0.2)).cast("int")))
    return {"parent_size": parent, "parent_overlap": parent_overlap, "child_size": child, "child_overlap": (parent_overlap * F.lit(0.2)).cast("int")}


def format_chunk(page: Column, content: Column, bbox: Column | None = None, image_id: Column | None = None) -> Column:
    """``[Page n]: text``; an image chunk with a box says where it is and names its id."""
    number = page.cast("string")
    plain = F.concat(F.lit("[Page "), number, F.lit("]: "), content)
    if bbox is None:
        return plain
    corner = [F.format_string("%.1f", F.coalesce(F.get(bbox, F.lit(i)), F.lit(0.0))) for i in range(4)]
    place = F.concat_ws(", ", *corner)
    image = F.concat(F.lit("[Page "), number, F.lit(" - Image at bbox ("), place, F.lit(")]:\nImage ID: "), F.coalesce(image_id, F.lit("")), F.lit("\n"), content)
    return F.when(bbox.isNotNull(), image).otherwise(plain)


def image_chunk_text(page: Column, caption: Column, details: Column, ocr: Column, tags: Column) -> Column:
    """Searchable text of an image; without any caption data a fixed text."""
    head = F.concat(F.lit("Image on page "), page.cast("string"), F.lit(": "))
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    full = F.concat_ws("\n", F.concat(head, F.coalesce(caption, F.lit("No caption"))), part("\nDetails: ", details), part("\nText in image: ", ocr), part("\nTags: ", F.array_join(tags, ", ")))
    none = caption.isNull() & details.isNull() & ocr.isNull() & tags.isNull()
    return F.when(none, F.concat(head, F.lit("No description available"))).otherwise(full)


def table_chunk_text(page: Column, html: Column, markdown: Column, text: Column) -> Column:
    body = F.coalesce(*[F.nullif(c, F.lit("")) for c in (html, markdown, text)], F.lit("Table extracted from document."))
    return F.concat(F.lit("Table on page "), page.cast("string"), F.lit(": "), body)


def bbox_to_percent(bbox: Column, width: float = 612.0, height: float = 792.0) -> dict[str, Column]:
    """Corners of a page of 612 x 792 points as percentages; a box without four numbers becomes 10, 10, 30, 30."""
    corner = [F.get(bbox, F.lit(i)).cast("double") for i in range(4)]
    good = bbox.isNotNull() & corner[0].isNotNull() & corner[1].isNotNull() & corner[2].isNotNull() & corner[3].isNotNull()
    x0, y0, x1, y1 = corner
    pick = lambda v, d: F.when(good, F.round(v * 100, 2)).otherwise(F.lit(d))
    return {"x": pick(x0 / width, 10.0), "y": pick(y0 / height, 10.0), "width": pick((x1 - x0) / width, 30.0), "height": pick((y1 - y0) / height, 30.0)}


def annotation_colour(kind: Column) -> Column:
    return lookup(kind, COLOURS, COLOURS["highlight"])


def fallback_title(text: Column) -> Column:
    words = F.filter(F.split(stripped(text), r"[\t-\r\x1C-\x20\x85\pZ]+"), lambda w: w != "")
    title = F.array_join(F.slice(words, 1, 6), " ")
    return F.substring(F.when(F.length(text) > F.length(title), F.concat(title, F.lit("..."))).otherwise(title), 1, 50)


def clean_score(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(number.between(0, 10), number)


def verify_answer(overall: Column, warnings: Column, retries: Column) -> tuple[Column, Column]:
    """(verified, regenerate)."""
    verified = F.coalesce((overall >= 7) & (warnings == 0), F.lit(False))
    return verified, ~verified & (retries < 1)


def is_retryable(status: Column, message: Column) -> Column:
    return F.coalesce(status.isin(429, 500, 502, 503, 504), F.lit(False)) | F.coalesce(F.lower(message).rlike("|".join(RETRYABLE)), F.lit(False))


def client_key(forwarded: Column, real_ip: Column, host: Column) -> Column:
    first = F.nullif(F.btrim(F.get(F.split(forwarded, ","), F.lit(0))), F.lit(""))
    return F.coalesce(first, F.nullif(real_ip, F.lit("")), F.nullif(host, F.lit("")), F.lit("unknown"))


def parse_caption(answer: Column) -> Column:
    """Struct of the captions from a model's JSON, perhaps fenced; null unless both captions are there."""
    inside = F.regexp_extract(answer, r"```(?:json)?[ \t\n\r]*([^`]*)```", 1)
    got = F.from_json(F.when(inside != "", inside).otherwise(answer), "short_caption string, detailed_description string, ocr_text string")
    short, long = stripped(got["short_caption"]), stripped(got["detailed_description"])
    return F.when((short != "") & (long != ""), F.struct(short.alias("short"), long.alias("long"), F.nullif(stripped(got["ocr_text"]), F.lit("")).alias("ocr")))


def parse_query_list(text: Column, most: int, least_quoted: int) -> Column:
    """The queries of a model's answer: a JSON list, else quoted, numbered or dashed lines; over 3 characters, at most ``most``."""
    trim = lambda xs: F.transform(xs, lambda x: F.btrim(x, F.lit(WHITE)))
    long = lambda xs: F.filter(xs, lambda x: F.length(x) > 3)
    listed = F.from_json(text, "array<string>")
    quoted = F.regexp_extract_all(text, F.lit('"([^"]+)"'), 1)
    numbered = F.regexp_extract_all(text, F.lit(r"[0-9]+\.[\t-\r\x1C-\x20\x85\pZ]*([^\n]+)"), 1)
    dashed = F.regexp_extract_all(text, F.lit(r"-[\t-\r\x1C-\x20\x85\pZ]*([^\n]+)"), 1)
    unquoted = lambda xs: F.transform(long(trim(F.slice(xs, 1, most))), lambda x: F.btrim(x, F.lit('"')))
    fallback = F.when(F.size(quoted) >= least_quoted, long(trim(F.slice(quoted, 1, most)))).when(F.size(numbered) > 0, unquoted(numbered)).otherwise(unquoted(dashed))
    return F.when(listed.isNotNull(), F.slice(long(trim(listed)), 1, most)).otherwise(fallback)


def cache_key(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def vector_key(vector: Column) -> Column:
    """Cache key of a vector: that of its components as text, parted by commas; null for a null vector."""
    return F.when(vector.isNotNull(), cache_key(F.array_join(F.transform(vector, lambda x: x.cast("double").cast("string")), ",")))


def expansion_key(query: Column, n: Column, model: Column) -> Column:
    return F.md5(F.concat_ws("|", query, n.cast("string"), model))


def token_cost(model: Column, prompt: Column, completion: Column) -> Column:
    into, out = lookup(model, {k: v[0] for k, v in PRICES.items()}, PRICES["gpt-4o-mini"][0]), lookup(model, {k: v[1] for k, v in PRICES.items()}, PRICES["gpt-4o-mini"][1])
    return prompt / 1000 * into + completion / 1000 * out
