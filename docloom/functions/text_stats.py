"""Text statistics as column expressions: densities, content classes, counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.sources.tables import WHITE, stripped

# Character sets, norms, weights and thresholds of the density measure.
PUNCTUATION = ".,;:!?()[]{}\"-"
SPECIAL = "$%&*+=<>|~^_\\/#@`"
WORDS = r"[\p{L}\p{N}_]+"
DIGITS = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"
SPACES = r"[\t-\r\x1C-\x20\x85\pZ]"
NORMS = {"token": 0.25, "punctuation": 0.20, "special": 0.15, "numeric": 0.30, "line": 0.10, "whitespace": 0.30}
WEIGHTS = {"special": 0.30, "numeric": 0.25, "line": 0.20, "punctuation": 0.10, "token": 0.10, "whitespace": 0.05}
STRUCTURED = {"special": 0.4, "numeric": 0.5, "line": 0.6}
TECHNICAL = {"special": 0.2, "numeric": 0.3}
MIXED = 0.6


def _per_char(count: Column, text: Column, norm: float) -> Column:
    n = F.length(text)
    return F.when(n > 0, F.least(count / n / F.lit(norm), F.lit(1.0))).otherwise(0.0)


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def token_density(text: Column) -> Column:
    return _per_char(F.regexp_count(text, F.lit(WORDS)), text, NORMS["token"])


def punctuation_density(text: Column) -> Column:
    return _per_char(_count_of(text, PUNCTUATION), text, NORMS["punctuation"])


def special_char_density(text: Column) -> Column:
    return _per_char(_count_of(text, SPECIAL), text, NORMS["special"])


def numeric_density(text: Column) -> Column:
    return _per_char(F.regexp_count(text, F.lit(DIGITS)), text, NORMS["numeric"])


def line_break_density(text: Column) -> Column:
    return _per_char(_count_of(text, "\n"), text, NORMS["line"])


def whitespace_density(text: Column) -> Column:
    """High where there is little white space."""
    n = F.length(text)
    return F.when(n > 0, F.greatest(F.lit(0.0), 1 - _count_of(text, WHITE) / n / F.lit(NORMS["whitespace"]))).otherwise(0.0)


def densities(text: Column) -> dict[str, Column]:
    return {
        "special": special_char_density(text), "numeric": numeric_density(text), "line": line_break_density(text),
        "punctuation": punctuation_density(text), "token": token_density(text), "whitespace": whitespace_density(text),
    }


def _overall(parts: dict[str, Column]) -> Column:
    total = sum((F.lit(w) * parts[k] for k, w in WEIGHTS.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def overall_density(text: Column) -> Column:
    blank = F.coalesce(stripped(text), F.lit("")) == ""
    return F.when(blank, 0.0).otherwise(_overall(densities(text)))


def classify_density(text: Column) -> Column:
    def classified(d: Column) -> Column:
        return (
            F.when((d["special"] > STRUCTURED["special"]) | (d["numeric"] > STRUCTURED["numeric"]) | (d["line"] > STRUCTURED["line"]), "structured")
            .when((d["special"] > TECHNICAL["special"]) | (d["numeric"] > TECHNICAL["numeric"]), "technical")
            .when(_overall({k: d[k] for k in WEIGHTS}) > MIXED, "mixed")
            .otherwise("narrative")
        )

    # a list of one, so that each density is computed once however often it is asked for
    once = F.array(F.struct(*[c.alias(k) for k, c in densities(text).items()]))
    return F.when(F.coalesce(stripped(text), F.lit("")) == "", "empty").otherwise(F.get(F.transform(once, classified), F.lit(0)))


def recommend_chunk_size(density: Column) -> Column:
    return F.greatest(F.lit(500), F.least(F.lit(2000), 2000 - (density * 1500).cast("int")))


def recommend_overlap(size: Column) -> Column:
    return F.greatest(F.lit(50), F.least(F.lit(400), (size * F.lit(0.15)).cast("int")))


# Patterns of headings, list items and columns.
NUMBERED = r"(?i)^([0-9]+\.|[0-9]+\.[0-9]+\.?|[\p{L}\p{N}_]+[\t-\r\x1C-\x20\x85\pZ]+[0-9]+|Chapter[\t-\r\x1C-\x20\x85\pZ]+[0-9]+|Section[\t-\r\x1C-\x20\x85\pZ]+[0-9]+)"
BULLET = r"^[•\-*◦▪][\t-\r\x1C-\x20\x85\pZ]+"
NUMBER_ITEM = r"^[0-9]+[.)][\t-\r\x1C-\x20\x85\pZ]+"
WIDE_GAP = r"[\t-\r\x1C-\x20\x85\pZ]{4,}"


def is_caps(text: Column) -> Column:
    """Over 70 % of the letters are upper case."""
    return F.regexp_count(text, F.lit(r"\p{Lu}")) > F.lit(0.7) * F.regexp_count(text, F.lit(r"\p{L}"))


def header_type(line: Column) -> Column:
    """all_caps or numbered_section for a short stripped line, else null."""
    return F.when(F.length(line) < 100, F.when(is_caps(line), "all_caps").when(line.rlike(NUMBERED), "numbered_section"))


def table_gate(text: Column) -> Column:
    return text.contains("|") | text.contains("\t\t") | text.rlike(WIDE_GAP)


def identify_content_type(text: Column) -> Column:
    bare = stripped(text)
    lines = F.split(text, "\n", -1)
    indented = F.size(F.filter(lines, lambda x: x.startswith("    ") | x.startswith("\t")))
    code = (F.size(lines) > 1) & (indented > F.lit(0.5) * F.size(lines)) & (_count_of(text, "{}[]()<>=;:") > F.lit(0.05) * F.length(text))
    return (
        F.when(bare == "", "paragraph")
        .when(header_type(bare).isNotNull(), "header")
        .when(table_gate(text) & ((_count_of(text, "|") >= 2) | (F.regexp_count(text, F.lit(WIDE_GAP)) >= 2)), "table")
        .when(bare.rlike(BULLET) | bare.rlike(NUMBER_ITEM), "list")
        .when(code, "code")
        .otherwise("paragraph")
    )


def line_kind(line: Column) -> Column:
    """header, table, list or null for a line as it stands."""
    bare = stripped(line)
    return F.when(bare == "", None).when(header_type(bare).isNotNull(), "header").when(table_gate(line), "table").when(bare.rlike(BULLET) | bare.rlike(NUMBER_ITEM), "list")


def chunk_counts(text: Column) -> dict[str, Column]:
    words = F.when(stripped(text) == "", 0).otherwise(F.size(F.split(stripped(text), SPACES + "+")))
    return {"char_count": F.length(text), "word_count": words, "sentence_count": F.regexp_count(text, F.lit(r"[.!?]+"))}


def table_info(text: Column) -> dict[str, Column]:
    lines = F.split(text, "\n", -1)
    pipes = text.contains("|")
    widest = F.array_max(F.transform(lines, lambda x: _count_of(x, "|")))
    return {"rows": F.size(lines), "has_pipes": pipes, "estimated_columns": F.when(pipes, widest + 1)}


def table_shape(html: Column, markdown: Column, text: Column) -> dict[str, Column]:
    """Shape of an extracted table: rows by line feeds, columns by pipes, else tabs, over the lines that aren't empty."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x != "")
    by = lambda c: F.array_max(F.transform(lines, lambda x: _count_of(x, c))) + 1
    columns = F.when(body.contains("|"), by("|")).when(body.contains("\t"), by("\t")).otherwise(0)
    data = F.coalesce(*[F.nullif(c, F.lit("")) for c in (html, markdown, text)], F.lit(""))
    return {"rows": F.when(body == "", 0).otherwise(_count_of(body, "\n") + 1), "columns": columns, "data": data}
