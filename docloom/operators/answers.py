"""Answer post-processing: annotations, citations, warnings, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import questions as fq
from docloom.sources.tables import stripped

FENCE = r"(?s)```(?:annotations|json)[\t-\r\x1C-\x20\x85\pZ]*(.*?)[\t-\r\x1C-\x20\x85\pZ]*```"
_ITEM = "struct<pageNumber:string,type:string,textToHighlight:string,imageChunkId:string,bbox:array<double>,explanation:string>"


def parse_annotations(answers: DataFrame) -> DataFrame:
    """Adds cleaned (the text without fences) and items (the annotations of the first fence; none if its JSON is broken)."""
    body = F.regexp_extract("text", FENCE, 1)
    listed = F.from_json(body, f"annotations array<{_ITEM}>")["annotations"]
    plain = F.from_json(body, f"array<{_ITEM}>")
    starts = F.substring(stripped(body), 1, 1)
    items = F.when(starts == "[", plain).when((starts == "{") & F.get_json_object(body, "$.annotations").isNotNull(), listed).when(starts == "{", plain)
    fenced = F.col("text").rlike(FENCE)
    cleaned = F.when(fenced, stripped(F.regexp_replace("text", FENCE, ""))).otherwise(F.col("text"))
    return answers.withColumn("cleaned", cleaned).withColumn("items", F.coalesce(items, F.array().cast(f"array<{_ITEM}>")))


def route_annotations(parsed: DataFrame) -> DataFrame:
    """One row for each annotation: answer_id, annotation_id (place from 0), page_number, kind (image or text), its data, label; others go."""
    rows = parsed.select("answer_id", F.posexplode("items").alias("annotation_id", "a"))
    image = (F.col("a.type") == "circle") & F.col("a.bbox").isNotNull() & F.col("a.imageChunkId").isNotNull()
    kind = F.when(image, "image").when(F.col("a.textToHighlight").isNotNull(), "text")
    page = F.coalesce(F.col("a.pageNumber"), F.lit("1"))
    colour = fq.annotation_colour(F.coalesce(F.col("a.type"), F.lit("highlight")))
    out = rows.select("answer_id", "annotation_id", page.alias("page"), page.try_cast("int").alias("page_number"), kind.alias("kind"), F.col("a.textToHighlight").alias("text_to_highlight"), F.col("a.imageChunkId").alias("image_chunk_id"), F.col("a.explanation").alias("explanation"), colour.alias("colour"))
    return out.where("kind IS NOT NULL").withColumn("label", F.nullif("explanation", F.lit("")))


def annotations_by_page(routed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Annotations grouped by page in order of first place; without text and image the first chunk of the page lends 200 characters."""
    first = lambda c: F.min(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("annotation_id", F.col(c).alias("v"))))["v"]
    grouped = routed.groupBy("answer_id", "page_number").agg(
        F.min("annotation_id").alias("first_place"), F.count("*").alias("n"), first("text_to_highlight").alias("source_text"), first("explanation").alias("explanation"), F.max(F.col("kind") == "image").alias("has_image")
    )
    lent = chunks.groupBy("answer_id", "page_number").agg(F.substring(F.min_by("content", "rank"), 1, 200).alias("lent"))
    both = grouped.join(lent, ["answer_id", "page_number"], "left")
    return both.withColumn("source_text", F.coalesce("source_text", F.when(~F.col("has_image"), F.col("lent")))).drop("lent")


def citations(answers: DataFrame) -> DataFrame:
    """(answer_id, place, page_number) of every [Page n]."""
    found = F.regexp_extract_all("text", F.lit(r"\[Page[\t-\r\x1C-\x20\x85\pZ]+([0-9]+)\]"), 1)
    return answers.select("answer_id", F.posexplode(found).alias("place", "page")).select("answer_id", "place", F.col("page").cast("int").alias("page_number"))


def bad_citations(cited: DataFrame, retrieved: DataFrame) -> DataFrame:
    """A warning for each citation of a page that was not retrieved, repeats included."""
    wrong = cited.join(retrieved.select("answer_id", "page_number").distinct(), ["answer_id", "page_number"], "left_anti")
    return wrong.withColumn("warning", F.format_string("Citation [Page %d] in response does not match available chunks", "page_number"))


def annotation_warnings(routed: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Annotations whose page is no number, or was not retrieved."""
    known = retrieved.select("answer_id", "page_number").distinct().withColumn("known", F.lit(True))
    met = routed.join(known, ["answer_id", "page_number"], "left")
    number = (F.col("annotation_id") + 1).cast("string")
    invalid = F.concat(F.lit("Annotation #"), number, F.lit(" has invalid page number: "), F.col("page"))
    absent = F.concat(F.lit("Annotation #"), number, F.lit(" page number "), F.col("page_number").cast("string"), F.lit(" does not match available chunks"))
    warned = met.withColumn("warning", F.when(F.col("page_number").isNull(), invalid).when(F.col("known").isNull(), absent))
    return warned.where("warning IS NOT NULL").select("answer_id", "annotation_id", "warning")


def uncovered_citations(cited: DataFrame, routed: DataFrame) -> DataFrame:
    """(answer_id, pages): pages cited but not annotated, sorted."""
    left = cited.select("answer_id", "page_number").subtract(routed.select("answer_id", "page_number"))
    return left.groupBy("answer_id").agg(F.array_sort(F.collect_list("page_number")).alias("pages"))


def quality_report(messages: DataFrame) -> DataFrame:
    """Averages by query type and complexity with subtotals."""
    return messages.rollup("query_type", "complexity").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("avg_quality"))


def history(messages: DataFrame, n: int = 10, newest: bool = False) -> DataFrame:
    """The oldest n messages of each conversation, or the newest."""
    order = F.col("turn").desc() if newest else F.col("turn")
    return messages.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(order))).where(F.col("place") <= n)


def history_without(messages: DataFrame, questions: DataFrame, n: int = 10) -> DataFrame:
    """The history without user turns equal to the current question (conv_id, question)."""
    cut = history(messages, n).join(questions, "conv_id")
    return cut.where(~((F.col("role") == "user") & (F.col("text") == F.col("question")))).drop("question")
