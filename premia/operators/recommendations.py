"""Model replies to typed recommendations, and those to long tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from premia.functions.text import strip_json_fence
from premia.session import materialize
from premia.settings import CONFIDENCE_LEVELS, JSON_ATTEMPTS

# --- fixed values: the shape of a recommendation ------------------------------
RECOMMENDATION_FIELDS = (
    "action: string, confidence: string, confidence_rationale: string, "
    "document_evidence: array<struct<text: string, source: string, page: int, "
    "relevance: string>>, "
    "sql_evidence: array<struct<sql: string, key_finding: string, row_summary: string>>, "
    "conflicts: array<string>, reasoning_steps: array<string>, uncertainty_sources: array<string>"
)
RECOMMENDATION_TYPE = f"struct<{RECOMMENDATION_FIELDS}>"


def _text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def _list(value: Column, path: str) -> Column:
    """A list as it is; any other value as a list of one, so that ``"none"`` is not lost; null stays null."""
    single = F.try_variant_get(value, path, "variant")
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"),
                      F.when(single.isNotNull() & ~F.is_variant_null(single), F.array(single)))


def _recommendation(value: Column) -> Column:
    """The typed recommendation of a JSON object; a field that cannot be read is null, the others stay."""

    def entries(path: str, whole: tuple[str, ...] = (), **kinds: str) -> Column:
        return F.transform(_list(value, path), lambda x: F.struct(*[
            F.coalesce(F.try_variant_get(x, f"$.{name}", kind),
                       F.try_variant_get(x, "$", "string") if name in whole else F.lit(None).cast(kind)).alias(name)
            for name, kind in kinds.items()]))

    return F.struct(
        _text(value, "$.action").alias("action"),
        F.lower(F.trim(_text(value, "$.confidence"))).alias("confidence"),
        _text(value, "$.confidence_rationale").alias("confidence_rationale"),
        entries("$.document_evidence", ("text",), text="string", source="string", page="int", relevance="string")
        .alias("document_evidence"),
        entries("$.sql_evidence", ("key_finding",), sql="string", key_finding="string", row_summary="string").alias("sql_evidence"),
        *[F.transform(_list(value, f"$.{name}"), lambda x: F.try_variant_get(x, "$", "string")).alias(name)
          for name in ("conflicts", "reasoning_steps", "uncertainty_sources")],
    ).cast(RECOMMENDATION_TYPE)


def parse_recommendations(replies: DataFrame, reply: str = "raw_model_output") -> DataFrame:
    """Add recommendation and problem; exactly one of them is null.

    The reply is read as JSON as it stands, then without its code fence. Only what is no JSON object is
    ``invalid_json``; fields are read one by one, so a page in quotes is a number, a single conflict is a list of
    one, and ``High`` is a confidence. Rows that lack an action or have an unknown confidence stay, with their problem.
    """
    plain = F.when(F.trim(F.col(reply)).startswith("{"), F.try_parse_json(F.col(reply)))
    parsed = replies.withColumn("_json", F.coalesce(plain, F.try_parse_json(strip_json_fence(F.col(reply)))))
    is_object = F.coalesce(F.schema_of_variant("_json").startswith("OBJECT"), F.lit(False))
    parsed = parsed.withColumn("_parsed", F.when(is_object, _recommendation(F.col("_json"))))
    problem = (
        F.when(F.col("_parsed").isNull(), "invalid_json")
        .when(F.col("_parsed.action").isNull(), "missing_action")
        .when(F.col("_parsed.confidence").isNull()
              | ~F.col("_parsed.confidence").isin(*CONFIDENCE_LEVELS), "unknown_confidence")
    )
    return (
        parsed.withColumn("problem", problem)
        .withColumn("recommendation", F.when(F.col("problem").isNull(), F.col("_parsed")))
        .drop("_json", "_parsed")
    )


def generate_recommendations(prompts: DataFrame, generate: Callable[[Column], Column],
                             attempts: int = 1 + JSON_ATTEMPTS) -> DataFrame:
    """Ask a model (a column function from prompt to text) and parse its replies.

    Replies that are no JSON are asked for again, with a stricter prompt; what still fails after
    the last attempt stays with its problem. Each round's replies are written to the shared
    folder, so a lost executor or a second use of the result never calls the model again.
    ``raw_model_output`` is the first reply.
    """
    settled = []
    pending = prompts.withColumn("_ask", F.col("prompt"))
    for attempt in range(attempts):
        asked = pending.withColumn("_reply", generate(F.col("_ask")))
        if attempt == 0:
            asked = asked.withColumn("raw_model_output", F.col("_reply"))
        answered = materialize(parse_recommendations(asked, "_reply"), "replies")
        again = F.coalesce(F.col("problem") == "invalid_json", F.lit(False))
        if attempt == attempts - 1:
            settled.append(answered)
            break
        settled.append(answered.filter(~again))
        pending = answered.filter(again).drop("problem", "recommendation", "_reply").withColumn(
            "_ask", F.concat("prompt", F.lit(
                "\nThe reply must be valid JSON and nothing else, without code fences.")))
        if pending.isEmpty():
            break
    result = settled[0]
    for part in settled[1:]:
        result = result.unionByName(part)
    return result.drop("_ask", "_reply")


def explode_recommendations(recommendations: DataFrame, key: str) -> DataFrame:
    """(key, section, position, item, detail): every list of a recommendation, one row per item."""
    rec = F.col("recommendation")

    def entries(section: str, items, item, detail):
        return F.transform(
            F.coalesce(items, F.array().cast(items_type(section))),
            lambda x, i: F.struct(F.lit(section).alias("section"), i.alias("position"),
                                  item(x).alias("item"), detail(x).alias("detail")))

    def items_type(section: str) -> str:
        return {
            "document_evidence":
                "array<struct<text: string, source: string, page: int, relevance: string>>",
            "sql_evidence": "array<struct<sql: string, key_finding: string, row_summary: string>>",
        }.get(section, "array<string>")

    nothing = F.lit(None).cast("string")
    lists = [
        entries("document_evidence", rec["document_evidence"], lambda x: x["text"],
                lambda x: F.concat_ws(
                    " | ", F.concat(x["source"], F.lit(", p."), x["page"].cast("string")),
                    x["relevance"])),
        entries("sql_evidence", rec["sql_evidence"], lambda x: x["sql"],
                lambda x: F.concat_ws(" | ", x["key_finding"], x["row_summary"])),
        *[entries(s, rec[s], lambda x: x, lambda x: nothing)
          for s in ("conflicts", "reasoning_steps", "uncertainty_sources")],
    ]
    return recommendations.select(
        key, F.explode(F.concat(*lists)).alias("_entry")).select(key, "_entry.*")
