"""Request and response tables of an outside batch service. Nothing is called
here: requests are written as lines, answers are read as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrec.functions.common import filled, text

ENRICH_SYSTEM = "You extract materials and prices from company pages. Answer with JSON only."
FULL_SYSTEM = "Report what the page says about the company, as JSON. Leave out what it does not say."
# fixed values: the keys that the answer table reads
FULL_KEYS = (
    "name", "website", "street_address", "city", "region", "postal_code", "country", "phones", "emails", "whatsapp", "social_links",
    "opening_hours", "materials", "material_prices", "description",
)
FULL_PROMPT = "Keys: " + ", ".join(FULL_KEYS) + ". Lists where there can be several.\n"


def text_parts(body: Column, chars: int) -> Column:
    """A text in stretches of at most ``chars`` characters; at least one."""
    n = F.greatest(F.lit(1), F.ceil(F.length(body) / chars)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(body, i * chars + 1, F.lit(chars)))


def llm_request_ndjson(pages: DataFrame, kind: str = "full", url: str = "url", body: str = "text", model: str = "gpt-4o-mini", chars: int = 12000, system: str | None = None, prompt: str = FULL_PROMPT) -> DataFrame:
    """(custom_id, value): request lines of pages. ``enrich`` also states the
    materials and prices known so far, where the table has them. A text longer
    than ``chars`` goes in several lines; from the second on their id ends in
    ``#`` and the number of the part."""
    pages = pages.where(filled(url)).select("*", F.posexplode(text_parts(text(body), chars)).alias("_part", "_text"))
    page_text = F.col("_text")
    if kind == "enrich":
        known = {c: text(c) if c in pages.columns else F.lit("") for c in ("materials", "material_prices")}
        user = F.concat(
            F.lit("URL: "), F.col(url), F.lit("\nExisting materials: "), known["materials"], F.lit("\nExisting prices: "), known["material_prices"],
            F.lit("\nTEXT:\n"), page_text)
        system = system or ENRICH_SYSTEM
    else:
        user = F.concat(F.lit(prompt + "Website: "), F.col(url), F.lit("\nTEXT:\n"), page_text)
        system = system or FULL_SYSTEM
    part = F.when(F.col("_part") > 0, F.concat(F.lit("#"), F.col("_part").cast("string"))).otherwise("")
    custom_id = F.concat(F.lit(f"{kind}::"), F.col(url), part)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    line = F.to_json(F.struct(
        custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"),
        F.struct(
            F.lit(model).alias("model"), F.lit(0).alias("temperature"), F.struct(F.lit("json_object").alias("type")).alias("response_format"),
            F.array(message("system", F.lit(system)), message("user", user)).alias("messages")).alias("body")))
    return pages.select(custom_id.alias("custom_id"), line.alias("value"))


RESPONSE = "custom_id string, response struct<body:struct<choices:array<struct<message:struct<content:string>>>>>"


def llm_response_parse(lines: DataFrame, column: str = "value", carry: tuple[str, ...] = ()) -> DataFrame:
    """Answer lines -> (custom_id, kind, key, payload). Unreadable lines go; an
    unreadable payload becomes ``{}``."""
    r = lines.select(*carry, F.from_json(column, RESPONSE).alias("r")).where("r.custom_id is not null")
    content = F.get(F.col("r.response.body.choices"), F.lit(0))["message"]["content"]
    payload = F.when(F.try_parse_json(content).isNotNull(), content).otherwise(F.lit("{}"))
    return r.select(
        *carry, "r.custom_id", F.split_part("r.custom_id", F.lit("::"), F.lit(1)).alias("kind"),
        F.regexp_replace("r.custom_id", r"^.*?::", "").alias("key"), payload.alias("payload"))


def truncated_json_repair(content: Column) -> Column:
    """A cut-off answer ends at its last complete entry and is closed."""
    cut_at = F.length(content) - F.instr(F.reverse(content), "}    ") - 4
    fixed = F.concat(F.substring(content, F.lit(1), cut_at + 5), F.lit("\n  ]\n}"))
    return F.when(F.trim(content).endswith("}"), content).when(F.instr(content, "    }") > 1, fixed).otherwise(content)


def companies_of(content: Column, entry: str = "name string, website string") -> Column:
    """The companies array of a repaired answer; null when it has none."""
    return F.from_json(truncated_json_repair(content), f"companies array<struct<{entry.replace(' string', ':string')}>>")["companies"]
