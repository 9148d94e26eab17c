"""Asset names, file names, slugs and product addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values ------------------------------------------------------------
PRODUCT_PATH = "/watch_model/"
FORBIDDEN_IN_FILE_NAMES = r'[<>:"/\\|?*]'
MAX_FILE_NAME = 200
# ------------------------------------------------------------------------------


def _spaced(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def _tail(parts: Column, start: int) -> Column:
    return F.array_join(F.slice(parts, start, F.greatest(F.size(parts) - (start - 1), F.lit(0))), "-")


def asset_name(name: Column) -> dict[str, Column]:
    """``a-b-c…`` read as brand, id, model; two parts as brand, model."""
    parts = F.split(name, "-")
    n = F.size(parts)
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    unknown = F.lit("unknown")
    brand = F.when(n >= 2, _spaced(first)).otherwise(name)
    model = F.when(n >= 3, _spaced(_tail(parts, 3))).when(n == 2, _spaced(second)).otherwise(unknown)
    ident = F.when(n >= 3, second).otherwise(unknown)
    full = (
        F.when(n >= 3, F.concat(brand, F.lit(" "), model))
        .when(n == 2, F.concat(first, F.lit(" "), second))
        .otherwise(name)
    )
    return {"brand": brand, "id": ident, "model": model, "full_name": full}


def file_name(name: Column) -> dict[str, Column]:
    """``brand-model…-id`` as the writer lays it out: id is the last part."""
    parts = F.split(F.replace(name, F.lit(".csv"), F.lit("")), "-")
    n = F.size(parts)
    middle = F.array_join(F.slice(parts, 2, F.greatest(n - 2, F.lit(0))), "-")
    return {
        "brand": F.get(parts, F.lit(0)),
        "model": F.when(n > 2, middle).otherwise(F.lit("Unknown")),
        "id": F.element_at(parts, -1),
    }


def title_case(text: Column) -> Column:
    """Upper-case every letter that does not follow a letter."""
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("in_word"))

    def step(acc: Column, ch: Column) -> Column:
        cased = F.when(acc["in_word"], F.lower(ch)).otherwise(F.upper(ch))
        return F.struct(
            F.concat(acc["out"], cased).alias("out"),
            ch.rlike(r"\p{L}").alias("in_word"),
        )

    return F.aggregate(F.split(text, ""), start, step, lambda acc: acc["out"])


def product_address(url: Column, path_fragment: str = PRODUCT_PATH) -> dict[str, Column]:
    """Id and name out of ``…<fragment><id>-<brand>-<model>``; else the last segment."""
    is_product = url.contains(path_fragment)
    after = F.get(F.split(url, _literal(path_fragment), 3), F.lit(1))
    slug = F.get(F.split(after, "/"), F.lit(0))
    parts = F.split(slug, "-", 3)
    tail = (
        F.when(F.size(parts) >= 3, F.get(parts, F.lit(2)))
        .when(F.size(parts) == 2, F.get(parts, F.lit(1)))
        .otherwise(F.lit(""))
    )
    fallback = F.element_at(F.split(url, "/"), -1)
    raw = F.when(is_product, tail).otherwise(fallback)
    ident = F.when(is_product, F.get(parts, F.lit(0))).otherwise(F.lit(""))
    return {
        "watch_id": ident,
        "model_id": ident,
        "model_name": title_case(F.replace(raw, F.lit("-"), F.lit(" "))),
    }


def _literal(fragment: str) -> str:
    return "\\Q" + fragment + "\\E"


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1)


def safe_file_name(text: Column, max_length: int = MAX_FILE_NAME) -> Column:
    out = F.regexp_replace(text, FORBIDDEN_IN_FILE_NAMES, "_")
    out = F.regexp_replace(out, r"[\x00-\x1f]", "")
    out = F.trim(F.regexp_replace(out, r"(?U)\s+", " "))
    out = F.trim(F.replace(out, F.lit(" "), F.lit("_")), F.lit("._ "))
    cut = F.when(F.length(out) > max_length, F.rtrim(F.left(out, F.lit(max_length)), F.lit("._"))).otherwise(out)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("unnamed"))


def output_name(brand: Column, model: Column, watch_id: Column, model_id: Column) -> Column:
    ident = F.coalesce(
        F.nullif(watch_id, F.lit("")), F.nullif(model_id, F.lit("")), F.lit("unknown")
    )
    stem = F.concat_ws("-", safe_file_name(brand), safe_file_name(model), ident)
    return F.concat(stem, F.lit(".csv"))


def asset_label(asset: Column, brand: Column) -> Column:
    """Readable label: brand, name words without the brand, reference in brackets."""
    parts = F.filter(F.split(asset, "_"), lambda p: p != "")
    reference = F.element_at(parts, -1)
    core = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    brand_text = F.trim(F.coalesce(brand, F.lit("")))
    tokens = F.transform(F.regexp_extract_all(brand_text, F.lit("([A-Za-z0-9]+)"), F.lit(1)), F.lower)
    trimmed = F.filter(core, lambda p: ~F.array_contains(tokens, F.lower(p)))
    words = F.when((brand_text != "") & (F.size(trimmed) > 0), trimmed).otherwise(core)
    label = F.trim(
        F.concat_ws(" ", F.nullif(brand_text, F.lit("")), F.nullif(F.array_join(words, " "), F.lit("")))
    )
    bracketed = F.when(label == "", reference).otherwise(
        F.concat(label, F.lit(" ("), reference, F.lit(")"))
    )
    full = F.when(F.contains(F.lower(label), F.lower(reference)), label).otherwise(bracketed)
    return F.when(F.size(parts) == 0, asset).otherwise(full)


def backfill_id(
    watch_id: Column, model_name: Column, url: Column, path_fragment: str = PRODUCT_PATH
) -> dict[str, Column]:
    """Missing id from a ``digits - name`` prefix, else from the address."""
    given = F.nullif(watch_id, F.lit(""))
    prefix = F.nullif(F.regexp_extract(F.coalesce(model_name, F.lit("")), r"^([0-9]+) - ", 1), F.lit(""))
    from_url = F.nullif(
        F.regexp_extract(F.coalesce(url, F.lit("")), _literal(path_fragment) + r"([0-9]+)-", 1), F.lit("")
    )
    use_prefix = given.isNull() & prefix.isNotNull()
    return {
        "watch_id": F.coalesce(given, prefix, from_url),
        "model_name": F.when(use_prefix, F.regexp_replace(model_name, r"^[0-9]+ - ", "")).otherwise(model_name),
    }


def base_model_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(__h|_h)\d+$", "")
