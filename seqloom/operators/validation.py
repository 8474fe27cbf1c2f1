"""Domain rules of the artifact corpus as one issues table.

Every rule is a condition on a value and a path; rules of one level share one
scan of that level. Validation returns rows (artifact_id, code, path, severity)
and never fails on a record.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the artifact contract.
VERSION = "0.1.0"
DIRECTIONS = ["left_to_right", "right_to_left", "top_to_bottom", "bottom_to_top", "boustrophedon", "mixed", "unknown"]
RIGHTS_STATUSES = ["public_domain", "open_licensed", "permission_granted", "metadata_only", "restricted", "unknown"]
CONDITIONS = ["clear", "worn", "damaged", "broken", "lost", "unreadable"]
UNCERTAINTIES = ["certain", "clear", "uncertain", "ambiguous", "unresolved"]
BASIS = "left_to_right_in_image"
WARNINGS = ["direction_order_conflict", "unknown_site"]

Rule = tuple[str, Column, Column]


def blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")


def outside(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return value.isNull() | (value < low) | (value > high)


def _issues(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row for each rule that a row breaks."""
    made = F.array(*(F.when(broken, F.struct(F.lit(code).alias("code"), path.alias("path"))) for code, path, broken in rules))
    return rows.select("artifact_id", F.explode(F.array_compact(made)).alias("i")).select("artifact_id", "i.code", "i.path")


def _rights(r: str, path: Column) -> list[Rule]:
    at = lambda f: F.concat(path, F.lit(f".{f}"))
    c = lambda f: F.col(f"{r}.{f}")
    return [
        ("required_string", at("status"), blank(c("status"))), ("required_string", at("statement"), blank(c("statement"))),
        ("invalid_rights_status", at("status"), ~blank(c("status")) & ~c("status").isin(RIGHTS_STATUSES)),
        ("invalid_type", at("redistribution"), c("redistribution").isNull()), ("invalid_type", at("derivatives"), c("derivatives").isNull()),
        ("invalid_type", at("license_id"), c("license_id") == ""),
        ("rights_contradiction", at("redistribution"), c("redistribution") & c("status").isin("restricted", "unknown", "metadata_only")),
        ("missing_license", at("license_id"), c("redistribution") & (c("status") == "open_licensed") & c("license_id").isNull()),
    ]


def _repeated(rows: DataFrame, value: str, code: str, order: list[str], unit: list[str] | None = None) -> DataFrame:
    """An issue for each use of a value after its first in its unit; rows have path."""
    own = W.partitionBy(*(unit or []), "artifact_row", value).orderBy(*order)
    marked = rows.filter(F.col(value).isNotNull()).withColumn("__n", F.row_number().over(own))
    return marked.filter("__n > 1").select("artifact_id", F.lit(code).alias("code"), "path")


def validate(artifacts: DataFrame) -> DataFrame:
    """All issues of nested artifacts (schema in sources.artifacts), cross-record ones included."""
    rows = artifacts.withColumn("artifact_row", F.monotonically_increasing_id())
    root = F.lit("$")
    at = lambda f: F.lit(f"$.{f}")
    col = F.col
    top = _issues(rows, [
        ("required_string", at("schema_version"), blank(col("schema_version"))), ("unsupported_schema_version", at("schema_version"), ~blank(col("schema_version")) & (col("schema_version") != VERSION)),
        ("required_string", at("artifact_id"), blank(col("artifact_id"))),
        *(("required_list", at(c), col(c).isNull()) for c in ("source_records", "catalog_crosswalk", "images", "sides")),
        *(("required_mapping", at(c), col(c).isNull()) for c in ("rights", "site", "object", "period")),
        ("missing_provenance", at("source_records"), F.size("source_records") == 0), ("empty_artifact", at("sides"), F.size("sides") == 0),
        ("invalid_site_id", at("site.site_id"), col("site.site_id") == ""), ("invalid_site_name", at("site.name"), col("site.name") == ""),
        ("unknown_site", at("site"), col("site").isNotNull() & col("site.site_id").isNull() & col("site.name").isNull()),
        ("required_string", at("object.object_type"), col("object").isNotNull() & blank(col("object.object_type"))),
        ("invalid_period_certainty", at("period.certainty"), col("period").isNotNull() & outside(col("period.certainty"))),
        ("invalid_duplicate_family", at("duplicate_family_id"), col("duplicate_family_id") == ""),
        *((code, path, col("rights").isNotNull() & broken) for code, path, broken in _rights("rights", F.lit("$.rights"))),
    ])
    del root

    sources = rows.select("artifact_row", "artifact_id", F.posexplode("source_records").alias("k", "s")).withColumn("here", F.concat(F.lit("$.source_records["), "k", F.lit("]")))
    source_rules = _issues(sources, [("invalid_source_record", col("here"), col("s").isNull()), *(("required_string", F.concat(col("here"), F.lit(f".{f}")), col("s").isNotNull() & blank(col(f"s.{f}"))) for f in ("source_record_id", "source_id", "upstream_record_id", "role"))])
    source_twice = _repeated(sources.select("artifact_row", "artifact_id", "k", col("s.source_record_id").alias("v"), F.concat("here", F.lit(".source_record_id")).alias("path")), "v", "duplicate_source_record_id", ["k"])

    catalog = rows.select("artifact_row", "artifact_id", F.posexplode("catalog_crosswalk").alias("k", "c")).withColumn("here", F.concat(F.lit("$.catalog_crosswalk["), "k", F.lit("]")))
    catalog_rules = _issues(catalog, [("invalid_catalog_identifier", col("here"), col("c").isNull()), *(("required_string", F.concat(col("here"), F.lit(f".{f}")), col("c").isNotNull() & blank(col(f"c.{f}"))) for f in ("catalog", "identifier"))])

    images = rows.select("artifact_row", "artifact_id", F.posexplode("images").alias("k", "m")).withColumn("here", F.concat(F.lit("$.images["), "k", F.lit("]")))
    image_rules = _issues(images, [
        ("invalid_image", col("here"), col("m").isNull()), *(("required_string", F.concat(col("here"), F.lit(f".{f}")), col("m").isNotNull() & blank(col(f"m.{f}"))) for f in ("image_id", "source_id")),
        ("invalid_sha256", F.concat(col("here"), F.lit(".image_hash")), col("m").isNotNull() & ~F.coalesce(col("m.image_hash").rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))),
        ("required_mapping", F.concat(col("here"), F.lit(".rights")), col("m").isNotNull() & col("m.rights").isNull()),
        *((code, path, col("m.rights").isNotNull() & broken) for code, path, broken in _rights("m.rights", F.concat(col("here"), F.lit(".rights")))),
    ])
    image_twice = _repeated(images.select("artifact_row", "artifact_id", "k", col("m.image_id").alias("v"), F.concat("here", F.lit(".image_id")).alias("path")), "v", "duplicate_image_id", ["k"])

    known = ["artifact_row", "artifact_id", F.transform(F.coalesce("images", F.array()), lambda m: m["image_id"]).alias("known_images"), F.transform(F.coalesce("source_records", F.array()), lambda s: s["source_record_id"]).alias("known_sources")]
    sides = rows.select(*known, F.posexplode("sides").alias("i", "side")).withColumn("here", F.concat(F.lit("$.sides["), "i", F.lit("]")))
    bad_ids = F.exists("side.image_ids", blank)
    side_rules = _issues(sides, [
        ("invalid_side", col("here"), col("side").isNull()), *(("required_string", F.concat(col("here"), F.lit(f".{f}")), col("side").isNotNull() & blank(col(f"side.{f}"))) for f in ("side_id", "physical_form")),
        *(("required_list", F.concat(col("here"), F.lit(f".{f}")), col("side").isNotNull() & col(f"side.{f}").isNull()) for f in ("image_ids", "lines")), ("invalid_image_ids", F.concat(col("here"), F.lit(".image_ids")), bad_ids),
    ])
    shown = sides.filter(~F.coalesce(bad_ids, F.lit(False))).select("artifact_id", "known_images", "here", F.posexplode("side.image_ids").alias("n", "v"))
    side_images = shown.filter(~F.array_contains("known_images", col("v"))).select("artifact_id", F.lit("unknown_image_reference").alias("code"), F.concat("here", F.lit(".image_ids["), "n", F.lit("]")).alias("path"))
    side_twice = _repeated(sides.select("artifact_row", "artifact_id", "i", col("side.side_id").alias("v"), F.concat("here", F.lit(".side_id")).alias("path")), "v", "duplicate_side_id", ["i"])

    lines = sides.select("artifact_row", "artifact_id", "known_sources", "i", "here", F.posexplode("side.lines").alias("j", "line")).withColumn("here", F.concat("here", F.lit(".lines["), "j", F.lit("]")))
    tokens_of = lambda f: F.filter(F.transform(F.coalesce("line.tokens", F.array()), lambda t: t[f]), lambda x: x.isNotNull() & (x >= 0))
    n, direction = F.size("line.tokens"), col("line.reading_direction")
    visual, reading = tokens_of("visual_index"), tokens_of("reading_index")
    gap = lambda xs: (F.size(xs) == n) & (n > 0) & (F.array_sort(F.array_distinct(xs)) != F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))))
    conflict = (direction == "unknown") & (F.size(reading) > 0)
    line_rules = _issues(lines, [
        ("invalid_line", col("here"), col("line").isNull()), *(("required_string", F.concat(col("here"), F.lit(f".{f}")), col("line").isNotNull() & blank(col(f"line.{f}"))) for f in ("line_id", "reading_direction", "visual_order_basis")),
        ("invalid_reading_direction", F.concat(col("here"), F.lit(".reading_direction")), ~blank(direction) & ~direction.isin(DIRECTIONS)),
        ("invalid_visual_order_basis", F.concat(col("here"), F.lit(".visual_order_basis")), ~blank(col("line.visual_order_basis")) & (col("line.visual_order_basis") != BASIS)),
        ("invalid_direction_confidence", F.concat(col("here"), F.lit(".direction_confidence")), col("line").isNotNull() & outside(col("line.direction_confidence"))),
        ("required_list", F.concat(col("here"), F.lit(".tokens")), col("line").isNotNull() & col("line.tokens").isNull()), ("empty_line", F.concat(col("here"), F.lit(".tokens")), n == 0),
        ("noncontiguous_visual_order", F.concat(col("here"), F.lit(".tokens")), gap(visual)), ("direction_order_conflict", F.concat(col("here"), F.lit(".reading_direction")), conflict),
        ("noncontiguous_reading_order", F.concat(col("here"), F.lit(".tokens")), ~F.coalesce(conflict, F.lit(False)) & gap(reading)),
    ])
    line_twice = _repeated(lines.select("artifact_row", "artifact_id", "i", "j", col("line.line_id").alias("v"), F.concat("here", F.lit(".line_id")).alias("path")), "v", "duplicate_line_id", ["i", "j"])

    tokens = lines.select("artifact_row", "artifact_id", "known_sources", "i", "j", "here", F.posexplode("line.tokens").alias("k", "t")).withColumn("here", F.concat("here", F.lit(".tokens["), "k", F.lit("]")))
    here = lambda f: F.concat(col("here"), F.lit(f".{f}"))
    there = col("t").isNotNull()
    token_rules = _issues(tokens, [
        ("invalid_token", col("here"), ~there), ("required_string", here("token_id"), there & blank(col("t.token_id"))), ("invalid_sign_id", here("sign_id"), col("t.sign_id") == ""),
        ("invalid_visual_index", here("visual_index"), there & (col("t.visual_index").isNull() | (col("t.visual_index") < 0))), ("invalid_reading_index", here("reading_index"), col("t.reading_index") < 0),
        ("invalid_confidence", here("confidence"), there & outside(col("t.confidence"))), ("invalid_token_condition", here("condition"), there & (col("t.condition").isNull() | ~col("t.condition").isin(CONDITIONS))),
        ("required_mapping", here("uncertainty"), there & col("t.uncertainty").isNull()),
        ("invalid_uncertainty_status", here("uncertainty.status"), col("t.uncertainty").isNotNull() & (col("t.uncertainty.status").isNull() | ~col("t.uncertainty.status").isin(UNCERTAINTIES))),
        ("required_list", here("uncertainty.alternatives"), col("t.uncertainty").isNotNull() & col("t.uncertainty.alternatives").isNull()),
        ("invalid_source_record_ids", here("source_record_ids"), there & (col("t.source_record_ids").isNull() | (F.size("t.source_record_ids") == 0) | F.exists("t.source_record_ids", blank))),
    ])
    line_unit = ["i", "j"]
    token_twice = [
        _repeated(tokens.select("artifact_row", "artifact_id", "i", "j", "k", F.when(col(f"t.{f}") >= 0, col(f"t.{f}")).alias("v"), here(f).alias("path")), "v", code, ["k"], line_unit)
        for f, code in (("visual_index", "duplicate_visual_index"), ("reading_index", "duplicate_reading_index"))
    ]
    token_twice.append(_repeated(tokens.select("artifact_row", "artifact_id", "i", "j", "k", col("t.token_id").alias("v"), here("token_id").alias("path")), "v", "duplicate_token_id", ["i", "j", "k"]))
    named = tokens.select("artifact_id", "known_sources", "here", F.posexplode("t.source_record_ids").alias("n", "v"))
    token_sources = named.filter(col("v").isNotNull() & ~F.array_contains("known_sources", col("v"))).select("artifact_id", F.lit("unknown_source_record_reference").alias("code"), F.concat("here", F.lit(".source_record_ids["), "n", F.lit("]")).alias("path"))

    # Cross-record: an id met before, by the order in which rows stand.
    own = W.partitionBy("artifact_id").orderBy("artifact_row")
    artifact_twice = rows.filter("artifact_id IS NOT NULL").select("artifact_id", "artifact_row").withColumn("n", F.row_number().over(own)).filter("n > 1").select("artifact_id", F.lit("duplicate_artifact_id").alias("code"), F.lit("$.artifact_id").alias("path"))

    parts = [top, source_rules, source_twice, catalog_rules, image_rules, image_twice, side_rules, side_images, side_twice, line_rules, line_twice, token_rules, *token_twice, token_sources, artifact_twice]
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("severity", F.when(col("code").isin(WARNINGS), "warning").otherwise("error"))


def has_errors(issues: DataFrame) -> bool:
    return not issues.filter("severity = 'error'").isEmpty()
