"""ARIA roles of elements against a taxonomy (rows of ``sources.config.aria_roles``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims

SCHEMA = "id string, must_contain array<string>, required array<string>, scope array<string>, supported array<string>, subclass_of array<string>, landmark boolean"


def taxonomy(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[k] for k in ("id", "must_contain", "required", "scope", "supported", "subclass_of", "landmark")) for r in rows], SCHEMA)


def described(elements: DataFrame, roles: DataFrame) -> DataFrame:
    """Elements with a role: whether it is known, a landmark, and its required context, owned elements and properties."""
    role = F.element_at(F.split(F.trim(F.try_element_at("attr", F.lit("role"))), r"\s+"), 1)
    used = elements.withColumn("role", role).where(F.coalesce(F.col("role"), F.lit("")) != "")
    known = roles.select(F.col("id").alias("__role"), "must_contain", "required", "scope", F.col("landmark").alias("landmark_role"))
    out = used.join(known, F.lower("role") == F.lower("__role"), "left")
    return out.withColumn("known", F.col("__role").isNotNull()).withColumn("landmark_role", F.coalesce("landmark_role", F.lit(False))).drop("__role")


def missing_properties(described_: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Required properties that an element with the role hasn't."""
    lacking = F.array_except(F.coalesce("required", F.array().cast("array<string>")), F.map_keys("attr"))
    return described_.select(id_col, "pos", "tag", "role", F.explode(lacking).alias("property"))


def role_class(role: Column) -> Column:
    """abstract, widget, composite, document, landmark or epub; empty for a value that is no role."""
    known = F.create_map(*[F.lit(x) for pair in dims.ROLE_CLASS.items() for x in pair])
    return F.coalesce(known[role], F.lit(""))


def by_landmark(elements: DataFrame) -> DataFrame:
    """Elements of each landmark over all pages."""
    return elements.groupBy("landmark").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


def implicit_roles(tag: Column, attr: Column) -> Column:
    """The roles that an element has by itself: of links only with an address; one where its type chooses, else all that it may have."""
    known = F.create_map(*[x for k, v in dims.IMPLICIT_ROLES.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in v]))])
    chosen = F.lit(None).cast("string")
    for element, kinds in dims.TYPED_ROLES.items():
        by_type = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
        chosen = F.when(tag == element, by_type[F.lower(F.try_element_at(attr, F.lit("type")))]).otherwise(chosen)
    none = F.array().cast("array<string>")
    bare = tag.isin("a", "area", "link") & F.try_element_at(attr, F.lit("href")).isNull()
    return F.when(bare, none).when(chosen.isNotNull(), F.array(chosen)).otherwise(F.coalesce(known[tag], none))


def valid_value(name: Column, value: Column) -> Column:
    """Whether an ARIA attribute has a value of its kind; null for an attribute that isn't known."""
    kind = F.create_map(*[F.lit(x) for pair in dims.ARIA_VALUES.items() for x in pair])[name]
    text = F.lower(F.trim(value))
    return (
        F.when(kind.isNull(), F.lit(None).cast("boolean")).when(kind == "STRING", F.lit(True)).when(kind == "INTEGER", text.rlike(r"^-?\d+$")).when(kind == "NUMBER", text.rlike(r"^-?(\d+\.?\d*|\.\d+)$"))
        .when(kind == "ID", text.rlike(r"^\S+$")).when(kind == "ID LIST", text != "").otherwise(F.array_contains(F.split(kind, " "), text))
    )


def aria_faults(elements: DataFrame, roles: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id, testcase, tag, line_no, column_no and message: ACT-ARIA_attribute_defined, an attribute that is none;
    ACT-ARIA_state_property_valid_value, one with a wrong value; ACT-Role_valid_value, a role that is none;
    ACT-ARIA_state_property_permitted, an attribute that neither is global nor belongs to the role (of the taxonomy ``roles``);
    ACT-Role_has_required_properties, a role without an attribute that it must have. The taxonomy is small and joined by role."""
    attr = F.col("attr")
    role = F.element_at(F.split(F.trim(F.coalesce(F.try_element_at(attr, F.lit("role")), F.lit(""))), r"\s+"), 1)
    known = roles.select(F.col("id").alias("__role"), "required", "supported")
    met = elements.withColumn("role", F.lower(role)).join(F.broadcast(known), F.col("role") == F.lower("__role"), "left")
    none = F.array().cast("array<string>")
    given = F.filter(F.map_entries("attr"), lambda e: e["key"].startswith("aria-"))
    own = F.concat(F.coalesce("required", none), F.coalesce("supported", none))
    say = lambda name, text: F.struct(F.lit(f"ACT-{name}").alias("testcase"), text.alias("message"))
    odd = F.transform(F.filter(given, lambda e: valid_value(e["key"], e["value"]).isNull()), lambda e: say("ARIA_attribute_defined", e["key"]))
    wrong = F.transform(F.filter(given, lambda e: ~F.coalesce(valid_value(e["key"], e["value"]), F.lit(True))), lambda e: say("ARIA_state_property_valid_value", F.concat(e["key"], F.lit("="), e["value"])))
    foreign = F.filter(given, lambda e: F.col("__role").isNotNull() & valid_value(e["key"], e["value"]).isNotNull() & ~e["key"].isin(*dims.ARIA_GLOBAL) & ~F.array_contains(own, e["key"]))
    lacking = F.array_except(F.coalesce("required", none), F.map_keys("attr"))
    empty = F.array().cast("array<struct<testcase:string,message:string>>")
    bad_role = F.when((F.col("role") != "") & (role_class(F.col("role")) == ""), F.array(say("Role_valid_value", F.col("role")))).otherwise(empty)
    every = F.concat(odd, wrong, F.transform(foreign, lambda e: say("ARIA_state_property_permitted", e["key"])), F.transform(lacking, lambda p: say("Role_has_required_properties", p)), bad_role)
    return met.select(id_col, "tag", "line_no", "column_no", F.inline(every)).select(id_col, "testcase", "tag", "line_no", "column_no", "message")
