"""Form exports of a data-capture system: field metadata and records, made tabular."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinisieve.operators.joins import lookup_join

# Data types and lengths by field type; all other types are text of the usual length.
DATA_TYPES = {"calc": "float", "slider": "integer"}
LENGTHS = {"notes": 4000, "calc": 20}
USUAL_TYPE, USUAL_LENGTH = "string", 200


def _by_type(column: Column, values: dict, usual) -> Column:
    out = F.lit(usual)
    for kind, value in values.items():
        out = F.when(column == kind, F.lit(value)).otherwise(out)
    return out


def form_fields(metadata: DataFrame, form: str) -> DataFrame:
    """Column definitions of a form's fields, or of all fields when no field has that form.

    ``metadata`` has position, field_name, form_name, field_type and field_label.
    """
    own = F.lower(F.coalesce("form_name", F.lit(""))) == form.lower()
    any_own = metadata.agg(F.coalesce(F.bool_or(own), F.lit(False))).scalar()
    kind = F.coalesce("field_type", F.lit("text"))
    name = F.upper("field_name")
    return metadata.filter(own | ~any_own).select(
        "position", F.concat(F.lit(f"IT.{form.upper()}."), name).alias("itemOID"), name.alias("name"),
        _by_type(F.lower(kind), DATA_TYPES, USUAL_TYPE).alias("dataType"),
        F.coalesce("field_label", F.lit("")).alias("label"),
        _by_type(kind, LENGTHS, USUAL_LENGTH).alias("length"))


def all_form_fields(metadata: DataFrame) -> DataFrame:
    """(form, column definitions) of the fields of every form; a field without one belongs to ``UNKNOWN``.

    The fields of all forms at once, as :func:`form_fields` gives them for a form that has fields.
    """
    form = F.upper(F.coalesce("form_name", F.lit("UNKNOWN")))
    kind, name = F.coalesce("field_type", F.lit("text")), F.upper("field_name")
    return metadata.select(
        form.alias("form"), "position", F.concat(F.lit("IT."), form, F.lit("."), name).alias("itemOID"), name.alias("name"),
        _by_type(F.lower(kind), DATA_TYPES, USUAL_TYPE).alias("dataType"), F.coalesce("field_label", F.lit("")).alias("label"),
        _by_type(kind, LENGTHS, USUAL_LENGTH).alias("length"))


def flatten(metadata: DataFrame, records: DataFrame, form: str) -> DataFrame:
    """One row per record with its values as texts in field order; a value not there is empty.

    ``records`` has record_id and the record as a JSON object in ``record``.  The field list of a
    form is small by nature and reaches the tasks as a single value.
    """
    fields = form_fields(metadata, form)
    names = fields.agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "name"))),
                                   lambda f: f["name"])).scalar()
    values = F.from_json("record", "map<string,string>")
    rows = records.select("record_id", values.alias("m"), names.alias("columns"))
    return rows.select("record_id", "columns", F.transform(
        "columns", lambda n: F.coalesce(F.element_at(F.col("m"), F.lower(n)), F.lit(""))).alias("values"))


def forms(metadata: DataFrame) -> DataFrame:
    """The distinct forms, as stand-ins for domains, in order."""
    return metadata.select(F.upper(F.coalesce("form_name", F.lit("UNKNOWN"))).alias("form")).distinct().orderBy("form")


def subjects(records: DataFrame) -> DataFrame:
    return records.select(F.coalesce(F.get_json_object("record", "$.record_id"), F.lit("")).alias("usubjid"),
                          F.lit("").alias("siteid"))


def _field(name: str, default: str = "") -> Column:
    return F.coalesce(F.element_at("m", name), F.lit(default))


def projects(listing: DataFrame) -> DataFrame:
    """Project listings in one shape; a project is active if it says whether it is longitudinal.

    ``listing`` has one project as a JSON object in ``project``.
    """
    m = listing.select(F.from_json("project", "map<string,string>").alias("m"))
    purpose = F.when(F.map_contains_key("m", "purpose_other"), F.element_at("m", "purpose_other")).otherwise(
        _field("purpose"))
    return m.select(
        _field("project_id").alias("study_id"), _field("project_title").alias("title"),
        F.when(F.element_at("m", "is_longitudinal").isNotNull(), "active").otherwise("unknown").alias("status"),
        purpose.alias("purpose"), _field("creation_time").alias("created"))


def _particulars(m: DataFrame, study_id: Column) -> DataFrame:
    return m.select(
        study_id.alias("study_id"), _field("project_title").alias("title"),
        F.concat_ws(" ", _field("project_pi_firstname"), _field("project_pi_lastname")).alias("sponsor"),
        _field("secondary_unique_field").alias("protocol_id"), _field("creation_time").alias("start_date"),
        F.lit("active").alias("status"))


def project_metadata(listing: DataFrame, study_id: str) -> DataFrame:
    """Particulars of one project."""
    m = listing.select(F.from_json("project", "map<string,string>").alias("m")).filter(
        F.element_at("m", "project_id") == study_id)
    return _particulars(m, _field("project_id", study_id))


def projects_metadata(listing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Particulars of all projects that ``wanted`` names by ``study_id``, once each."""
    m = listing.select(F.from_json("project", "map<string,string>").alias("m")).withColumn("_id", F.element_at("m", "project_id"))
    asked = wanted.select(F.col("study_id").alias("_id")).distinct()
    return _particulars(lookup_join(m, asked, ["_id"], "left_semi"), F.col("_id"))
