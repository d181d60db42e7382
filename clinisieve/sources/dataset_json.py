"""Dataset-JSON documents: structure checks, item groups, rows, and validation.

A document is a row of (``doc_id``, ``text``), read from whole files or from one line each; all
work is per document or per record and nothing is shuffled but in the checks across records.
Objects are read in the order they are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinisieve.findings import COLUMNS, DATASET_JSON, finding_columns, union_findings
from clinisieve.functions.values import clean_sql, literal
from clinisieve.operators.cross import dm_link, link_rule
from clinisieve.operators.domains import DOMAINS, duplicate_subjects
from clinisieve.operators.rules import ROW_INDEX, evaluate
from clinisieve.sources.large_documents import split_large
from clinisieve.sources.scratch import written

# The keys a document may keep its item groups under, and the domains looked for.
ROOTS = ("clinicalData", "referenceData")
GROUPS = "itemGroupData"
DEFAULT_DOMAINS = ("DM", "VS", "AE", "CM")

# Messages about item groups.
NO_ITEMS = "Non-empty 'items' array required."
NO_RECORDS = "'itemData' must be an array."
NO_NAMES = "Could not derive column names."

DOC = "doc_id"
PRESENT = "_columns"
OBJECT = "'map<string,variant>'"
ARRAY = "'array<variant>'"


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One document per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias(DOC), F.col("value").alias("text"))


def read_document_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One document per line, named by its file and position in it."""
    return spark.read.text(path).select(
        F.concat_ws("#", F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias(DOC),
        F.col("value").alias("text"))


def unwrap_envelopes(docs: DataFrame) -> DataFrame:
    """Rewrite documents that hold one group as ``columns`` and ``rows`` into the nested layout.

    The group is named by the last part of its ``itemGroupOID``.  Other documents stay as they are.
    """
    keys = F.json_object_keys("text")
    flat = (F.array_contains(keys, "columns") & F.array_contains(keys, "rows")
            & ~F.array_contains(keys, ROOTS[0]) & ~F.array_contains(keys, ROOTS[1]))
    oid = F.coalesce(F.get_json_object("text", "$.itemGroupOID"), F.lit("IG"))
    quoted = F.regexp_replace(F.to_json(F.struct(oid.alias("k"))), r'^\{"k":|\}$', "")
    name = F.regexp_replace(F.to_json(F.struct(F.element_at(F.split(oid, r"\."), -1).alias("k"))),
                            r'^\{"k":|\}$', "")
    nested = F.concat(
        F.lit(f'{{"{ROOTS[0]}":{{"{GROUPS}":{{'), quoted, F.lit(':{"name":'), name,
        F.lit(',"items":'), F.get_json_object("text", "$.columns"),
        F.lit(',"itemData":'), F.get_json_object("text", "$.rows"), F.lit("}}}}"))
    return docs.withColumn("text", F.when(flat, nested).otherwise(F.col("text")))


def _parsed(docs: DataFrame) -> DataFrame:
    """Add the document's keys, its root key, the root object, and the item groups in order.

    ``keys`` is null unless the document is an object; ``root`` and ``groups`` are null unless
    they are objects.
    """
    # Of a repeated key the last value counts, as JSON readers have it.
    docs.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    opened = docs.select(
        DOC, "text", F.json_object_keys("text").alias("keys"), F.expr("try_parse_json(text)").alias("doc"))
    chain = " ".join(f"WHEN array_contains(keys, '{k}') THEN '{k}'" for k in ROOTS)
    root = " ".join(f"WHEN '{k}' THEN try_variant_get(doc, '$.{k}', {OBJECT})" for k in ROOTS)
    groups = " ".join(f"WHEN '{k}' THEN try_variant_get(doc, '$.{k}.{GROUPS}', {OBJECT})" for k in ROOTS)
    written = " ".join(
        f"WHEN '{k}' THEN json_object_keys(get_json_object(text, '$.{k}.{GROUPS}'))" for k in ROOTS)
    return (opened.withColumn("root_key", F.expr(f"CASE {chain} END"))
            .withColumn("root", F.expr(f"CASE root_key {root} END"))
            .withColumn("groups", F.expr(f"CASE root_key {groups} END"))
            .withColumn("oids", F.expr(
                f"array_distinct(coalesce(CASE WHEN groups IS NOT NULL THEN CASE root_key {written} END END, array()))")))


def _finding(rule_id, severity, field, message, row_index: Column | int = -1, evidence: Column | str = "") -> list[Column]:
    return [F.col(DOC), *finding_columns(
        finding_type=DATASET_JSON, rule_id=rule_id, severity=severity, domain=DATASET_JSON, field=field,
        message=message, row_index=row_index, evidence=evidence)]


def top_level_findings(docs: DataFrame) -> DataFrame:
    """What keeps a document from being read at all, the first such thing only."""
    # Rule, condition, field and message, in the order they are tested.
    checks = [
        ("DJ_001", "keys IS NULL OR doc IS NULL", "'root'", "Dataset-JSON document must be a JSON object."),
        ("DJ_002", "root_key IS NULL", "'clinicalData/referenceData'",
         "Document must have a 'clinicalData' or 'referenceData' key."),
        ("DJ_002b", "root IS NULL", "root_key", None),
        ("DJ_003", f"NOT map_contains_key(root, '{GROUPS}')", f"'{GROUPS}'",
         "Missing 'itemGroupData' in document."),
        ("DJ_004", "groups IS NULL", f"'{GROUPS}'", "itemGroupData must be an object."),
    ]

    def pick(value) -> Column:
        return F.expr("CASE " + " ".join(f"WHEN {c[1]} THEN {value(c)}" for c in checks) + " END")

    found = _parsed(docs).select(
        DOC, pick(lambda c: literal(c[0])).alias("rule"), pick(lambda c: c[2]).alias("fld"),
        pick(lambda c: literal(c[3]) if c[3] else "concat(root_key, ' must be a JSON object.')").alias("msg"))
    return found.filter("rule IS NOT NULL").select(
        *_finding(F.col("rule"), "CRIT", F.col("fld"), F.col("msg")))


def stop_gate(docs: DataFrame) -> DataFrame:
    """The documents without a CRIT finding on their structure, which alone are read further."""
    stopped = top_level_findings(docs).groupBy(DOC).agg(F.bool_or(F.col("severity") == "CRIT").alias("stop"))
    return docs.join(stopped.filter("stop").select(DOC), DOC, "left_anti")


def item_groups(docs: DataFrame) -> DataFrame:
    """The item groups of each document in the order they are written."""
    return _parsed(docs).select(DOC, F.posexplode("oids").alias("position", "oid"))


def _resolved(docs: DataFrame, domains: tuple[str, ...]) -> DataFrame:
    """Per document and domain, the item group that holds it (null when there is none).

    A group with that very name comes first, then one whose key ends in the domain or has it as a
    part.
    """
    wanted = F.explode(F.array(*[F.lit(d) for d in domains])).alias("domain")
    rows = _parsed(docs).select(DOC, "groups", "oids", wanted).withColumn("code", F.upper(F.expr(clean_sql("domain"))))
    exact = "filter(oids, k -> upper(coalesce(try_variant_get(groups[k], '$.name', 'string'), '')) = code)"
    loose = "filter(oids, k -> endswith(upper(k), code) OR contains(upper(k), concat('.', code)))"
    return rows.withColumn("oid", F.expr(f"coalesce(get({exact}, 0), get({loose}, 0))"))


def infer_oids(docs: DataFrame, domains: tuple[str, ...] = DEFAULT_DOMAINS) -> DataFrame:
    return _resolved(docs, domains).select(DOC, "domain", "oid")


def _opened_groups(docs: DataFrame, domains: tuple[str, ...], chunks: DataFrame | None = None) -> DataFrame:
    """Item groups with their column names and records, and the fault that keeps one from use.

    A group of a document that was taken apart has a row for each part of its records; ``first`` is the
    number of a part's first record, ``good`` that of the arrays among those before it.
    """
    names = (
        "transform(filter(transform(items, (it, i) -> named_struct("
        f"'item', try_variant_get(it, '$', {OBJECT}), 'i', i)), x -> x.item IS NOT NULL), x -> coalesce("
        "nullif(try_variant_get(x.item['name'], '$', 'string'), ''), "
        "nullif(try_variant_get(x.item['OID'], '$', 'string'), ''), concat('COL_', x.i)))"
    )
    opened = (
        _resolved(docs, domains)
        .withColumn("grp", F.expr(f"try_variant_get(groups[oid], '$', {OBJECT})"))
        .withColumn("items", F.expr(f"try_variant_get(grp['items'], '$', {ARRAY})"))
        .withColumn("records", F.expr(
            f"CASE WHEN map_contains_key(grp, 'itemData') THEN try_variant_get(grp['itemData'], '$', {ARRAY}) "
            "ELSE array() END"))
        .withColumn("names", F.expr(names))
        .withColumn("fault", F.expr(
            "CASE WHEN oid IS NULL THEN 'DJ_110' WHEN grp IS NULL THEN 'DJ_100' "
            "WHEN items IS NULL OR size(items) = 0 THEN 'DJ_101' WHEN records IS NULL THEN 'DJ_102' "
            "WHEN size(names) = 0 THEN 'DJ_104' END"))
        .select(DOC, "domain", "oid", "oids", "names", "records", "fault", F.lit(0).alias("part"),
                F.lit(0).cast("bigint").alias("first"), F.lit(0).cast("bigint").alias("good"))
    )
    if chunks is None:
        return opened
    # Only documents that were taken apart have chunks, and there a mark is all that an array holds.
    marked = opened.withColumn("mark", F.expr("try_variant_get(get(records, 0), '$', 'string')"))
    found = chunks.select(F.col(DOC).alias("_doc"), F.col("mark").alias("_mark"), *[F.col(c).alias(f"_{c}") for c in ("part", "first", "good", "records")])
    same = (F.col(DOC).cast("string") == F.col("_doc")) & (F.col("mark") == F.col("_mark"))
    joined = marked.join(found, same, "left").join(chunks.select(F.col(DOC).alias("_apart")).distinct(), F.col(DOC).cast("string") == F.col("_apart"), "left")
    return joined.select(
        DOC, "domain", "oid", "oids", "names",
        F.when(F.col("_records").isNotNull(), F.col("_records")).when(F.col("_apart").isNotNull() & F.col("records").isNotNull(), F.expr(
            "filter(records, r -> false)")).otherwise(F.col("records")).alias("records"),
        "fault", *[F.coalesce(f"_{c}", c).alias(c) for c in ("part", "first", "good")])


def opened_groups(docs: DataFrame, domains: tuple[str, ...] = DEFAULT_DOMAINS, chunks: DataFrame | None = None) -> DataFrame:
    """The item groups of the domains as a stored table, so that each document is parsed once.

    ``chunks`` are the records of the documents that :func:`split_large` took apart.
    """
    return written(_opened_groups(docs, domains, chunks))


def group_findings(docs: DataFrame, domains: tuple[str, ...] = DEFAULT_DOMAINS, opened: DataFrame | None = None) -> DataFrame:
    """Domains that cannot be found or read.  ``opened`` is the documents' :func:`opened_groups`, if there."""
    faults = (_opened_groups(docs, domains) if opened is None else opened).filter("fault IS NOT NULL AND part = 0")
    # Field and message of each fault.
    field = F.expr("CASE fault WHEN 'DJ_110' THEN 'domain' WHEN 'DJ_100' THEN 'itemGroupData' "
                   "WHEN 'DJ_102' THEN concat(oid, '.itemData') ELSE concat(oid, '.items') END")
    quote = literal("'")
    message = F.expr(
        f"CASE fault WHEN 'DJ_110' THEN concat('Could not infer OID for domain ', {quote}, domain, {quote}, '.') "
        f"WHEN 'DJ_100' THEN concat('OID ', {quote}, oid, {quote}, ' not found.') "
        f"WHEN 'DJ_101' THEN {literal(NO_ITEMS)} WHEN 'DJ_102' THEN {literal(NO_RECORDS)} "
        f"ELSE {literal(NO_NAMES)} END")
    keys = F.when(F.col("fault") == "DJ_110", F.array_join("oids", "; ")).otherwise("")
    return faults.select(*_finding(F.col("fault"), "CRIT", field, message, evidence=keys))


def _records(docs: DataFrame, domains: tuple[str, ...], opened: DataFrame | None) -> DataFrame:
    groups = (_opened_groups(docs, domains) if opened is None else opened).filter("fault IS NULL")
    rows = groups.select(DOC, "domain", "oid", "names", "first", F.posexplode("records").alias("_place", "record"))
    return rows.withColumn(ROW_INDEX, F.col("first") + F.col("_place")).withColumn(
        "cells", F.expr(f"try_variant_get(record, '$', {ARRAY})")).drop("record", "first", "_place")


def record_findings(docs: DataFrame, domains: tuple[str, ...] = DEFAULT_DOMAINS, opened: DataFrame | None = None) -> DataFrame:
    """Records that are no arrays, or not as long as there are columns."""
    bad = _records(docs, domains, opened).filter("cells IS NULL OR size(cells) <> size(names)")
    field = F.concat(F.col("oid"), F.lit(".itemData["), F.col(ROW_INDEX).cast("string"), F.lit("]"))
    no_array = F.col("cells").isNull()
    lengths = F.concat(F.lit("got "), F.size("cells").cast("string"), F.lit(", expected "),
                       F.size("names").cast("string"))
    return bad.select(*_finding(
        F.when(no_array, "DJ_105").otherwise("DJ_106"), "HIGH", field,
        F.when(no_array, "Each record must be an array.").otherwise("Record length mismatch."),
        row_index=F.col(ROW_INDEX).cast("bigint"), evidence=F.when(no_array, "").otherwise(lengths)))


def rows(docs: DataFrame, domains: tuple[str, ...] = DEFAULT_DOMAINS, opened: DataFrame | None = None) -> DataFrame:
    """The records as texts under their column names, padded with nulls or cut to fit.

    A record that is no array is left out; the others are numbered without it.
    """
    cells = F.expr("transform(names, (n, i) -> try_variant_get(get(cells, i), '$', 'string'))")
    good = (_opened_groups(docs, domains) if opened is None else opened).filter("fault IS NULL").withColumn("records", F.expr(
        f"filter(transform(records, r -> try_variant_get(r, '$', {ARRAY})), c -> c IS NOT NULL)"))
    return good.select(DOC, "domain", "oid", "names", "good", F.posexplode("records").alias("_place", "cells")).select(
        DOC, "domain", "oid", (F.col("good") + F.col("_place")).alias(ROW_INDEX),
        F.col("names").alias(PRESENT), cells.alias("values"))


def known_columns(code: str) -> list[str]:
    """The columns that a domain's rules read."""
    read = [*DOMAINS[code].required, *(c for r in DOMAINS[code].rules() for c in (*r.requires, *r.absent))]
    return list(dict.fromkeys(read))


def domain_table(records: DataFrame, code: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of one domain as a table; a column that a document lacks is null there."""
    own = records.filter(F.col("domain") == code)
    return own.select(DOC, ROW_INDEX, PRESENT, *[
        F.expr(f"CASE WHEN array_contains({PRESENT}, {literal(c)}) "
               f"THEN values[array_position({PRESENT}, {literal(c)}) - 1] END").alias(c)
        for c in (columns or known_columns(code))])


def _document_finding(df: DataFrame, **columns) -> DataFrame:
    """One finding per document that has rows in ``df``."""
    return df.select(DOC, PRESENT).distinct().select(DOC, *finding_columns(**columns))


def _domain_findings(table: DataFrame, code: str) -> list[DataFrame]:
    domain = DOMAINS[code]
    missing = F.array_except(F.array(*[F.lit(c) for c in domain.required]), F.col(PRESENT))
    listed = F.concat(F.lit("['"), F.array_join(missing, "', '"), F.lit("']"))
    lacking = _document_finding(
        table.filter(F.size(missing) > 0), finding_type="SDTM_RULE", rule_id=f"SDTM_{code}_000", severity="CRIT",
        domain=code, field=F.array_join(missing, ","),
        message=F.concat(F.lit(f"Missing required columns for {code}: "), listed))
    usable = table.filter(F.size(missing) == 0)
    parts = [lacking, evaluate(usable, domain.rules(), domain=code, scope=(DOC,), present=PRESENT)]
    if code == "DM":
        parts.append(duplicate_subjects(usable, (DOC,)))
    for rule_id, column in domain.note_missing:
        parts.append(_document_finding(
            usable.filter(~F.array_contains(PRESENT, column)), finding_type="SDTM_RULE", rule_id=rule_id,
            severity="LOW", domain=code, field=column,
            message=f"Column {column} not present; unit consistency checks skipped."))
    return parts


def _link_findings(dm: DataFrame, other: DataFrame, code: str) -> list[DataFrame]:
    has_key = F.array_contains(PRESENT, "USUBJID")
    both = other.join(dm.select(DOC, has_key.alias("_dm_key")).distinct(), DOC)
    gap = _document_finding(
        both.filter(~(has_key & F.col("_dm_key"))), finding_type="CROSS_DOMAIN",
        rule_id=link_rule(code).rule_id.replace("_001", "_000"), severity="CRIT", domain="CROSS", field="USUBJID",
        message=f"Missing USUBJID for DM/{code} link check.")
    return [gap, dm_link(dm.filter(has_key), other.filter(has_key), code, (DOC,))]


def validate_documents(docs: DataFrame, domains: tuple[str, ...] = DEFAULT_DOMAINS) -> DataFrame:
    """Structure, row-rule and link findings of every document, each document on its own.

    Both layouts are accepted.  The documents in one layout, their item groups, and the groups' records are
    each worked out once and written; all rules read those tables.  A large document is taken apart first, and its records
    are worked on by many tasks.
    """
    docs, chunks = split_large(written(unwrap_envelopes(docs)))
    opened = opened_groups(docs, domains, chunks)
    parts = [top_level_findings(docs), group_findings(docs, domains, opened), record_findings(docs, domains, opened)]
    records = written(rows(docs, domains, opened))
    tables = {code: domain_table(records, code) for code in domains if code in DEFAULT_DOMAINS}
    for code, table in tables.items():
        parts += _domain_findings(table, code)
    if "DM" in tables:
        for code, table in tables.items():
            if code != "DM":
                parts += _link_findings(tables["DM"], table, code)
    return union_findings([p.select(DOC, *COLUMNS) for p in parts])
