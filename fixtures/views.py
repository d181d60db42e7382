"""Study tables derived from the given test tables, as SQL that Spark and DuckDB both run.

Violations are planted by modulus, together with values that only look like violations.
Every view has all rows of its source; subjects without rows of a domain are planted by their identifier.
Domains whose source has a unique key carry it as ``row_id``; the others have no row position.
"""

# The study (0 to 2) of each row when the tables are one job's: a subject's rows are spread over studies, study 2 has
# no vital signs, and no disposition events either.
STUDY_OF = {n: "row_id % 3" for n in ("dm", "ae", "cm", "ex", "pr", "qs", "rs")} | {
    "ds": "CASE WHEN DSCAT = 'DISPOSITION EVENT' THEN row_id % 2 ELSE row_id % 3 END",
    "vs": "(length(coalesce(VSORRES, '')) + length(coalesce(VSDTC, '')) + length(coalesce(USUBJID, ''))) % 2",
    "lb": "(length(coalesce(LBORRES, '')) + length(coalesce(USUBJID, ''))) % 3",
    "eg": "(length(coalesce(EGORRES, '')) + length(coalesce(EGTESTCD, '')) + length(coalesce(USUBJID, ''))) % 3",
}

DOMAIN_VIEWS = {
    "dm": """
SELECT c_custkey AS row_id, 'ST' || CAST(c_custkey % 3 AS STRING) AS STUDYID,
 CASE WHEN c_custkey % 113 = 5 THEN '' WHEN c_custkey % 127 = 7 THEN NULL WHEN c_custkey % 89 = 3 THEN 'S' || CAST(c_custkey - 1 AS STRING) ELSE 'S' || CAST(c_custkey AS STRING) END AS USUBJID,
 CASE c_custkey % 11 WHEN 0 THEN 'X' WHEN 1 THEN NULL WHEN 2 THEN ' M ' WHEN 3 THEN 'F' ELSE 'M' END AS SEX,
 CASE c_custkey % 50 WHEN 7 THEN '150' WHEN 8 THEN '-3' WHEN 9 THEN 'abc' WHEN 10 THEN NULL ELSE CAST(15 + c_custkey % 70 AS STRING) END AS AGE,
 CASE c_custkey % 13 WHEN 0 THEN 'YRS' WHEN 1 THEN NULL ELSE 'YEARS' END AS AGEU,
 CASE WHEN c_custkey % 61 = 0 THEN '1995/01/01' WHEN c_custkey % 67 = 1 THEN '1996-02' WHEN c_custkey % 53 = 2 THEN '1995-3-7' ELSE CAST(DATE '1995-01-01' + CAST(c_custkey % 300 AS INT) AS STRING) END AS RFSTDTC,
 CASE WHEN c_custkey % 71 = 0 THEN '1994-06-01' WHEN c_custkey % 73 = 1 THEN 'bad' ELSE CAST(DATE '2000-01-01' + CAST(c_custkey % 300 AS INT) AS STRING) END AS RFENDTC FROM customer
""",
    "ae": """
SELECT o_orderkey AS row_id,
 CASE WHEN o_orderkey % 211 = 0 THEN 'Z' || CAST(o_orderkey AS STRING) WHEN o_orderkey % 223 = 0 THEN '' ELSE 'S' || CAST(o_custkey AS STRING) END AS USUBJID,
 CASE WHEN o_orderkey % 97 = 0 THEN ' ' WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_orderpriority END AS AETERM,
 CASE WHEN o_orderkey % 83 = 0 THEN 'UNK' WHEN o_orderkey % 79 = 0 THEN '1999-05' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS AESTDTC,
 CASE WHEN o_orderkey % 59 = 0 THEN '31/12/1999' WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 61 - 3 AS INT) AS STRING) END AS AEENDTC,
 CASE WHEN o_orderkey % 40 = 0 THEN 'Y ' WHEN o_orderstatus = 'F' THEN 'Y' ELSE 'N' END AS AESER,
 CASE o_orderstatus WHEN 'F' THEN 'MILD' WHEN 'O' THEN 'SEVERE' ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'GRADE 3' ELSE 'MODERATE' END END AS AESEV
 FROM orders
""",
    "cm": """
SELECT o_orderkey AS row_id,
 CASE WHEN o_orderkey % 211 = 1 THEN 'Z' || CAST(o_orderkey AS STRING) WHEN o_orderkey % 223 = 1 THEN '' ELSE 'S' || CAST(o_custkey AS STRING) END AS USUBJID,
 CASE WHEN o_orderkey % 97 = 1 THEN ' ' WHEN o_orderkey % 101 = 1 THEN NULL ELSE o_orderpriority END AS CMTRT,
 CASE WHEN o_orderkey % 83 = 1 THEN 'UNK' WHEN o_orderkey % 79 = 1 THEN '1999-05' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS CMSTDTC,
 CASE WHEN o_orderkey % 59 = 1 THEN '31/12/1999' WHEN o_orderkey % 7 = 1 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 61 - 3 AS INT) AS STRING) END AS CMENDTC
 FROM orders
""",
    "ex": """
SELECT o_orderkey AS row_id,
 CASE WHEN o_orderkey % 211 = 2 THEN 'Z' || CAST(o_orderkey AS STRING) WHEN o_orderkey % 223 = 2 THEN '' ELSE 'S' || CAST(o_custkey AS STRING) END AS USUBJID,
 CASE WHEN o_orderkey % 97 = 2 THEN ' ' WHEN o_orderkey % 101 = 2 THEN NULL ELSE o_orderpriority END AS EXTRT,
 CASE WHEN o_orderkey % 83 = 2 THEN 'UNK' WHEN o_orderkey % 79 = 2 THEN '1999-05' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS EXSTDTC,
 CASE WHEN o_orderkey % 59 = 2 THEN '31/12/1999' WHEN o_orderkey % 7 = 2 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 61 - 3 AS INT) AS STRING) END AS EXENDTC,
 CASE WHEN o_orderkey % 37 = 2 THEN 'high' WHEN o_orderkey % 41 = 2 THEN '-5' WHEN o_orderkey % 6 = 2 THEN '0' ELSE CAST(50 + o_orderkey % 100 AS STRING) END AS EXDOSE,
 CASE WHEN o_orderkey % 29 = 2 THEN 'MG' WHEN o_orderkey % 31 = 2 THEN NULL ELSE 'mg' END AS EXDOSU,
 CASE WHEN o_orderkey % 23 = 2 THEN 'NASAL' ELSE ' ORAL' END AS EXROUTE
 FROM orders
""",
    "pr": """
SELECT o_orderkey AS row_id,
 CASE WHEN o_orderkey % 211 = 3 THEN 'Z' || CAST(o_orderkey AS STRING) WHEN o_orderkey % 223 = 3 THEN '' ELSE 'S' || CAST(o_custkey AS STRING) END AS USUBJID,
 CASE WHEN o_orderkey % 97 = 3 THEN ' ' WHEN o_orderkey % 101 = 3 THEN NULL ELSE o_orderpriority END AS PRTRT,
 CASE WHEN o_orderkey % 83 = 3 THEN 'UNK' WHEN o_orderkey % 79 = 3 THEN '1999-05' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS PRSTDTC,
 CASE WHEN o_orderkey % 59 = 3 THEN '31/12/1999' WHEN o_orderkey % 7 = 3 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 61 - 3 AS INT) AS STRING) END AS PRENDTC,
 CASE WHEN o_orderkey % 19 = 3 THEN 'REHABILITATION' WHEN o_orderkey % 17 = 3 THEN NULL ELSE 'SURGICAL' END AS PRCAT
 FROM orders
""",
    "ds": """
SELECT c_custkey AS row_id,
 CASE WHEN c_custkey % 103 = 4 THEN NULL WHEN c_custkey % 109 = 4 THEN 'Z' || CAST(c_custkey AS STRING) ELSE 'S' || CAST(c_custkey - c_custkey % 2 AS STRING) END AS USUBJID,
 CASE WHEN c_custkey % 43 = 4 THEN '' WHEN c_mktsegment = 'BUILDING' THEN 'SUBJECT DECISION' ELSE 'COMPLETED' END AS DSDECOD,
 CASE WHEN c_custkey % 47 = 4 THEN 'nan' ELSE 'Completed' END AS DSTERM,
 CASE WHEN c_custkey % 37 = 4 THEN 'ENROLLMENT' WHEN c_custkey % 3 = 1 THEN 'PROTOCOL MILESTONE' ELSE 'DISPOSITION EVENT' END AS DSCAT,
 CASE WHEN c_custkey % 41 = 4 THEN '2000-13-01' ELSE CAST(DATE '1999-01-01' + CAST(c_custkey % 500 AS INT) AS STRING) END AS DSSTDTC FROM customer
""",
    "vs": """
SELECT CASE WHEN l_partkey % 131 = 6 THEN '' WHEN l_partkey % 137 = 6 THEN 'Z' || CAST(l_partkey AS STRING) ELSE 'S' || CAST(CASE WHEN o_custkey % 19 = 5 THEN o_custkey + 1 ELSE o_custkey END AS STRING) END AS USUBJID,
 CASE l_linenumber WHEN 1 THEN 'SYSBP' WHEN 2 THEN 'DIABP' WHEN 3 THEN 'PULSE' WHEN 4 THEN 'TEMP' WHEN 5 THEN 'WEIGHT' WHEN 6 THEN 'HEIGHT' ELSE CASE WHEN l_partkey % 9 = 0 THEN 'BMI' ELSE 'RESP' END END AS VSTESTCD, CASE WHEN l_partkey % 139 = 6 THEN 'high' WHEN l_partkey % 10 = 6 THEN CAST(CAST(l_quantity AS INT) + 90 AS STRING) || ',5' ELSE CAST(CAST(l_quantity AS INT) + 90 AS STRING) END AS VSORRES,
 CASE WHEN l_partkey % 15 = 6 THEN 'sec' WHEN l_linenumber IN (1,2) THEN 'mmHg' WHEN l_linenumber IN (3,7) THEN 'bpm' WHEN l_linenumber = 4 THEN 'C' WHEN l_linenumber = 5 THEN 'kg' ELSE 'cm' END AS VSORRESU,
 CASE WHEN l_partkey % 149 = 6 THEN 'UNK' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS VSDTC
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""",
    "lb": """
SELECT CASE WHEN l_partkey % 131 = 6 THEN '' WHEN l_partkey % 137 = 6 THEN 'Z' || CAST(l_partkey AS STRING) ELSE 'S' || CAST(o_custkey AS STRING) END AS USUBJID,
 CASE l_linenumber WHEN 1 THEN 'ALT' WHEN 2 THEN 'AST' WHEN 3 THEN 'NA' WHEN 4 THEN 'K' WHEN 5 THEN 'GLUCOSE' ELSE 'ALT' END AS LBTESTCD, CASE WHEN l_partkey % 151 = 6 THEN NULL ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS LBORRES,
 CASE WHEN l_partkey % 157 = 6 THEN '1d' WHEN l_partkey % 10 = 6 THEN NULL ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS LBSTRESN,
 CASE l_returnflag WHEN 'A' THEN 'HIGH' WHEN 'N' THEN 'NORMAL' ELSE CASE WHEN l_partkey % 8 = 0 THEN 'ELEVATED' ELSE 'LOW' END END AS LBNRIND,
 CASE WHEN l_partkey % 149 = 6 THEN 'UNK' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS LBDTC
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""",
    "eg": """
SELECT CASE WHEN l_partkey % 131 = 6 THEN '' WHEN l_partkey % 137 = 6 THEN 'Z' || CAST(l_partkey AS STRING) ELSE 'S' || CAST(o_custkey AS STRING) END AS USUBJID,
 CASE l_linenumber WHEN 1 THEN 'QTCF' WHEN 2 THEN 'QT' WHEN 3 THEN 'HR' WHEN 4 THEN 'PR' ELSE CASE WHEN l_partkey % 9 = 0 THEN 'PACE' ELSE 'QRS' END END AS EGTESTCD, CASE WHEN l_partkey % 139 = 6 THEN 'ABNORMAL' ELSE CAST(380 + CAST(l_quantity AS INT) AS STRING) END AS EGORRES,
 CASE WHEN l_partkey % 15 = 6 THEN 'sec' WHEN l_linenumber = 3 THEN 'bpm' ELSE 'msec' END AS EGORRESU,
 CASE WHEN l_partkey % 149 = 6 THEN 'UNK' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS EGDTC
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""",
    "qs": """
SELECT event_id AS row_id,
 CASE WHEN event_id % 107 = 1 THEN NULL WHEN event_id % 163 = 1 THEN 'Z' || CAST(event_id AS STRING) ELSE 'S' || CAST(user_id AS STRING) END AS USUBJID, CASE WHEN event_id % 191 = 1 THEN '' ELSE 'PAIN SCALE' END AS QSCAT, CASE WHEN event_id % 193 = 1 THEN 'n/v' ELSE CAST(event_id % 5 AS STRING) END AS QSSTRESN,
 CASE WHEN event_id % 167 = 1 THEN NULL ELSE event_type END AS QSTESTCD,
 CASE WHEN event_id % 23 = 1 THEN NULL ELSE CAST(event_id % 5 AS STRING) END AS QSORRES,
 CASE WHEN event_id % 46 = 1 THEN 'NOT DONE' WHEN event_id % 173 = 1 THEN 'DONE' ELSE NULL END AS QSSTAT,
 CASE WHEN event_id % 92 = 1 THEN 'refused' ELSE NULL END AS QSREASND,
 CASE WHEN event_id % 179 = 1 THEN '04/25/2024' ELSE CAST(CAST(ts AS DATE) AS STRING) END AS QSDTC FROM events
""",
    "rs": """
SELECT event_id AS row_id,
 CASE WHEN event_id % 107 = 1 THEN NULL WHEN event_id % 163 = 1 THEN 'Z' || CAST(event_id AS STRING) ELSE 'S' || CAST(user_id AS STRING) END AS USUBJID, CASE WHEN event_id % 10 = 1 THEN 'SITE RADIOLOGIST' ELSE 'INVESTIGATOR' END AS RSEVAL,
 CASE WHEN event_id % 167 = 1 THEN NULL ELSE event_type END AS RSTESTCD,
 CASE WHEN event_id % 23 = 1 THEN NULL ELSE CASE event_id % 7 WHEN 0 THEN 'MIXED' WHEN 1 THEN 'CR' WHEN 2 THEN 'PR' ELSE 'SD' END END AS RSORRES,
 CASE WHEN event_id % 46 = 1 THEN 'NOT DONE' WHEN event_id % 173 = 1 THEN 'DONE' ELSE NULL END AS RSSTAT,
 CASE WHEN event_id % 92 = 1 THEN 'refused' ELSE NULL END AS RSREASND,
 CASE WHEN event_id % 179 = 1 THEN '04/25/2024' ELSE CAST(CAST(ts AS DATE) AS STRING) END AS RSDTC FROM events
""",
}
