"""Banking screens derived from the customer and order tables.

The supplied texts hold almost none of the identifiers the audit looks for, so
one screen per customer is derived from thirteen templates, and one block layout
per customer.  The text expression is plain SQL that other engines can run too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.sources.screens import EPOCH_2024, SCREEN_COLUMNS, read_screens, spread

# Lines per template; NULL lines are left out.  Columns: k (customer key), nine/six/five/four
# (its last digits), money (balance), odd (every second round), clean (every seventh
# customer), d1 d2 (first and last order date), o1 o2 (first and last order key, 12 digits).
TEMPLATE_LINES = [
    ["'KYC verification'", "'Verify identity'", "CASE WHEN odd THEN 'Aadhaar Number' ELSE 'UID' END",
     "CASE WHEN odd THEN concat('7001002', five) ELSE concat('7001 002', substr(five, 1, 1), ' ', substr(five, 2, 4)) END",
     "concat('PAN ABCDE', four, 'F')", "concat('Passport A12 3', four)", "'Gender and nationality'",
     "CASE WHEN clean THEN 'I agree to the consent notice' END",
     "CASE WHEN clean THEN 'Raise concern with the DPO' END"],
    ["'Dashboard'", "CASE WHEN NOT clean THEN concat('Available Balance Rs ', money) END",
     "CASE WHEN NOT clean THEN concat('Account No 041', nine) END",
     "CASE WHEN NOT clean THEN concat('Mobile +91 9', nine) END",
     "CASE WHEN NOT clean THEN concat('Email cust', k, '@mail2.example.com') END",
     "CASE WHEN NOT clean THEN concat('UPI cust', k, '@okaxis') END",
     "CASE WHEN NOT clean THEN concat('PAN ABCDE', four, 'F') END",
     "CASE WHEN odd THEN 'Account is dormant' END", "'RAVI KUMAR'"],
    ["'Transaction history'", "'Statement of account'", "concat('Account Number 041', nine)",
     "concat(d1, ' UPI/SIBL/', o1, '/PAY')", "concat(d2, ' NEFT/UBIN/', o2, '/PAY')",
     "concat(d2, ' debit Rs. 1,200.50')", "concat('Ref no: TX', nine)",
     "concat('12-May-26 IMPS UTIB 9', nine)",
     "CASE WHEN odd THEN concat('Aadhaar XXXX 1234 ', four) END"],
    ["'Card details'",
     "CASE WHEN clean THEN concat('XXXX XXXX XXXX ', four) ELSE concat('4111 2222 ', four, '-', right(nine, 4)) END",
     "'Expiry 12/2030'", "CASE WHEN odd THEN 'CVV: 123' END", "'SIGNATURE PANEL'"],
    ["'Fund transfer'", "'Beneficiary'", "'RAVI KUMAR said so'", "'SHARE RECEIPT now'", "concat('IFSC ABCD0', six)", "'Allow contacts'",
     "concat('neft/ABC/', '77', nine)", "CASE WHEN odd THEN 'Religion' END",
     "concat('Voter XYZ1', six)", "concat('DL KA01 2011 1', six)",
     "CASE WHEN odd AND clean THEN 'Fingerprint' END"],
    ["'Mobile recharge'", "'Operator prepaid'", "'Recharge amount Rs. 299'",
     "CASE WHEN NOT clean THEN 'Date of birth 12/05/1990' END",
     "CASE WHEN NOT clean THEN concat('Account number 041', nine) END", "'Gallery access'"],
    ["'My profile'", "'Settings'", "CASE WHEN NOT clean THEN 'Religion' END",
     "CASE WHEN NOT clean THEN 'Salary and ITR' END", "concat('Mobile 9', nine)",
     "CASE WHEN NOT clean THEN concat('Alternate mobile 8', nine) END",
     "concat('Customer ID: CU', six)", "CASE WHEN odd THEN 'Complaint desk' END"],
    ["'Loan summary'", "'EMI amount Rs 5,000'", "'Repayment'", "'Insurance policy'",
     "concat('Ledger balance: INR ', money)", "concat('Total 33', money)"],
    ["'Video KYC'", "'Face capture and selfie photo'", "'Fingerprint'", "CASE WHEN clean THEN 'I agree' END",
     "CASE WHEN clean THEN 'Fingerprint scan' END", "'Voice auth by call recording'"],
    ["'Terms and conditions'", "'I agree to all terms'", "'We collect data by CCTV'", "'ACCOUNT NUMBER is kept'",
     "CASE WHEN clean THEN 'Purpose: account services' END",
     "CASE WHEN clean THEN 'Right to withdraw consent' END"],
    ["'Sponsored offer'", "'Partner deal'", "concat('Balance Rs ', money)",
     "CASE WHEN NOT clean THEN 'Minor saver' END", "CASE WHEN odd THEN 'Recommended for you' END",
     "'ASHA VERMA'", "CASE WHEN clean THEN 'Opt out' END"],
    ["'Stack trace'", "'Exception at server'", "'Session token'",
     "concat('Host 10.0.', k % 256, '.1')", "CASE WHEN odd THEN 'Auth-token leaked' END"],
    ["'Login'", "CASE WHEN NOT clean THEN 'Password' END", "'OTP 4521'", "'Cookie notice'",
     "concat('Txn ID PQ', nine)", "CASE WHEN odd THEN 'Sign in' END"],
]


def template_sql() -> str:
    """The screen text as one SQL expression over the columns named above."""
    arms = " ".join(
        f"WHEN {n} THEN concat_ws(chr(10), {', '.join(lines)})" for n, lines in enumerate(TEMPLATE_LINES)
    )
    return f"CASE CAST(k % {len(TEMPLATE_LINES)} AS INT) {arms} END"


def day_sql(column: str) -> str:
    return (
        f"concat(lpad(CAST(day({column}) AS STRING), 2, '0'), '/', "
        f"lpad(CAST(month({column}) AS STRING), 2, '0'), '/', CAST(year({column}) AS STRING))"
    )


CUSTOMER_FIELDS_SQL = """
    c_custkey AS k, c_nationkey,
    lpad(CAST(c_custkey AS STRING), 9, '0') AS nine,
    right(lpad(CAST(c_custkey AS STRING), 9, '0'), 6) AS six,
    right(lpad(CAST(c_custkey AS STRING), 9, '0'), 5) AS five,
    right(lpad(CAST(c_custkey AS STRING), 9, '0'), 4) AS four,
    CAST(CAST(abs(c_acctbal) AS DECIMAL(12,2)) AS STRING) AS money,
    CAST(floor(c_custkey / 13) AS INT) % 2 = 1 AS odd,
    c_custkey % 7 = 0 AS clean
"""


def customer_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with the template columns; orders are pre-aggregated."""
    orders = (
        spark.read.parquet(f"{sf_dir}/orders.parquet")
        .groupBy("o_custkey")
        .agg(
            F.min("o_orderdate").alias("first_date"),
            F.max("o_orderdate").alias("last_date"),
            F.min("o_orderkey").alias("first_key"),
            F.max("o_orderkey").alias("last_key"),
        )
    )
    customers = spread(spark.read.parquet(f"{sf_dir}/customer.parquet"))
    joined = customers.join(orders, customers.c_custkey == orders.o_custkey, "left")
    return joined.selectExpr(
        *_split_fields(CUSTOMER_FIELDS_SQL),
        f"{day_sql('first_date')} AS d1",
        f"{day_sql('last_date')} AS d2",
        "lpad(CAST(first_key AS STRING), 12, '6') AS o1",
        "lpad(CAST(last_key AS STRING), 12, '7') AS o2",
    )


def _split_fields(sql: str) -> list[str]:
    fields, depth, current = [], 0, ""
    for ch in sql:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            fields.append(current.strip())
            current = ""
        else:
            current += ch
    return [*fields, current.strip()]


def banking_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One derived banking screen per customer; odd screen ids."""
    facts = customer_facts(spark, sf_dir)
    return facts.select(
        (F.col("k") * 2 + 1).alias("screen_id"),
        F.col("c_nationkey").cast("long").alias("session_id"),
        F.concat(F.lit("user"), (F.col("k") % 50).cast("string")).alias("user_id"),
        F.concat(F.lit("screen_"), F.col("k").cast("string"), F.lit(".png")).alias("filename"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("k") * 60).alias("uploaded_at"),
        F.expr(template_sql()).alias("full_text"),
        F.when(F.col("k") % 29 == 3, F.lit(0.35))
        .otherwise((F.lit(90) + F.col("k") % 10).cast("double") / 100)
        .alias("avg_confidence"),
    ).select(*SCREEN_COLUMNS)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (even ids) and all banking screens (odd ids)."""
    documents = read_screens(spark, f"{sf_dir}/documents.parquet", "documents")
    return documents.withColumn("screen_id", F.col("screen_id") * 2).unionByName(
        banking_screens(spark, sf_dir)
    )


# Block layouts, one per customer: (text, x1, y1, x2, y2, only when).  dx and dy move with the
# customer.  Even ones get a passbook page with each value right of its label, odd ones
# a card whose values stand below their labels in two columns; both end with entries,
# some of them cut in many narrow blocks.
BLOCK_TEMPLATE = [
    ("'Savings passbook'", "36", "40 + dy", "214", "66 + dy", "NOT odd"),
    ("'Customer ID'", "36", "96", "141", "117", "NOT odd AND k % 11 <> 0"),
    ("concat('C', nine)", "262 + dx", "97", "371 + dx", "118", "NOT odd AND k % 11 <> 0"),
    ("'Account Number'", "36", "131", "158", "152", "NOT odd"),
    ("concat('5120', nine, '77')", "262 + dx", "131", "421 + dx", "152", "NOT odd"),
    ("'IFSC Code'", "36", "167", "117", "188", "NOT odd AND k % 3 <> 0"),
    ("concat('LMNO0', six)", "262", "167 + dy", "378", "188 + dy", "NOT odd AND k % 3 <> 0"),
    ("'Available Balance'", "36", "205", "170", "226", "NOT odd"),
    ("concat('Rs ', money)", "262", "205", "350", "226", "NOT odd"),
    ("'LEELA'", "36", "252", "92", "273", "NOT odd AND k % 5 <> 1"),
    ("'NAIR'", "99 + dx", "252", "146 + dx", "273", "NOT odd AND k % 5 <> 1"),
    ("'My card'", "300", "18", "372", "44", "odd"),
    ("'Branch Name'", "44", "80", "146", "100", "odd"),
    ("'Account Balance'", "402 + dx", "80", "527 + dx", "100", "odd"),
    ("'RIVER'", "44", "109", "96", "129", "odd"),
    ("'ROAD,'", "103", "109", "152", "129", "odd"),
    ("'EASTGATE'", "159", "109", "247", "129", "odd AND NOT clean"),
    ("concat('Rs 33', money)", "402 + dx", "109", "511 + dx", "129", "odd"),
    ("'Cust ID'", "44", "163", "112", "183", "odd AND k % 11 <> 1"),
    ("'Account No'", "402", "163 + dy", "494", "183 + dy", "odd"),
    ("concat('D', nine)", "44", "192", "152", "212", "odd AND k % 11 <> 1"),
    ("concat('66', nine, '01')", "402", "192 + dy", "531", "212 + dy", "odd"),
    ("'OMAR'", "44", "246", "97", "266", "odd AND k % 5 <> 2"),
    ("'DAS'", "104", "246", "140", "266", "odd AND k % 5 <> 2"),
    ("'IFSC'", "402", "246", "446", "266", "odd"),
    ("concat('PQRS0', six)", "402", "275", "517", "295", "odd"),
    ("'Mini Statement'", "240", "352", "371", "378", "k % 3 <> 0"),
    ("d1", "52", "420", "137", "439", "d1 IS NOT NULL"),
    ("'UPI'", "160", "420", "188", "439", "d1 IS NOT NULL"),
    ("'/'", "190", "420", "195", "439", "d1 IS NOT NULL"),
    ("'UTIB'", "197", "420", "237", "439", "d1 IS NOT NULL"),
    ("'/'", "239", "420", "244", "439", "d1 IS NOT NULL"),
    ("o1", "246", "420 + dy", "361", "439 + dy", "d1 IS NOT NULL"),
    ("'/TEA STALL'", "364", "421", "452", "440", "d1 IS NOT NULL"),
    ("'-Rs 48'", "596", "420", "650", "439", None),
    ("d2", "52", "467", "137", "486", "d2 IS NOT NULL"),
    ("concat('UPI/HDFC/', o2, '/LEELA/UPI')", "160", "468", "455", "487", "d2 IS NOT NULL"),
    ("'+ Rs 905'", "584", "467 + dy", "650", "486 + dy", None),
    # A dense run: every line a few pixels below the one before.
    ("'total'", "52", "520", "90", "532", "k % 4 = 1"),
    ("'of'", "120", "525", "134", "537", "k % 4 = 1"),
    ("'both'", "160", "530", "190", "542", "k % 4 = 1"),
    ("'entries'", "220", "535", "268", "547", "k % 4 = 1"),
    ("'Rs 953'", "300", "540", "350", "552", "k % 4 = 1"),
]
LAYOUT_FIELDS_SQL = "k % 5 * 3 AS dx, k % 7 AS dy"


def statement_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw blocks of one account-summary layout per customer."""
    facts = customer_facts(spark, sf_dir).selectExpr("*", *_split_fields(LAYOUT_FIELDS_SQL))
    records = []
    for index, (text, x1, y1, x2, y2, when) in enumerate(BLOCK_TEMPLATE):
        record = (
            f"struct(k AS screen_id, {index} AS block_index, {text} AS text, "
            f"CAST({x1} AS DOUBLE) AS x1, CAST({y1} AS DOUBLE) AS y1, "
            f"CAST({x2} AS DOUBLE) AS x2, CAST({y2} AS DOUBLE) AS y2)"
        )
        records.append(f"CASE WHEN {when} THEN {record} END" if when else record)
    # The id travels in the record: blocks are many times the customers, so what groups them by
    # screen must not reuse the few partitions in which customers met their orders.
    exploded = facts.selectExpr(f"explode(array_compact(array({', '.join(records)}))) AS b")
    return exploded.select(
        "b.screen_id",
        "b.block_index",
        "b.text",
        ((F.lit(90) + (F.col("b.screen_id") + F.col("b.block_index")) % 10).cast("double") / 100).alias("confidence"),
        F.expr(
            "array(array(b.x1, b.y1), array(b.x2, b.y1), array(b.x2, b.y2), array(b.x1, b.y2))"
        ).alias("bbox"),
    )
