"""Bodies as the processors send them, JSON and XML, and their readers with fixed schemas.

Here the bodies are made from facts, so that reading them can be checked; a live source would write them to
files, which `spark.read.json` / `xml` or a stream takes with the same schemas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import ids, labels

CHARGE = "id string, amount long, currency string, created long, receipt_email string, customer string, billing_details struct<email:string>, payment_method_details struct<type:string>"
REFUND = "amount long, created long, charge string, status string"
GATEWAY = "transId long, batchId string, transactionStatus string, settleAmount decimal(18,2), accountType string, accountNumber string"
BALANCE = "array<struct<id:string,amount:long,fee:long,source:string>>"


def charge_bodies(facts: DataFrame) -> DataFrame:
    k = F.col("k")
    customer = F.when(k % 2 == 0, F.concat(F.lit('"cus'), k.cast("string"), F.lit('"'))).otherwise(F.concat(F.lit('{"id":"obj'), k.cast("string"), F.lit('"}')))
    body = F.concat(
        F.lit('{"id":"tx'), k.cast("string"), F.lit('","amount":'), (F.col("amount_gross") * 100).cast("long").cast("string"), F.lit(',"currency":"usd","created":'), F.unix_timestamp(F.col("proc_date").cast("timestamp")).cast("string"),
        F.lit(',"receipt_email":"r'), k.cast("string"), F.lit('@x.org","customer":'), customer, F.coalesce(F.concat(F.lit(',"billing_details":{"email":"'), "customer_email", F.lit('"}')), F.lit("")),
        F.lit(',"payment_method_details":{"type":"'), F.coalesce("payment_method", F.lit("card")), F.lit('"}}'),
    )
    return facts.select("k", body.alias("body"))


def charge_rows(bodies: DataFrame) -> DataFrame:
    r = bodies.withColumn("c", F.from_json("body", CHARGE))
    customer = F.coalesce(F.get_json_object("c.customer", "$.id"), F.col("c.customer"))
    return r.select("k", (F.col("c.amount").cast("decimal(18,0)") / 100).cast("decimal(18,2)").alias("amount"), F.upper("c.currency").alias("currency"), customer.alias("customer"), F.coalesce("c.billing_details.email", "c.receipt_email").alias("email"), (F.col("c.payment_method_details.type") == "card").alias("is_card"), F.to_date(F.timestamp_seconds("c.created")).alias("proc_date"))


def gateway_bodies(facts: DataFrame) -> DataFrame:
    k = F.col("k")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))
    state = F.when(k % 20 == 1, "refundSettledSuccessfully").otherwise("settledSuccessfully")
    body = F.concat(F.lit("<transaction>"), tag("transId", k), tag("batchId", F.concat(F.lit("b"), (k % 50).cast("string"))), tag("transactionStatus", state), tag("settleAmount", F.col("amount_gross")), tag("accountType", F.when(k % 5 == 0, "eCheck").otherwise("Visa")), tag("accountNumber", F.concat(F.lit("XXXX"), F.lpad((k % 10000).cast("string"), 4, "0"))), F.lit("</transaction>"))
    return facts.select("k", body.alias("body"))


def gateway_rows(bodies: DataFrame) -> DataFrame:
    r = bodies.withColumn("t", F.from_xml("body", GATEWAY))
    method = F.when(F.lower("t.accountType") == "echeck", "bank_account").otherwise("card")
    return r.select("k", F.col("t.batchId").alias("batch"), labels.gateway_kind(F.col("t.transactionStatus")).alias("kind"), F.col("t.settleAmount").alias("amount"), F.right("t.accountNumber", F.lit(4)).alias("last4"), method.alias("method"))


def refund_bodies(facts: DataFrame) -> DataFrame:
    k = F.col("k").cast("string")
    charge = F.when(F.col("k") % 2 == 0, F.concat(F.lit('"tx'), k, F.lit('"'))).otherwise(F.concat(F.lit('{"id":"tx'), k, F.lit('"}')))
    status = F.when(F.col("k") % 3 == 0, "pending").otherwise("succeeded")
    body = F.concat(F.lit('{"amount":'), (F.col("amount_gross") * 100).cast("long").cast("string"), F.lit(',"created":'), F.unix_timestamp(F.col("proc_date").cast("timestamp")).cast("string"), F.lit(',"charge":'), charge, F.lit(',"status":"'), status, F.lit('"}'))
    return facts.select("k", body.alias("body"))


def refund_rows(bodies: DataFrame) -> DataFrame:
    r = bodies.withColumn("r", F.from_json("body", REFUND))
    charge = F.coalesce(F.get_json_object("r.charge", "$.id"), F.col("r.charge"))
    return r.select("k", (F.col("r.amount").cast("decimal(18,0)") / 100).cast("decimal(18,2)").alias("amount"), charge.alias("charge"), F.col("r.status").alias("status"), F.concat(F.lit("Refund of "), charge).alias("description"), F.to_date(F.timestamp_seconds("r.created")).alias("proc_date"))


def balance_bodies(facts: DataFrame) -> DataFrame:
    entry = F.struct(F.col("processor_payment_id").alias("id"), (F.col("amount_gross") * 100).cast("long").alias("amount"), F.when(F.col("k") % 3 == 0, 100).otherwise(0).cast("long").alias("fee"), F.col("processor_payment_id").alias("source"))
    return facts.groupBy("processor_payout_id").agg(F.to_json(F.collect_list(entry)).alias("body"))


def balance_rows(bodies: DataFrame) -> DataFrame:
    return bodies.select("processor_payout_id", F.inline(F.from_json("body", BALANCE))).select("processor_payout_id", "id", (F.col("amount").cast("decimal(18,0)") / 100).cast("decimal(18,2)").alias("amount"), (F.col("fee") / 100).cast("long").alias("fee"))


PAGE = "has_more boolean, data array<struct<id:string,amount:long>>"
#: Entries of a page at most.
PAGE_ROWS = 100
PAYOUT = "id string, amount long, currency string, arrival_date long, status string"
ACCOUNT = "id string, default_currency string, business_profile struct<name:string>"
BATCHES = "batchList struct<batch:array<struct<batchId:string,settlementState:string,settlementTimeUTC:string>>>"


def charge_pages(facts: DataFrame) -> DataFrame:
    """Pages by spans of ids, so that none holds over PAGE_ROWS entries; every third is the last of its list."""
    page = F.floor(F.col("k") / PAGE_ROWS)
    entry = F.struct("k", F.concat(F.lit("tx"), F.col("k").cast("string")).alias("id"), (F.col("amount_gross") * 100).cast("long").alias("amount"))
    pages = facts.groupBy(page.alias("page")).agg(F.array_sort(F.collect_list(entry)).alias("data"))
    return pages.select(F.to_json(F.struct((F.col("page") % 3 != 0).alias("has_more"), F.transform("data", lambda x: F.struct(x["id"].alias("id"), x["amount"].alias("amount"))).alias("data"))).alias("body"))


def page_rows(pages: DataFrame) -> DataFrame:
    last = F.when(F.col("has_more"), F.element_at("data", -1)["id"])
    rows = pages.select(last.alias("next_after"), F.inline("data"))
    return rows.select(F.substring("id", 3, 20).cast("long").alias("k"), (F.col("amount").cast("decimal(18,0)") / 100).cast("decimal(18,2)").alias("amount"), "next_after")


def payout_bodies(batches: DataFrame) -> DataFrame:
    arrives = F.unix_timestamp(F.col("settlement_date").cast("timestamp"))
    return batches.select(F.to_json(F.struct(F.col("processor_payout_id").alias("id"), (F.col("net_amount") * 100).cast("long").alias("amount"), F.lit("usd").alias("currency"), arrives.alias("arrival_date"), F.when(F.col("k") % 6 != 0, "paid").alias("status"))).alias("body"))


def payout_rows(bodies: DataFrame) -> DataFrame:
    p = bodies.select(F.from_json("body", PAYOUT).alias("p")).select("p.*")
    return p.select("id", (F.col("amount").cast("decimal(18,0)") / 100).cast("decimal(18,2)").alias("amount"), F.upper("currency").alias("currency"), F.to_date(F.timestamp_seconds("arrival_date")).alias("arrives"), F.coalesce("status", F.lit("pending")).alias("status"))


def batch_bodies(batches: DataFrame) -> DataFrame:
    """A list for each workspace and 31 days, as a gateway answers; some batches aren't settled, some lack the time."""
    k = F.col("k")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    time = F.when(k % 11 != 0, tag("settlementTimeUTC", F.concat(F.col("settlement_date").cast("string"), F.lit("T10:30:00Z")))).otherwise("")
    batch = tag("batch", F.concat(tag("batchId", F.col("processor_payout_id")), tag("settlementState", F.when(k % 9 == 0, "settlementError").otherwise("settledSuccessfully")), time))
    lists = batches.groupBy("workspace_id", F.floor(F.unix_date("settlement_date") / 31).alias("span")).agg(F.concat_ws("", F.collect_list(batch)).alias("all"))
    return lists.select(F.concat(F.lit("<answer><batchList>"), "all", F.lit("</batchList></answer>")).alias("body"))


def batch_rows(bodies: DataFrame) -> DataFrame:
    b = bodies.select(F.inline(F.from_xml("body", BATCHES)["batchList"]["batch"]))
    settled = b.where(F.col("settlementState").isin(*labels.SETTLED) & (F.col("batchId") != "") & F.col("settlementTimeUTC").isNotNull())
    return settled.select(F.col("batchId").alias("processor_payout_id"), F.left("settlementTimeUTC", F.lit(10)).cast("date").alias("settlement_date"), F.concat(F.lit("Batch "), "batchId").alias("description"))


# --- nested bodies of accounting objects, and gateway answers of both shapes ------------------------

OBSERVED = "Id string, TotalAmt string, TxnDate date, CurrencyRef struct<value:string>, CustomerRef struct<value:string,name:string>, PaymentRefNum string, DocNumber string"
DEPOSIT = "Id string, Line array<struct<Amount:string,Description:string,LinkedTxn:array<struct<TxnId:string,TxnType:string>>>>"
DETAIL = "transId long, payment struct<creditCard:struct<cardNumber:string,cardType:string>,bankAccount:struct<accountNumber:string>>, billTo struct<firstName:string,lastName:string>, customer struct<email:string>, settleAmount decimal(18,2), accountType string, accountNumber string, firstName string, lastName string, customerEmail string"


def observed_bodies(facts: DataFrame) -> DataFrame:
    """Payments, refund receipts and credit memos as their source gives them. The currency may be missing; a credit memo's number is its document number."""
    k = F.col("k")
    kind = F.when(F.col("event_type") == "payment_observed", "Payment").when(k % 3 == 0, "CreditMemo").otherwise("RefundReceipt")
    ref = F.when(kind != "CreditMemo", F.col("ref_no")).alias("PaymentRefNum")
    doc = F.when(kind == "CreditMemo", F.concat(F.lit("doc"), k.cast("string"))).alias("DocNumber")
    currency = F.when(k % 4 == 0, F.struct(F.lit("CAD").alias("value"))).alias("CurrencyRef")
    body = F.to_json(F.struct(F.col("accounting_id").alias("Id"), F.col("amount_gross").cast("string").alias("TotalAmt"), F.col("acct_date").alias("TxnDate"), currency, F.struct(k.cast("string").alias("value"), F.col("customer_name").alias("name")).alias("CustomerRef"), ref, doc))
    return facts.select("workspace_id", kind.alias("object_type"), body.alias("body"))


def observed_rows(bodies: DataFrame) -> DataFrame:
    r = bodies.withColumn("b", F.from_json("body", OBSERVED))
    memo = F.col("object_type") == "CreditMemo"
    event = F.when(F.col("object_type") == "Payment", "payment_observed").otherwise("refund_observed")
    ref = F.when(memo, F.col("b.DocNumber")).otherwise(F.col("b.PaymentRefNum"))
    return r.select(ids.accounting_id(F.col("workspace_id"), F.lit("qbo"), F.col("object_type"), F.col("b.Id")).alias("id"), event.alias("event_type"), "object_type", F.col("b.TotalAmt").cast("decimal(18,2)").alias("amount"), F.coalesce("b.CurrencyRef.value", F.lit("USD")).alias("currency"), F.nullif(F.trim("b.CustomerRef.name"), F.lit("")).alias("customer"), F.nullif(F.trim(ref), F.lit("")).alias("ref_no"), F.col("b.TxnDate").alias("acct_date"))


def deposit_bodies(facts: DataFrame) -> DataFrame:
    """Deposits' bodies with their lines, from accounting facts that a deposit holds (deposit_id, k, txn_type, txn_id, amount); every fifth line has no link, some of these no description."""
    k = F.col("k")
    link = F.struct(F.col("txn_id").alias("TxnId"), F.col("txn_type").alias("TxnType"))
    links = F.when(k % 5 == 0, F.array().cast("array<struct<TxnId:string,TxnType:string>>")).otherwise(F.array(link))
    line = F.struct(F.col("amount").cast("string").alias("Amount"), F.when((k % 5 == 0) & (k % 2 == 1), F.concat(F.lit("cash "), k.cast("string"))).alias("Description"), links.alias("LinkedTxn"))
    return facts.groupBy("deposit_id").agg(F.collect_list(line).alias("Line")).select(F.to_json(F.struct(F.col("deposit_id").alias("Id"), "Line")).alias("body"))


def deposit_line_rows(bodies: DataFrame) -> DataFrame:
    """A row for each link of a line, or one of type DirectLine for a line without any."""
    b = bodies.select(F.from_json("body", DEPOSIT).alias("b")).select(F.col("b.Id").alias("deposit_id"), F.explode("b.Line").alias("l"))
    none = F.struct(F.lit(None).cast("string").alias("TxnId"), F.lit("DirectLine").alias("TxnType"))
    rows = b.withColumn("link", F.explode(F.when(F.size("l.LinkedTxn") > 0, F.col("l.LinkedTxn")).otherwise(F.array(none))))
    direct = F.col("link.TxnType") == "DirectLine"
    text = F.coalesce("l.Description", F.when(direct, "Direct deposit line").otherwise(""))
    return rows.select("deposit_id", F.col("link.TxnType").alias("txn_type"), F.col("link.TxnId").alias("txn_id"), F.col("l.Amount").cast("decimal(18,2)").alias("amount"), text.alias("description"))


def gateway_answers(facts: DataFrame) -> DataFrame:
    """Every third transaction comes from a detail answer, in a namespace and with nested elements, the others from a list."""
    k = F.col("k")
    tag = lambda name, *values: F.concat(F.lit(f"<{name}>"), *[F.coalesce(v.cast("string"), F.lit("")) for v in values], F.lit(f"</{name}>"))
    text = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    last4 = F.concat(F.lit("XXXX"), F.lpad((k % 10000).cast("string"), 4, "0"))
    method = F.when(k % 2 == 0, tag("bankAccount", tag("accountNumber", last4))).otherwise(tag("creditCard", tag("cardNumber", last4), tag("cardType", F.lit("Visa"))))
    detail = F.concat(F.lit('<transaction xmlns="AnetApi/xml/v1/schema/AnetApiSchema.xsd">'), tag("transId", k), tag("payment", method), tag("settleAmount", F.col("amount_gross")), tag("billTo", tag("firstName", text(F.col("customer_name"))), tag("lastName", F.lit(""))), tag("customer", tag("email", text(F.col("customer_email")))), F.lit("</transaction>"))
    flat = F.concat(F.lit("<transaction>"), tag("transId", k), tag("settleAmount", F.col("amount_gross")), tag("accountType", F.when(k % 2 == 0, "eCheck").otherwise("Visa")), tag("accountNumber", last4), tag("firstName", text(F.col("customer_name"))), F.lit("</transaction>"))
    return facts.select(F.when(k % 3 == 0, detail).otherwise(flat).alias("body"))


def gateway_transactions(bodies: DataFrame) -> DataFrame:
    """One row shape for both answers: nested elements where there are any, else the fields of the list."""
    t = bodies.select(F.from_xml(F.regexp_replace("body", ' xmlns(:\\w+)?="[^"]*"', ""), DETAIL).alias("t"))  # names count without their namespace
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    card, bank = F.col("t.payment.creditCard"), F.col("t.payment.bankAccount")
    kind = F.lower("t.accountType")
    account = F.when(bank.isNotNull() | kind.isin("echeck", "checking", "savings"), "bank_account").otherwise("card")
    brand = F.when(account == "card", F.coalesce(F.lower(card["cardType"]), kind))
    number = F.coalesce(card["cardNumber"], bank["accountNumber"], F.col("t.accountNumber"))
    name = F.coalesce(blank(F.concat_ws(" ", "t.billTo.firstName", "t.billTo.lastName")), blank(F.concat_ws(" ", "t.firstName", "t.lastName")))
    return t.select(F.col("t.transId").alias("k"), account.alias("method"), brand.alias("brand"), F.right(number, F.lit(4)).alias("last4"), F.col("t.settleAmount").alias("amount"), name.alias("who"), blank(F.coalesce("t.customer.email", "t.customerEmail")).alias("email"), F.concat(F.lit("Transaction "), F.col("t.transId").cast("string")).alias("description"))
