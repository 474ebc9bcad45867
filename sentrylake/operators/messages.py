"""Scores of SMS, chat and mail lures."""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import catalogue as C
from sentrylake.functions import text as T
from sentrylake.functions.urls import _signal, first_of, skeleton, verdict


def scored_messages(df: DataFrame, text: str = "text") -> DataFrame:
    """df with upi, phone, telegram, brand, signals, score (hundredths), verdict and url (the key of the message's digest).

    A null text counts as empty. Without a brand and without a request for money or credentials the score is 60 at most.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumns({"upi": T.upi_ids(t), "phone": T.phones(t), "telegram": T.telegram(t), "_low": skeleton(F.lower(t))})
    names = [("(?<![a-z0-9])(?:" + "|".join(re.escape(n) for n in sorted({display.lower(), *keywords})) + ")(?![a-z0-9])", key) for key, display, keywords, *_ in C.BRANDS]
    first = first_of([(F.col("_low").rlike(pattern), key) for pattern, key in names])
    # the first handle that has a keyword, and its first keyword in catalogue order
    handles = F.transform("upi", lambda u: skeleton_ascii(F.substring_index(u, "@", 1)))
    out = out.withColumn("_handle", F.get(F.filter(handles, lambda h: h.rlike("|".join(k for k, _ in C.KEYWORDS))), F.lit(0)))
    keyword = first_of([(F.contains("_handle", F.lit(k)), key) for k, key in C.KEYWORDS])
    rules = [_signal(name, points, t.rlike(f"(?i){pattern}")) for name, points, pattern in C.MESSAGE_RULES]
    pay = (F.size("upi") > 0) & t.rlike(f"(?i){C.PAYMENT_REQUEST}")
    call = (F.size("phone") > 0) & t.rlike(f"(?i){C.CALLBACK}")
    signals = F.array_compact(F.array(_signal("brand_mentioned", 25, first.isNotNull()), _signal("brand_impersonating_upi_handle", 35, F.col("_handle").isNotNull()), *rules, _signal("payment_request_to_upi", 25, pay), _signal("callback_number", 10, call), _signal("telegram_contact", 10, F.size("telegram") > 0)))
    out = out.withColumn("brand", F.coalesce(first, keyword)).withColumn("signals", signals)
    total = F.aggregate("signals", F.lit(0), lambda a, s: a + s["points"])
    asks = F.exists("signals", lambda s: s["name"].isin("payment_request_to_upi", "credential_request"))
    out = out.withColumn("score", F.least(F.lit(100), F.when(F.col("brand").isNull() & ~asks, F.least(total, F.lit(60))).otherwise(total)))
    return out.withColumn("verdict", verdict(F.col("score"))).withColumn("url", F.concat(F.lit("message://"), F.substring(T.message_digest(t), 1, 24))).drop("_low", "_handle")


def skeleton_ascii(x):
    return F.replace(F.replace(F.translate(F.lower(x), *C.DIGIT_LETTERS), F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w"))
