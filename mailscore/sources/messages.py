"""Message payloads (JSON) to email rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscore.functions import mime
from mailscore.operators.once import compute_once


def flatten_messages(raw: DataFrame, json_column: str = "payload_json", keep: tuple[str, ...] = ()) -> DataFrame:
    """message_id, subject, sender, recipient, body, received_at, plus ``reject`` = why a message is unusable."""
    m = F.from_json(F.col(json_column), mime.PAYLOAD_SCHEMA)
    parsed = compute_once(raw.select(*keep, m.alias("m")), list(keep)).select(
        *keep,
        F.col("m.id").alias("message_id"),
        F.col("m.payload").alias("p"),
    )
    headers = F.col("p.headers")
    reject = (
        F.when(F.col("message_id").isNull(), F.lit("no message id"))
        .when(F.col("p").isNull(), F.lit("no payload"))
        .when(mime.malformed(F.col("p")), F.lit("part without type or body"))
        .when(F.col("body").isNull(), F.lit("body not decodable"))
    )
    flat = parsed.withColumn("body", mime.body_of(F.col("p"))).select(
        *keep,
        "message_id",
        mime.header(headers, "Subject").alias("subject"),
        mime.header(headers, "From").alias("sender"),
        mime.header(headers, "To").alias("recipient"),
        "body",
        mime.mail_date(mime.header(headers, "Date")).alias("received_at"),
        reject.alias("reject"),
    )
    return compute_once(flat, list(keep))  # good and rejected messages are told apart by a filter


def split_rejects(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable messages, rejected messages with the reason)."""
    return flat.where(F.col("reject").isNull()).drop("reject"), flat.where(F.col("reject").isNotNull())


def ad_hoc_emails(texts: DataFrame, user: str = "user_id", text: str = "text") -> DataFrame:
    """Texts analysed by hand as email rows; the id comes from user and text, so no two texts share one."""
    body = F.col(text)
    key = F.substring(F.sha2(F.concat_ws("|", F.col(user).cast("string"), body), 256), 1, 16)
    return texts.select(
        F.col(user).alias("user_id"),
        F.concat(F.lit("manual_"), key).alias("message_id"),
        F.lit("Manual Analysis").alias("subject"),
        F.lit("").alias("sender"),
        F.lit("").alias("recipient"),
        body.alias("body"),
    ).dropDuplicates(["user_id", "message_id"])
