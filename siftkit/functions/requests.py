"""Request and reply columns (J11-J14, H26, L3) for the screening service path."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import col
from .text import request_digest

REQUEST_SCHEMA = StructType([StructField("ts", LongType()), StructField("id", StringType()),
                             StructField("news", StringType())])


def parse_request(body, schema: StructType = REQUEST_SCHEMA) -> Column:
    """Request JSON -> struct; malformed JSON gives nulls, not an exception."""
    return F.from_json(col(body), schema, {"mode": "PERMISSIVE"})


def request_status(parsed) -> Column:
    """L3: 'ok' when the request carries a news text, else 'error'."""
    return F.when(col(parsed)["news"].isNotNull(), F.lit("ok")).otherwise(F.lit("error"))


def answer_status(answer) -> Column:
    """J13: 'ok' for an answer that is a list, else 'error' (a null answer makes an L3 error row)."""
    return F.when(col(answer).cast("array<string>").isNull(), F.lit("error")).otherwise(F.lit("ok"))


def build_reply(parsed, answer, salt: str, server_ts) -> Column:
    """Request fields echoed with the answer, a digest of the request id and server seconds."""
    p = col(parsed)
    return F.struct(p["id"].alias("req_id"), p["ts"].alias("req_ts"), col(answer).alias("answer"),
                    request_digest(p["id"], salt).alias("server_digest"), col(server_ts).alias("server_ts"))


def result_json(fields: dict[str, Column]) -> Column:
    """JSON with keys sorted; non-ASCII kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))
