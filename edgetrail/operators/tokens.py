"""Audit of signed playback tokens.

The keyed hash is built from the built-in SHA-256, so no Python runs per row.  The padded key
blocks appear as literals in the query plan: restrict access to plans and event logs, or set
``spark.sql.redaction.string.regex``, as for any job that is given a secret.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import normalize_ip
from ..functions.text import sanitize_tag
from ..functions.urls import hls_path_of
from ..functions.values import filled

# Payload keys and, for the optional tags, name, length and case in the signed text.
PAYLOAD_KEYS = [
    "uid", "sid", "cid", "path", "edge", "iat", "exp", "ip_bind", "client_ip",
    "rid", "scn", "lbl", "dsl", "dev", "lc", "ph", "np",
]
ALWAYS_SIGNED_TAGS = [("rid", 48, None), ("scn", 24, "upper"), ("lbl", 48, None)]
SIGNED_IF_PRESENT = [("dsl", 48), ("dev", 64), ("lc", 64), ("ph", 64), ("np", 32)]


def hmac_sha256(secret: str, message: Column) -> Column:
    """Hex HMAC-SHA256 of a text column (RFC 2104) from nested SHA-256."""
    key = secret.encode("utf-8")
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def from_base64url(text: Column) -> Column:
    """Decoded text, NULL if it is not base64url."""
    plain = F.rtrim(F.translate(text, "-_", "+/"), F.lit("="))
    padded = F.rpad(plain, F.ceil(F.length(plain) / 4).cast("int") * 4, F.lit("="))
    return F.try_to_binary(padded, F.lit("base64")).cast("string")


def _signed_text(p: str, names: Column) -> Column:
    """The text that is signed; ``names`` are the payload's keys, of which one with a null counts as an empty tag."""

    def plain(key: str) -> Column:
        return F.concat(F.lit(f"{key}="), F.coalesce(F.col(f"{p}.{key}"), F.lit("undefined")))

    parts = [plain(k) for k in ("uid", "sid", "cid", "path", "edge", "exp")]
    parts += [
        F.concat(F.lit(f"{k}="), sanitize_tag(F.col(f"{p}.{k}"), n, case)) for k, n, case in ALWAYS_SIGNED_TAGS
    ]
    parts += [
        F.when(F.array_contains(names, k), F.concat(F.lit(f"{k}="), sanitize_tag(F.col(f"{p}.{k}"), n)))
        for k, n in SIGNED_IF_PRESENT
    ]
    return F.concat_ws("&", *parts)


def audit_tokens(requests: DataFrame, secret: str, as_of_epoch: int) -> DataFrame:
    """Adds ``valid``, ``reason`` (first failed rule) and the token's derived times and tags.

    ``requests`` has token, sig, edge_id, request_uri and client_ip.
    """
    schema = ", ".join(f"{k} string" for k in PAYLOAD_KEYS) + ", _corrupt string"
    text = from_base64url(F.col("token"))
    rows = requests.withColumn("_text", text)
    rows = rows.withColumn("_p", F.from_json("_text", schema, {"columnNameOfCorruptRecord": "_corrupt"}))
    rows = rows.withColumn("_names", F.coalesce(F.json_object_keys("_text"), F.array().cast("array<string>")))
    rows = rows.withColumn("_exp", F.col("_p.exp").try_cast("double"))
    rows = rows.withColumn("_iat", F.coalesce(F.col("_p.iat").try_cast("double"), F.lit(0.0)))
    path = hls_path_of(F.col("request_uri"))
    bound = ~F.col("_p.ip_bind").isin("", "false", "0", "0.0") & (F.col("_p.client_ip") != "")
    reason = (
        F.when(
            F.coalesce(F.col("token"), F.lit("")).eqNullSafe("") | F.coalesce(F.col("sig"), F.lit("")).eqNullSafe(""),
            "missing_token_or_signature",
        )
        .when(F.col("_text").isNull() | F.col("_p").isNull() | F.col("_p._corrupt").isNotNull(), "invalid_token_encoding")
        .when(F.col("_exp").isNull() | (F.col("_exp") == 0) | (F.lit(as_of_epoch) > F.col("_exp")), "token_expired")
        .when(hmac_sha256(secret, _signed_text("_p", F.col("_names"))) != F.col("sig"), "invalid_signature")
        .when(~F.col("_p.edge").eqNullSafe(F.col("edge_id")), "edge_mismatch")
        .when(
            F.coalesce(bound, F.lit(False)) & ~F.col("_p.client_ip").eqNullSafe(normalize_ip(F.col("client_ip"))),
            "ip_mismatch",
        )
        .when((path == "") | ~path.eqNullSafe(F.col("_p.path")), "content_path_mismatch")
    )
    rows = rows.withColumn("reason", reason)
    ok = F.col("reason").isNull()

    def tag(key: str, *others: str) -> Column:
        chain = [filled(F.col(f"_p.{k}")) for k in (key, *others)]
        return F.when(ok, F.coalesce(*chain, F.lit("-")))

    exp, iat = F.col("_exp").cast("bigint"), F.col("_iat").cast("bigint")
    return rows.select(
        *requests.columns,
        ok.alias("valid"),
        "reason",
        F.when(ok, F.col("_p.uid")).alias("token_user_id"),
        F.when(ok, F.col("_p.sid")).alias("token_session_id"),
        F.when(ok, F.col("_p.cid")).alias("token_content_id"),
        F.when(ok & (iat > 0), F.timestamp_seconds(iat)).alias("token_issued_at"),
        F.when(ok, F.timestamp_seconds(exp)).alias("token_expires"),
        F.when(ok, F.when((iat > 0) & (exp > iat), exp - iat).otherwise(0)).alias("token_ttl_sec"),
        F.when(ok, F.greatest(exp - F.lit(as_of_epoch), F.lit(0))).alias("token_ttl_remaining_sec"),
        tag("lbl").alias("token_label"),
        tag("rid").alias("token_run_id"),
        tag("scn").alias("token_scenario_id"),
        tag("dsl", "lbl").alias("token_dataset_label"),
        tag("dev").alias("token_device_id"),
        tag("lc").alias("token_logical_client_id"),
        tag("ph").alias("token_physical_host_id"),
        tag("np").alias("token_network_profile_id"),
    )
