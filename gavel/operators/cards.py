"""JSN-4: signed result cards for a whole table of eval rows (not one).

Payload = canonical JSON (sorted keys, compact, nulls kept) of the card
fields; ``payload_hash`` = SHA-256 of it; optional HMAC-SHA256 signature.
Run id and timestamp are parameters so reruns are reproducible; the card
id is derived from (run id, instance id) instead of a random UUID.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.functions.crypto import canonical_json, hmac_sha256_hex


def _col(df: DataFrame, *names, default=None):
    for n in names:
        if n in df.columns:
            return F.col(n)
    return F.lit(default)


def proofcards(evals: DataFrame, run_id: str, stamp: str, source_path: str = "table", sign_key: bytes | None = None,
               key_hint: str | None = None) -> DataFrame:
    inst = F.coalesce(_col(evals, "instance_id"), _col(evals, "task"), F.lit("unknown_instance"))
    passed = F.coalesce(_col(evals, "tests_passed"), F.lit(0))
    failed = F.coalesce(_col(evals, "tests_failed"), F.lit(0))
    total = F.coalesce(_col(evals, "total_tests"), passed + failed)
    patch = _col(evals, "patch")
    fields = {
        "proofcard_id": F.sha2(F.concat(F.lit(run_id + "|"), inst), 256),
        "run_id": F.coalesce(_col(evals, "run_id"), F.lit(run_id)),
        "instance_id": inst,
        "model": F.coalesce(_col(evals, "model"), F.lit("unknown_model")),
        "timestamp": F.lit(stamp),
        "tests": {"passed": passed, "failed": failed, "total": total},
        "cri": _col(evals, "cri"),
        "sad_flag": F.coalesce(_col(evals, "sad_flag"), _col(evals, "sad")),
        "tau": F.coalesce(_col(evals, "tau"), _col(evals, "last_tau")),
        "decision": F.coalesce(_col(evals, "final_decision"), _col(evals, "decision"), F.lit("UNKNOWN")),
        "patch_hash": F.when(F.coalesce(patch, F.lit("")) != "", F.sha2(patch, 256)),
        "source_enriched_path": F.lit(source_path),
    }
    out = evals.select(inst.alias("instance_id"), canonical_json(fields).alias("payload"))
    out = out.withColumn("payload_hash", F.sha2("payload", 256))
    if sign_key is not None:
        out = out.withColumn("signature", F.struct(F.lit("HMAC-SHA256").alias("algo"), F.lit(key_hint).alias("key_hint"),
                                                   hmac_sha256_hex(sign_key, F.col("payload")).alias("value")))
    return out


def pick_record(evals: DataFrame, instance_id: str | None = None, order: str = "seq") -> DataFrame:
    """WIN-5: the first record, or the first one for an id (instance_id or
    task), by explicit order."""
    d = evals
    if instance_id is not None:
        cond = F.lit(False)
        for c in ("instance_id", "task"):
            if c in d.columns:
                cond = cond | (F.col(c) == instance_id)
        d = d.where(cond)
    return d.orderBy(order).limit(1)
