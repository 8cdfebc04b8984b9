"""Sealed values and the life cycle of their keys, as columns and joins.

A value is sealed by AES-256-GCM under the key of a version, which is derived from a master secret, with a random nonce
for every seal (so no nonce is ever used twice) and the version and owner as associated data: a box that is moved to
another row, or opened under another version, does not open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that a seal adds: nonce and tag.
OVERHEAD = 12 + 16


def key_of(version: Column, master: str) -> Column:
    """The 32-byte key of a version."""
    return F.unhex(F.sha2(F.concat_ws("|", F.lit(master), version.cast("string")), 256))


def _owner(version: Column, owner: Column) -> Column:
    return F.concat(F.lit("v"), version.cast("string"), F.lit(":"), owner.cast("string")).cast("binary")


def sealed(value: Column, owner: Column, version: Column, master: str) -> Column:
    return F.aes_encrypt(value.cast("binary"), key_of(version, master), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), _owner(version, owner))


def opened(box: Column, owner: Column, version: Column, master: str) -> Column:
    """The value as text; null where the box is not of that owner and version."""
    return F.try_aes_decrypt(box, key_of(version, master), F.lit("GCM"), F.lit("DEFAULT"), _owner(version, owner)).cast("string")


def resealed(table: DataFrame, moves: DataFrame, master: str, box: str = "box", owner: str = "call_id", version: str = "key_version") -> DataFrame:
    """The table with every box of a version in `moves` (version, target) sealed anew under its target.

    moves: a row a key version; the join is Spark's to plan.
    """
    joined = table.join(moves.select(F.col("version").alias(version), F.col("target").alias("_target")), version, "left")
    goes = F.col("_target").isNotNull()
    fresh = sealed(opened(F.col(box), F.col(owner), F.col(version), master), F.col(owner), F.col("_target"), master)
    made = {box: F.when(goes, fresh).otherwise(F.col(box)), version: F.coalesce("_target", version)}
    return joined.select(*(made[c].alias(c) if c in made else F.col(c) for c in table.columns))


def recoverable(raw: DataFrame, vault: DataFrame) -> DataFrame:
    """(version, raw, vault): rows that a key version still opens: all that are not hard-deleted. Counted before the shuffle."""
    one = lambda df, name: df.filter("hard_deleted_at IS NULL").select(F.col("key_version").alias("version"), F.lit(name).alias("of"))
    both = one(raw, "raw").unionByName(one(vault, "vault"))
    return both.groupBy("version").agg(F.count_if(F.col("of") == "raw").alias("raw"), F.count_if(F.col("of") == "vault").alias("vault"))


def _with_counts(versions: DataFrame, raw: DataFrame, vault: DataFrame) -> DataFrame:
    return versions.join(recoverable(raw, vault), "version", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("raw", "vault")})


def revoke(versions: DataFrame, raw: DataFrame, vault: DataFrame) -> DataFrame:
    """(version, result, affected_raw, affected_vault): what revoking each version does. Only retired ones can be."""
    held = lambda c: F.when(F.col("status") == "retired", F.col(c)).otherwise(0)
    result = F.when(F.col("status") == "active", "refused_active").when(F.col("status") != "retired", "refused_not_retired").otherwise("destroy_requested")
    return _with_counts(versions, raw, vault).select("version", result.alias("result"), held("raw").alias("affected_raw"), held("vault").alias("affected_vault"))


def revoke_parent(versions: DataFrame, raw: DataFrame, vault: DataFrame) -> DataFrame:
    """(kek, result, affected_raw, affected_vault, versions): the same of a parent key over all its versions that are not
    destroyed; it is refused while one of them is active."""
    open_ = F.col("status") != "destroyed"
    total = lambda c: F.sum(F.when(open_, F.col(c)).otherwise(0))
    sums = _with_counts(versions, raw, vault).groupBy("kek").agg(F.bool_or(F.col("status") == "active").alias("no"), total("raw").alias("r"), total("vault").alias("v"), F.count_if(open_).alias("n"))
    unless = lambda c: F.when(F.col("no"), 0).otherwise(F.col(c))
    return sums.select("kek", F.when(F.col("no"), "refused_active").otherwise("destroy_requested").alias("result"), unless("r").alias("affected_raw"), unless("v").alias("affected_vault"), unless("n").alias("versions"))


def targets(versions: DataFrame) -> DataFrame:
    """(version, target): rotating versions and the newest active version of their parent, where there is one."""
    active = versions.filter("status = 'active'").groupBy("kek").agg(F.max("version").alias("target"))
    return versions.filter("status = 'rotating'").join(active, "kek").select("version", "target")


def rotate(versions: DataFrame, raw: DataFrame, vault: DataFrame, moves: DataFrame) -> DataFrame:
    """(version, target, moved_raw, moved_vault, left, status): each rotation after the sweep; retired only if nothing is left.

    raw, vault: the tables after the sweep (key_version, before, hard_deleted_at).
    """
    def count(df: DataFrame, name: str) -> DataFrame:
        rows = df.filter("hard_deleted_at IS NULL").join(moves.select(F.col("version").alias("before"), "target"), "before")
        sums = rows.groupBy(F.col("before").alias("version")).agg(F.count_if(F.col("key_version") == F.col("target")).alias(f"moved_{name}"), F.count_if(F.col("key_version") != F.col("target")).alias(f"left_{name}"))
        return sums

    both = moves.join(count(raw, "raw"), "version", "left").join(count(vault, "vault"), "version", "left").na.fill(0)
    left = F.col("left_raw") + F.col("left_vault")
    return both.select("version", "target", "moved_raw", "moved_vault", left.alias("left"), F.when(left == 0, "retired").otherwise("rotating").alias("status"))


def rotate_parent(parents: DataFrame, fresh: Column) -> DataFrame:
    """(kek, status) after a parent key `fresh` has come: the active one is retired, the others stay."""
    old = parents.select("kek", F.when(F.col("status") == "active", "retired").otherwise(F.col("status")).alias("status"))
    return old.unionByName(parents.agg(fresh.alias("kek")).withColumn("status", F.lit("active")))


def finalize(versions: DataFrame, now: Column) -> DataFrame:
    """(kind, id, result): versions and parents whose destruction was asked for: destroyed once their recovery window is
    over, else still pending. A parent is destroyed only with the last of its versions.

    versions: version, kek, status, destroy_requested_at, recovery_window_until.
    """
    asked, over = F.col("destroy_requested_at").isNotNull(), F.col("recovery_window_until") <= now
    gone = (F.col("status") == "destroyed") | F.coalesce(asked & over, F.lit(False))
    done = F.when(over, "destroyed").otherwise("pending")
    keys = versions.filter(asked & (F.col("status") != "destroyed")).select(F.lit("version").alias("kind"), F.col("version").cast("long").alias("id"), done.alias("result"))
    parents = versions.groupBy("kek").agg(F.every(gone | asked).alias("asked"), F.every(gone).alias("gone")).filter("asked")
    return keys.unionByName(parents.select(F.lit("parent").alias("kind"), F.col("kek").cast("long").alias("id"), F.when(F.col("gone"), "destroyed").otherwise("pending").alias("result")))


def reveal(reviews: DataFrame, transcripts: DataFrame, now: Column, window_hours: int, master: str) -> DataFrame:
    """(review_id, result, transcript, audit): the transcript of reviews that may see it, with an audit entry for each.

    A review that is not active is a conflict; a purged or missing transcript, or one past the window, is unavailable
    and leaves no entry. transcripts: call_id, key_version, box and the retention columns.
    """
    live = transcripts.filter("soft_deleted_at IS NULL AND hard_deleted_at IS NULL").select("call_id", "key_version", "box")
    joined = reviews.join(live, "call_id", "left")
    allowed = F.col("raw_purged_at").isNull() & (now < F.col("created_at") + F.expr(f"INTERVAL {window_hours} HOURS")) & F.col("box").isNotNull()
    result = F.when(~F.col("status").isin("open", "in_review"), "conflict").when(allowed, "revealed").otherwise("unavailable")
    shown = joined.withColumn("result", result)
    text = F.when(F.col("result") == "revealed", opened(F.col("box"), F.col("call_id"), F.col("key_version"), master))
    audit = F.when(F.col("result") == "revealed", F.to_json(F.struct(F.lit("reveal_raw").alias("action"), F.array(F.lit("transcript")).alias("revealed"), F.col("call_id"))))
    return shown.select("review_id", "result", text.alias("transcript"), audit.alias("audit"))
