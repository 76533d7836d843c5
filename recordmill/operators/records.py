"""Identity, order and change of records: dedup, upsert, diff, pages, unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import identity


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order. An aggregate, so that rows are reduced before the shuffle."""
    return _one_row(df, key, order, F.min)


def last_wins(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return _one_row(df, key, order, F.max)


def _one_row(df: DataFrame, key, order, pick) -> DataFrame:
    ranked = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*df.columns).alias("_row"))
    return df.groupBy(*key).agg(pick(ranked).alias("_best")).select("_best._row.*")


def name_conflicts(df: DataFrame, name: str, content: Sequence[str]) -> DataFrame:
    """Names with different contents: name, rows, variants."""
    hashed = df.select(name, identity.content_hash(*[F.col(c) for c in content]).alias("_h"))
    return hashed.groupBy(name).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("_h").alias("n_variants")).where("n_variants > 1")


def disambiguated(df: DataFrame, seed: Column, content: Sequence[str], name: str = "uid") -> DataFrame:
    """A uid for each row from its seed; rows that share a seed are seeded by their content too, and rows with the same content get an ordinal.

    A seed of null is never shared: such rows get a random uid.
    """
    hashed = identity.content_hash(*[F.col(c) for c in content])
    marked = df.withColumn("_seed", seed).withColumn("_content", hashed)
    shared = F.count(F.lit(1)).over(W.partitionBy("_seed"))
    ordinal = F.row_number().over(W.partitionBy("_seed", "_content").orderBy(*content)) - 1
    marked = marked.withColumn("_shared", shared).withColumn("_ordinal", ordinal)
    own = F.when(F.col("_shared") > 1, F.concat_ws("::", "_seed", "_content")).otherwise(F.col("_seed"))
    own = F.when(F.col("_ordinal") > 0, F.concat(own, F.lit("::dup"), F.col("_ordinal").cast("string"))).otherwise(own)
    return marked.withColumn(name, F.coalesce(F.when(F.col("_seed").isNotNull(), identity.stable_uid(own)), identity.stable_uid(F.uuid()))).drop("_seed", "_content", "_shared", "_ordinal")


def upsert_status(incoming: DataFrame, stored: DataFrame, key: str, content: Sequence[str]) -> DataFrame:
    """key, status (created, updated, exists) of each incoming row by content; rows only stored are `kept`."""
    side = lambda df, name: df.select(F.col(key).alias(f"{name}_key"), identity.content_hash(*[F.col(c) for c in content]).alias(f"{name}_hash"))
    both = side(incoming, "new").join(side(stored, "old"), F.col("new_key") == F.col("old_key"), "full_outer")
    status = F.when(F.col("new_key").isNull(), "kept").when(F.col("old_key").isNull(), "created").when(F.col("new_hash") == F.col("old_hash"), "exists").otherwise("updated")
    return both.select(F.coalesce("new_key", "old_key").alias(key), status.alias("status"))


def upserted(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The store after the upsert: incoming rows replace stored ones of the same key."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def save_outcomes(incoming: DataFrame, stored: DataFrame, key: str, content: Sequence[str], errors: DataFrame, links: DataFrame, mode: str = "upsert", on_duplicate: str = "error", dry_run: bool = False) -> DataFrame:
    """What saving does with each incoming row: key, status (created, updated, exists, failed, dry-run), problem (null, invalid,
    reference, duplicate). errors: id; links: id, target. Rows with an error fail; so do rows that refer to what is neither stored
    nor among the incoming rows without errors, so that the order inside a batch doesn't matter. mode `create_only` leaves stored
    rows alone and fails for them, or says that they exist if on_duplicate is `return_existing`. One row for each incoming key;
    rows of a null key are left out."""
    own = incoming.where(F.col(key).isNotNull())
    invalid = errors.select(F.col("id").alias("_id")).distinct()
    valid = own.join(invalid, F.col(key) == F.col("_id"), "left_anti")
    there = stored.select(F.col(key).alias("_there")).unionByName(valid.select(F.col(key).alias("_there")))
    dangling = links.where("target is not null").join(there, F.col("target") == F.col("_there"), "left_anti").select("id")
    troubles = invalid.select(F.col("_id").alias("_key"), F.lit(0).alias("_rank")).unionByName(dangling.select(F.col("id").alias("_key"), F.lit(1).alias("_rank"))).groupBy("_key").agg(F.min("_rank").alias("_rank"))
    status = upsert_status(own, stored, key, content).where("status <> 'kept'")
    old = F.col("status") != "created"
    refused = old & F.lit(mode == "create_only")
    problem = F.when(F.col("_rank") == 0, "invalid").when(F.col("_rank") == 1, "reference").when(refused & F.lit(on_duplicate != "return_existing"), "duplicate")
    done = F.when(refused, "exists").when(F.lit(dry_run), "dry-run").otherwise(F.col("status"))
    judged = status.join(troubles, F.col(key) == F.col("_key"), "left").select(key, done.alias("status"), problem.alias("problem"))
    return judged.withColumn("status", F.when(F.col("problem").isNotNull(), "failed").otherwise(F.col("status")))


def saved(incoming: DataFrame, stored: DataFrame, key: str, outcomes: DataFrame) -> DataFrame:
    """The store after the save: rows that were created or updated are in, all else is as it was."""
    return upserted(incoming.join(outcomes.where("status in ('created', 'updated')").select(key), key, "left_semi"), stored, key)


def promoted(staged: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """Staged rows without an error among their issues (id, severity)."""
    return staged.join(found.where("severity = 'error'").select(F.col("id").alias(key)), key, "left_anti")


def not_done(df: DataFrame, journal: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows without a successful journal entry of the same keys."""
    return df.join(journal.select(*key).distinct(), list(key), "left_anti")


def sync_plan(local: DataFrame, remote: DataFrame, key: str, checksum: str) -> DataFrame:
    """key, action: keep where checksums agree, upload where they don't or the remote lacks it, delete what only the remote has."""
    a = local.select(F.col(key).alias("_a"), F.col(checksum).alias("_ca"))
    b = remote.select(F.col(key).alias("_b"), F.col(checksum).alias("_cb"))
    action = F.when(F.col("_a").isNull(), "delete").when(F.col("_ca").eqNullSafe(F.col("_cb")) & F.col("_b").isNotNull(), "keep").otherwise("upload")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), action.alias("action"))


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows of one page in a total order; a limit of none or less gives none, a negative offset is none."""
    if limit <= 0:
        return df.limit(0)
    return df.orderBy(*order).offset(max(0, offset)).limit(limit)


def federated(**origins: DataFrame) -> DataFrame:
    """The union of stores, each row with its origin."""
    out = None
    for name, df in origins.items():
        named = df.withColumn("origin", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def overridden(inferred: DataFrame, manual: DataFrame, key: str, column: str, unknown: str = "?") -> DataFrame:
    """Manual values win unless they say that nothing is known; manual rows without an inferred one stay."""
    a = inferred.select(F.col(key).alias("_a"), F.col(column).alias("_va"))
    b = manual.select(F.col(key).alias("_b"), F.nullif(F.col(column), F.lit(unknown)).alias("_vb"))
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), F.coalesce("_vb", "_va").alias(column))


def key_index(df: DataFrame, id_column: str, keys: Sequence[Column]) -> DataFrame:
    """Every key that names a row, with its row if there is just one: key, n_ids, id (null: ambiguous)."""
    exploded = df.select(F.col(id_column).alias("_id"), F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("key"))
    return exploded.groupBy("key").agg(F.countDistinct("_id").alias("n_ids"), F.min("_id").alias("_first")).select("key", "n_ids", F.when(F.col("n_ids") == 1, F.col("_first")).alias("id"))


def merged_first(existing: DataFrame, added: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Existing entries stay as they are; of the added ones the first of each key that none of them has."""
    both = existing.withColumn("_rank", F.lit(0)).unionByName(added.withColumn("_rank", F.lit(1)))
    return first_wins(both, key, [F.col("_rank"), *order]).drop("_rank")


def first_usable(df: DataFrame, usable: Column, order: Sequence[Column], limit: int) -> DataFrame:
    """The first rows that can be imported: the limit counts those, not the rows read."""
    return page(df.where(usable), order, limit)
