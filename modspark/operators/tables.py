"""Row-set operators: dedup, sampling, rescue, splits, inserts, lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspark import constants as k
from modspark.operators.ordinal import hash_bucket, ordinal, seeded_hash, smallest
from modspark.session import broadcast_if_small


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """One row per key, the one with the smallest ``order`` (unique per row).

    The minimum is combined map-side, so a text repeated in a third of all rows is
    one row per task at the shuffle.  The table itself is then filtered by a semi join
    on the unique order column, which cannot skew.
    """
    firsts = df.groupBy(F.sha2(key, 256).alias("_h")).agg(F.min(order).alias(order))
    return df.join(firsts.select(order), order, "left_semi")


def sample_n(df: DataFrame, n: int, seed: int, row_id: str) -> DataFrame:
    """Reproducible sample: the ``n`` rows first in seeded hash order of a unique id."""
    h = seeded_hash(seed, F.col(row_id))
    return smallest(df, n, h, hash_bucket(h))


def shuffled(df: DataFrame, seed: int, row_id: str) -> DataFrame:
    return df.orderBy(seeded_hash(seed, F.col(row_id)))


def is_rare(labels: Sequence[str] = tuple(k.RARE_LABELS)) -> Column:
    """Any of the labels is 1; a missing label counts as 0."""
    return reduce(
        lambda a, b: a | b, [F.coalesce(F.col(t) == 1, F.lit(False)) for t in labels]
    )


def rescue_rare(
    df: DataFrame, cap: int, seed: int, row_id: str, rare: Column | None = None
) -> DataFrame:
    """Keep every rare row and fill up to ``cap`` with a sample of the rest.

    With ``cap`` rows or fewer the table is returned whole.  Both counts come from one
    aggregate row used as a scalar, so nothing is collected.
    """
    rare = is_rare() if rare is None else rare
    marked = df.withColumn("_rare", rare)
    h = seeded_hash(seed, F.col(row_id))
    counts = marked.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_rare").alias("n_rare")
    ).select(
        F.when(F.col("n") <= cap, F.col("n"))
        .otherwise(F.greatest(F.lit(0), F.lit(cap) - F.col("n_rare")))
        .alias("fill")
    )
    quota = marked.filter(~F.col("_rare")).groupBy("_rare").agg(F.count(F.lit(1)).alias("_all"))
    quota = quota.select("_rare", F.least(F.col("_all"), counts.scalar()).alias("quota"))
    rest = smallest(
        marked.filter(~F.col("_rare")), "quota", h, hash_bucket(h), keys=["_rare"], quotas=quota
    )
    return marked.filter("_rare").unionByName(rest).drop("_rare")


def stratified_split(
    df: DataFrame, strata: Sequence[str], seed: int, row_id: str, folds: int = 10
) -> DataFrame:
    """Train/val/test by label combination: fold 0 is test, fold 1 is val.

    The fold is the position in seeded hash order within the stratum, modulo
    ``folds``, so every combination is divided as evenly as its size allows.
    """
    h = seeded_hash(seed, F.col(row_id))
    placed = ordinal(df, h, hash_bucket(h), keys=list(strata), name="_pos")
    fold = (F.col("_pos") % folds).cast("int")
    return (
        placed.withColumn("fold", fold)
        .withColumn(
            "split", F.when(fold == 0, "test").when(fold == 1, "val").otherwise("train")
        )
        .drop("_pos")
    )


def kfold(df: DataFrame, folds: int, seed: int, row_id: str) -> DataFrame:
    h = seeded_hash(seed, F.col(row_id))
    placed = ordinal(df, h, hash_bucket(h), name="_pos")
    return placed.withColumn("fold", (F.col("_pos") % folds).cast("int")).drop("_pos")


def ordered_split(df: DataFrame, order: Column, bucket: Column, train: float) -> DataFrame:
    """First share of the rows in ``order`` is train, the rest val."""
    placed = ordinal(df, order, bucket, name="_pos")
    total = df.agg(F.count(F.lit(1))).scalar()
    cut = F.floor(F.lit(train) * total)
    return placed.withColumn(
        "split", F.when(F.col("_pos") < cut, "train").otherwise("val")
    ).drop("_pos")


def hash_split(df: DataFrame, seed: int, row_id: str, train: float) -> DataFrame:
    """Row-local random split: no shuffle, stable under growth of the table."""
    h = F.conv(F.substring(seeded_hash(seed, F.col(row_id)), 1, 7), 16, 10).cast("long")
    return df.withColumn(
        "split", F.when(h < int(train * 16**7), "train").otherwise("val")
    )


def class_split(
    df: DataFrame, label: str, seed: int, row_id: str, train: float
) -> DataFrame:
    """Random split that keeps the share within every class."""
    h = seeded_hash(seed, F.col(row_id))
    placed = ordinal(df, h, hash_bucket(h), keys=[label], name="_pos")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumnRenamed(label, "_label")
    joined = placed.join(
        broadcast_if_small(sizes, 10_000), F.col(label).eqNullSafe(F.col("_label"))
    )
    cut = F.floor(F.lit(train) * F.col("_n"))
    return joined.withColumn(
        "split", F.when(F.col("_pos") < cut, "train").otherwise("val")
    ).drop("_pos", "_n", "_label")


def resample_mix(
    df: DataFrame, group: str, shares: Mapping[str, float], seed: int, row_id: str
) -> DataFrame:
    """Largest sample whose groups stand in the wanted shares.

    The scarcest group sets the total; every group then gives ``floor(total * share)``
    rows in seeded hash order. A wanted group that has no row makes the total 0.
    """
    shares = {g: v for g, v in shares.items() if v > 0}
    wanted = df.filter(F.col(group).isin(list(shares)))
    share = F.create_map(*[F.lit(v) for kv in shares.items() for v in kv])
    sizes = wanted.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "share", F.element_at(share, F.col(group))
    )
    all_there = F.count(F.lit(1)) == len(shares)
    total = sizes.agg(F.when(all_there, F.floor(F.min(F.col("n") / F.col("share")))).otherwise(0)).scalar()
    quotas = sizes.withColumn("quota", F.floor(total * F.col("share") + F.lit(1e-9)))
    h = seeded_hash(seed, F.col(row_id))
    return smallest(wanted, "quota", h, hash_bucket(h), keys=[group], quotas=quotas)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Existing rows plus the first incoming row of every new key."""
    firsts = incoming.groupBy(key).agg(F.min(order).alias(order))
    fresh = incoming.join(firsts, [key, order], "left_semi").join(
        existing.select(key), key, "left_anti"
    )
    return existing.unionByName(fresh)


def active_only(facts: DataFrame, users: DataFrame, fact_key: str, user_key: str, active: Column) -> DataFrame:
    """Rows of users that exist and are active.  AQE splits a hot user on the fact side."""
    ids = users.filter(active).select(F.col(user_key).alias("_u")).distinct()
    return facts.join(ids, F.col(fact_key) == F.col("_u"), "left_semi")


def find_users(requests: DataFrame, users: DataFrame, request_key: str, user_key: str, active: Column) -> DataFrame:
    """Active user of every request by lower-cased e-mail (or id); unknown and inactive
    users give no row."""
    known = users.filter(active).withColumn("_key", F.lower(F.col(user_key).cast("string")))
    asked = requests.withColumn("_key", F.lower(F.col(request_key).cast("string")))
    return asked.join(known, "_key").drop("_key")


def batch_messages(requests: DataFrame, texts: str = "texts", position: str = "position", text: str = "text") -> DataFrame:
    """One row per text of an array request; the position aligns results with inputs."""
    others = [c for c in requests.columns if c != texts]
    return requests.select(*others, F.posexplode(texts).alias(position, text))


def align_predictions(a: DataFrame, b: DataFrame, row_id: str) -> DataFrame:
    """Two models side by side; a full outer join shows rows one of them misses."""
    left = a.select(row_id, *[F.col(c).alias(f"a_{c}") for c in a.columns if c != row_id])
    right = b.select(row_id, *[F.col(c).alias(f"b_{c}") for c in b.columns if c != row_id])
    return left.join(right, row_id, "full_outer")


def stack_features(tables: Sequence[DataFrame], row_id: str, column: str = "features") -> DataFrame:
    """Concatenate the arrays of several models per row id (inner joins)."""
    parts = [t.select(row_id, F.col(column).alias(f"_f{i}")) for i, t in enumerate(tables)]
    joined = reduce(lambda x, y: x.join(y, row_id), parts)
    return joined.select(
        row_id, F.concat(*[F.col(f"_f{i}") for i in range(len(parts))]).alias(column)
    )


def augment(df: DataFrame, text: str, copies: int, pattern: str = " [room-id:{}]") -> DataFrame:
    """``copies`` variants per row: variant 0 as is, the others with a counter suffix.

    The variants come from a generator over a literal sequence, row by row.
    """
    before, after = pattern.split("{}")
    out = df.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    suffix = F.concat(F.lit(before), F.col("variant").cast("string"), F.lit(after))
    return out.withColumn(
        text, F.when(F.col("variant") == 0, F.col(text)).otherwise(F.concat(F.col(text), suffix))
    )


def latest_by_id(updates: DataFrame, key: str, seq: str, column: str, map_column: str) -> DataFrame:
    """Last status per id and the maps merged in sequence order, later values winning.

    Map entries are reduced to the newest per (id, entry) before they are put together,
    so a message with very many updates never becomes one long list.
    """
    status = updates.groupBy(key).agg(F.max_by(column, seq).alias(column))
    entries = (
        updates.select(key, seq, F.explode(map_column).alias("_name", "_value"))
        .groupBy(key, "_name")
        .agg(F.max_by("_value", seq).alias("_value"))
        .groupBy(key)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_name", "_value")))).alias(map_column))
    )
    return status.join(entries, key, "left")


def assemble_chunks(chunks: DataFrame, key: str, seq: str, chunk: str, name: str = "text", measures: Mapping[str, Column] | None = None) -> DataFrame:
    """Chunks of each message in sequence order as one string; ``measures`` are aggregates of the same exchange."""
    parts = F.array_sort(F.collect_list(F.struct(seq, chunk)))
    return chunks.groupBy(key).agg(
        F.array_join(F.transform(parts, lambda p: p[chunk]), "").alias(name), *[m.alias(n) for n, m in (measures or {}).items()]
    )
