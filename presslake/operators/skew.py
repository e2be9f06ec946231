"""Membership joins that stay balanced when one key holds a large share of the rows.

With adaptive skew handling on, as it is by default, Spark splits the partitions of a frequent key at run time, which costs no pass of its
own, and the plain join is used. Without it, a sketch pass finds hot keys first. A key is hot when it holds more rows than a mean task gets, that is a share above 1/partitions of the probing side. Hot keys
are found in one column-pruned pass with bounded state. Their rows are spread over as many salts as
their share asks for, and the few matching rows of the other side are repeated once per salt, so the
result is exactly that of the plain join. Both limits come from the measured share and the number of shuffle
partitions; they are the same at every size. Without hot keys the plain join is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Counters that the sketch keeps for each key that it is to find: it errs by less than a fifth of a mean task.
COUNTERS = 16


def tasks_of(df: DataFrame) -> int:
    """Over how many tasks a shuffle of `df` is dealt."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hot_hashes(df: DataFrame, *key_sets: list[str]) -> list[dict[int, int]]:
    """Per set of key columns, the hash and the number of salts of every hot key of `df`.

    There are fewer hot keys than shuffle partitions, so what the driver holds is bounded by their number. Salts are
    powers of two and leave at most half a mean task to each. Both sides of a join must use the same
    list, so it is fixed here and not left in the plan; it decides the balance of the join only, never its result.
    """
    tasks = tasks_of(df)
    names = [f"__h{i}" for i in range(len(key_sets))]
    hashed = df.select(*[F.xxhash64(*keys).alias(name) for name, keys in zip(names, key_sets)])
    found = hashed.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.expr(f"approx_top_k({name}, {tasks}, {min(COUNTERS * tasks, 1_000_000)})").alias(name) for name in names],
    ).head()
    mean = found["total"] / tasks
    return [{key: 2 ** int(min(2 * n / mean, n)).bit_length() for key, n in found[name] if n > max(1, mean)} for name in names]


def _salts(keys: list[str], hot: dict[int, int]) -> Column:
    """Number of salts of a row: one, or that of its hot key. Keys of equal number are tested as one set."""
    number, hashed = F.lit(1), F.xxhash64(*keys)
    for salts in sorted(set(hot.values())):
        number = F.when(hashed.isin([k for k, n in hot.items() if n == salts]), salts).otherwise(number)
    return number


def with_salt(df: DataFrame, keys: list[str], hot: dict[int, int], spread: list[str], out: str = "__salt") -> DataFrame:
    """Probing side: rows of a hot key get one of its salts, all other rows get 0.

    The number comes from row data, never from a random source, so a recomputed task repeats it.
    """
    return df.withColumn(out, F.pmod(F.xxhash64(*spread), _salts(keys, hot)).cast("int"))


def repeat_salts(df: DataFrame, keys: list[str], hot: dict[int, int], out: str = "__salt") -> DataFrame:
    """Other side: one copy per salt for a hot key, one copy otherwise. `df` has unique keys."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), _salts(keys, hot) - 1)))


def adaptive(df: DataFrame) -> bool:
    """Whether Spark splits skewed join partitions at run time."""
    conf = df.sparkSession.conf
    return all(conf.get(f"spark.sql.adaptive.{name}", "true").lower() == "true" for name in ("enabled", "skewJoin.enabled"))


def membership_join(left: DataFrame, right: DataFrame, keys: list[str], how: str,
                    spread: list[str] | None = None) -> DataFrame:
    """`left` joined with the distinct `keys` of `right`; `how` is left_semi, left_anti or left.

    `spread` names columns that differ between rows of one key, normally a unique row id; all other
    columns are used when it is not given. A null key matches nothing.
    """
    # The distinct combines copies before its shuffle.
    members = right.dropna(subset=keys)
    members = members.distinct() if how != "left" else members
    # The probing side is the left one of a semi, anti or left join, which adaptive execution may split.
    hot = {} if adaptive(left) else hot_hashes(left, keys)[0]
    added = [c for c in members.columns if c not in keys] if how == "left" else []
    if not hot:
        return left.join(members, keys, how).select(*left.columns, *added)
    spread = spread or [c for c in left.columns if c not in keys] or keys
    salted = with_salt(left, keys, hot, spread)
    joined = salted.join(repeat_salts(members, keys, hot), [*keys, "__salt"], how)
    return joined.select(*left.columns, *added)


def semi_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str] | None = None) -> DataFrame:
    return membership_join(left, right.select(*keys), keys, "left_semi", spread)


def anti_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str] | None = None) -> DataFrame:
    return membership_join(left, right.select(*keys), keys, "left_anti", spread)


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str] | None = None) -> DataFrame:
    """Left join with a table that has at most one row per key."""
    return membership_join(left, right, keys, "left", spread)
