"""Sharding through a permutation-filled lookup table: shards take turns claiming slots of a
prime-sized table, each by its own order of preference; a key's hash names its slot.

The table depends on the shards' names and its size only, and is built once from these parameters.
Every row then finds its shard by one lookup in the broadcast table: no shuffle, and rows of a hot
key are placed where they are. When a shard is added or leaves, few other slots change hands.
Only DataFrame functions are used on rows.
"""

from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEX_DIGITS = 15  # of an MD5 digest: 60 bits, so that the number is a positive long
TABLE_SIZE = 8191  # prime; a hundred slots or more for each shard keep shares within about 1 %
MAX_TABLE = 1_000_003


def _number(text: str) -> int:
    return int(md5(text.encode()).hexdigest()[:HEX_DIGITS], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot, the place in ``shards`` of its owner.

    A shard prefers slots offset, offset + skip, offset + 2 skip ... modulo the size; as the size is
    prime, this order visits each slot once. Shards must be distinct and at most as many as slots."""
    if not _is_prime(size) or size > MAX_TABLE:
        raise ValueError(f"the size must be a prime up to {MAX_TABLE}, not {size}")
    if not shards or len(set(shards)) < len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one and at most as many as slots")
    wish = [_number(f"offset:{s}") % size for s in shards]
    skip = [_number(f"skip:{s}") % (size - 1) + 1 for s in shards] if size > 2 else [1] * len(shards)
    owner = [-1] * size
    for claim in range(size):
        turn = claim % len(shards)
        while owner[wish[turn]] >= 0:
            wish[turn] = (wish[turn] + skip[turn]) % size
        owner[wish[turn]] = turn
    return owner


def lookup_table(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """The table as rows: slot, shard."""
    owners = F.split(F.lit(",".join(map(str, fill_table(shards, size)))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    slots = spark.range(1).select(F.posexplode(owners).alias("slot", "owner"))
    return slots.select("slot", F.get(names, F.col("owner").cast("int")).alias("shard"))


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("long") % size).cast("int")


def place(rows: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """All rows and columns with ``slot`` and ``shard`` (they replace columns of these names).

    Equal keys always meet in one shard. A null key is placed like an empty one. Repeated rows stay.
    No rows give no rows. The broadcast table has ``size`` rows, at most ``MAX_TABLE``."""
    if key in ("slot", "shard"):
        raise ValueError("the key must have another name than slot and shard")
    table = F.broadcast(lookup_table(rows.sparkSession, shards, size))
    kept = [c for c in rows.columns if c not in ("slot", "shard")]
    keyed = rows.select(*[F.col(f"`{c}`") for c in kept], slot_of(F.col(f"`{key}`"), size).alias("slot"))
    return keyed.join(table, "slot").select(*[F.col(f"`{c}`") for c in kept], "slot", "shard")


def write_shards(placed: DataFrame, path: str, files: int = 8) -> None:
    """A folder for each shard; the rows of one shard are spread over ``files`` tasks by a hash of
    their contents, so that a hot key makes no large task."""
    spread = F.pmod(F.xxhash64(*[c for c, t in placed.dtypes if not t.startswith("map")]), F.lit(files))
    placed.repartition("shard", spread).write.partitionBy("shard").parquet(path)
