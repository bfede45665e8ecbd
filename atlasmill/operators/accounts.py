"""Accounts: login lookup, tokens and their chains, follows, photos, personal exports, deletion with what hangs on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasmill.session import materialize


def login_matches(users: DataFrame, attempts: DataFrame) -> DataFrame:
    """attempts (attempt_id, name) with the users whose e-mail address or user name it is, letter case aside: two equi-joins, no OR."""
    key = F.lower("name")
    by = [attempts.join(users, key == F.lower(c)).select("attempt_id", "user_id") for c in ("email", "username")]
    return by[0].union(by[1]).distinct()


def active_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.where("revoked_at is null")


def revoke_all(tokens: DataFrame, users: DataFrame, reason: str, at: Column) -> DataFrame:
    """The token table with every active token of the users (user_id) revoked; earlier revocations stay."""
    hit = tokens.join(users.select("user_id").distinct().withColumn("_hit", F.lit(True)), "user_id", "left")
    now = F.col("_hit").isNotNull() & F.col("revoked_at").isNull()
    changed = hit.withColumn("revoked_reason", F.when(now, F.lit(reason)).otherwise(F.col("revoked_reason")))
    return changed.withColumn("revoked_at", F.when(now, at).otherwise(F.col("revoked_at"))).select(tokens.columns)


#: Tokens with a parent up to which pointers are doubled; more are taken out of their chains first.
FEW = 1 << 20


def token_chains(tokens: DataFrame, max_rounds: int = 40, few: int = FEW) -> DataFrame:
    """jti, root and depth of each token along parent_jti. A parent that is not in the table ends a chain.

    While there are more than `few` tokens with a parent, each round takes a quarter of them out, no two neighbours, and
    ties their children to their parents; so all rounds together move a fixed number of rows a token. Of the rest,
    pointers are doubled, which takes as many rounds as the logarithm of the longest chain. Then the ones taken out
    look up their parents, the last first.
    """
    start = tokens.select("jti", "parent_jti")
    known = start.select(F.col("jti").alias("parent_jti"), F.lit(True).alias("_known"))
    every = start.join(known, "parent_jti", "left").select("jti", F.coalesce(F.when(F.col("_known"), F.col("parent_jti")), "jti").alias("root"))
    every = materialize(every.withColumn("depth", (F.col("root") != F.col("jti")).cast("bigint")), "chains")
    roots, now, out = every.where("depth = 0"), every.where("depth > 0"), []

    def through(rows: DataFrame, by: DataFrame) -> DataFrame:
        """rows tied to what `by` says of their parents, and how much further up that is; those it does not know stay."""
        up = by.select(F.col("jti").alias("root"), F.col("root").alias("_next"), F.col("depth").alias("_more"))
        return rows.join(up, "root", "left").select("jti", F.coalesce("_next", "root").alias("root"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), F.col("_more").isNotNull().alias("_moved"))

    while len(out) < max_rounds and now.count() > few:
        head = [F.pmod(F.xxhash64(F.lit(len(out)), F.col(c)), F.lit(2)) == 0 for c in ("jti", "root")]
        out.append(materialize(now.where(head[0] & ~head[1]), "chains-out"))
        now = materialize(through(now.where(~(head[0] & ~head[1])), out[-1]).drop("_moved"), "chains")
    for _ in range(max_rounds):
        step = materialize(through(now, now), "chains")
        now = step.drop("_moved")
        if step.where("_moved").isEmpty():
            break
    else:
        raise RuntimeError(f"token chains did not end in {max_rounds} rounds: a token is its own ancestor")
    for rows in reversed(out):
        now = now.union(materialize(through(rows, now).drop("_moved"), "chains"))
    return roots.union(now)


def follow_counts(follows: DataFrame) -> DataFrame:
    """user_id with followers and following, from rows (follower_id, followee_id)."""
    ends = follows.select(F.explode(F.array(F.struct(F.col("follower_id").alias("user_id"), F.lit(1).alias("out")), F.struct(F.col("followee_id").alias("user_id"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    return ends.groupBy("user_id").agg(F.count_if(F.col("out") == 0).alias("followers"), F.count_if(F.col("out") == 1).alias("following"))


def approved_photos(photos: DataFrame, place_id: int, limit: int = 50) -> DataFrame:
    """A place's approved photos, newest first, 100 at most."""
    rows = photos.where((F.col("place_id") == place_id) & (F.col("status") == "approved"))
    return rows.orderBy(F.col("created_at").desc(), "photo_id").limit(min(limit, 100))


# The largest upload, and how the images that may be uploaded begin (hex).
UPLOAD_BYTES = 5 * 1024 * 1024
IMAGE_STARTS = {"image/jpeg": "FFD8FF", "image/png": "89504E470D0A1A0A"}


def upload_type(data: Column) -> Column:
    """Image type of uploaded bytes by their first ones, null for anything else."""
    head = F.hex(F.substring(data, 1, 8))
    return F.coalesce(*[F.when(head.startswith(start), kind) for kind, start in IMAGE_STARTS.items()])


def upload_error(data: Column, declared: Column, most: int = UPLOAD_BYTES) -> Column:
    """Why an upload is refused: empty, too_large (over `most` bytes), unsupported (bytes of no known image), mismatch (not what was declared); null if it is fine."""
    kind = upload_type(data)
    return (
        F.when(data.isNull() | (F.octet_length(data) == 0), "empty").when(F.octet_length(data) > most, "too_large")
        .when(kind.isNull(), "unsupported").when(~kind.eqNullSafe(declared), "mismatch")
    )


#: Bytes of input files for each partition in which documents of users are put together.
EXPORT_BYTES = 8 << 20


def _input_bytes(tables: list[DataFrame]) -> int:
    spark, total = tables[0].sparkSession, 0
    for file in {f for df in tables for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


def export_users(users: DataFrame, relations: dict[str, tuple[DataFrame, str] | tuple[DataFrame, str, tuple[str, ...]]]) -> DataFrame:
    """user_id and one JSON document per user: the user's own columns and each relation's rows, newest first.

    relations: name to rows with user_id, their order column, and the columns that are shown (all but user_id). One union
    and one shuffle bring rows to their user, as they are: relations of one DataFrame travel once, and rows become JSON
    where they have arrived. The number of partitions follows the bytes of the input.
    """
    tables = list({id(df): df for df, *_ in relations.values()}.values())
    kinds = [df.select(F.struct(*[c for c in df.columns if c != "user_id"]).alias("r")).schema["r"].dataType for df in tables]
    sent = None
    for i, df in enumerate(tables):
        rows = [F.struct(*[c for c in df.columns if c != "user_id"]) if i == k else F.lit(None).cast(kind) for k, kind in enumerate(kinds)]
        part = df.select("user_id", F.lit(i).cast("byte").alias("t"), *[r.alias(f"r{k}") for k, r in enumerate(rows)])
        sent = part if sent is None else sent.union(part)
    there = sent.repartition(max(sent.sparkSession.sparkContext.defaultParallelism, -(-_input_bytes(tables) // EXPORT_BYTES)), "user_id")
    entries = None
    for i, df in enumerate(tables):
        mine = []
        for n, (name, (own, order, *shown)) in enumerate(relations.items()):
            if own is df:
                fields = shown[0] if shown else [c for c in df.columns if c != "user_id"]
                row = F.col(f"r{i}")
                mine.append(F.struct(F.lit(n).alias("relation"), row[order].cast("string").alias("at"), F.to_json(F.struct(*[row[c].alias(c) for c in fields])).alias("body")))
        entries = F.when(F.col("t") == i, F.array(*mine)) if entries is None else entries.when(F.col("t") == i, F.array(*mine))
    parts = there.select("user_id", F.explode(entries).alias("e"))
    held = parts.groupBy("user_id").agg(F.sort_array(F.collect_list("e"), False).alias("rows"))
    full = users.join(held, "user_id", "left")

    def listed(n: int, name: str) -> Column:
        mine = F.transform(F.filter(F.coalesce("rows", F.expr("array()").cast("array<struct<relation:int,at:string,body:string>>")), lambda r: r["relation"] == n), lambda r: r["body"])
        return F.concat(F.lit(f',"{name}":['), F.array_join(mine, ","), F.lit("]"))

    user = F.to_json(F.struct(*users.columns))
    return full.select("user_id", F.concat(F.lit('{"user":'), user, *[listed(n, name) for n, name in enumerate(relations)], F.lit("}")).alias("document"))


def delete_users(gone: DataFrame, tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]], null_out: dict[str, str]) -> dict[str, DataFrame]:
    """All tables after the users in `gone` (user_id) went: keys names the columns that tie a row to a user, null_out the
    tables that keep their rows with that column null. Any number of users costs one join a table."""
    ids, out = gone.select("user_id").distinct(), {}
    for name, df in tables.items():
        if name in null_out:
            c = null_out[name]
            marked = df.join(ids.select(F.col("user_id").alias(c), F.lit(True).alias("_gone")), c, "left")
            out[name] = marked.withColumn(c, F.when(F.col("_gone").isNull(), F.col(c))).select(df.columns)
            continue
        for c in keys.get(name, ("user_id",)):
            df = df.join(ids.select(F.col("user_id").alias(c)), c, "left_anti").select(df.columns)
        out[name] = df
    return out


def deletion_audit(gone: DataFrame, users: DataFrame, counts: DataFrame) -> DataFrame:
    """The audit row of each deleted user: name, domain of the address, and how many rows of each relation went with it."""
    relations = [c for c in counts.columns if c != "user_id"]
    d = gone.select("user_id").distinct().join(users.select("user_id", "username", "email"), "user_id").join(counts, "user_id", "left")
    domain = F.when(F.contains("email", F.lit("@")), F.regexp_extract("email", "(?s)^[^@]*@(.*)$", 1))
    return d.select("user_id", F.lit("user.delete").alias("action"), "username", domain.alias("email_domain"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in relations])


def verified_backfill(users: DataFrame, at: Column) -> DataFrame:
    """email_verified_at filled where it is null; verified users keep their time."""
    return users.withColumn("email_verified_at", F.coalesce("email_verified_at", at))
