"""Write planning, budgets, retries, sessions and path tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.functions import fixed


def plan_writes(candidates: DataFrame, existing: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """``(keys, action)``: create what is new, skip what is equal, merge the rest."""
    have = existing.groupBy(*keys).agg(F.max(digest).alias("old"), F.lit(True).alias("there"))
    action = F.when(F.col("there").isNull(), "create").when(F.col("old").eqNullSafe(F.col(digest)), "skip").otherwise("merge")
    return candidates.join(have, list(keys), "left").select(*keys, action.alias("action"))


def merged_text(old: Column, new: Column) -> Column:
    """The old text, a rule and the new one; either alone where the other is blank."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(blank(old), new).when(blank(new), old).otherwise(F.concat(old, F.lit("\n\n---\n\n"), new))


def write_key(uri: Column, action: Column, session: Column, digest: Column) -> Column:
    """The fingerprint under which a repeated write is known."""
    return F.sha2(F.concat_ws(":", uri, action, session, digest), 256)


def allocate(total: Column, tiers: dict[str, tuple[int, int, bool, bool]] = fixed.BUDGET_TIERS) -> dict[str, Column]:
    """Tokens of each tier: guaranteed least shares first, then up to each tier's most in order, then the rest to the one that expands."""
    left, got = F.greatest(total, F.lit(0)), {}
    for name, (least, _, kept, _) in tiers.items():
        got[name] = F.least(F.lit(least), left) if kept else F.lit(0)
        left = left - got[name]
    for name, (_, most, _, _) in tiers.items():
        more = F.least(F.greatest(F.lit(most) - got[name], F.lit(0)), left)
        got[name], left = got[name] + more, left - more
    for name, (*_, grows) in tiers.items():
        if grows:
            got[name] = got[name] + left
            break
    return got


def retry_decision(ok: Column, retries: Column, now_ms: Column, most: int = 5) -> Column:
    """struct(outcome, next_ms): done, dead after ``most`` retries, else retry with doubling pauses up to a minute."""
    wait = F.least(F.lit(60_000), (1000 * F.pow(F.lit(2), F.least(retries, F.lit(16)))).cast("long"))
    outcome = F.when(ok, "done").when(retries >= most, "dead").otherwise("retry")
    return F.struct(outcome.alias("outcome"), F.when(~ok & (retries < most), now_ms + wait).alias("next_ms"))


def compress_points(turns: DataFrame, most_turns: int = 10, most_tokens: int = 10_000) -> DataFrame:
    """``(session, seq, compress)``: true at the turn at which a session has gathered ``most_turns`` turns or
    ``most_tokens`` tokens since the last such turn. ``turns(session, seq, tokens)``; a session is folded as a sorted
    stream of batches, with two counters in memory."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, n, used = object(), 0, 0
        for f in frames:
            out = []
            for s, t in zip(f["session"].to_numpy(), f["tokens"].to_numpy()):
                if s != session:
                    session, n, used = s, 0, 0
                n, used = n + 1, used + int(t)
                out.append(n >= most_turns or used >= most_tokens)
                if out[-1]:
                    n = used = 0
            yield pd.DataFrame({"session": f["session"], "seq": f["seq"], "compress": out})

    kind = turns.schema["session"].dataType.simpleString()
    rows = turns.select("session", F.col("seq").cast("long").alias("seq"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")).where("session IS NOT NULL")
    return rows.repartition("session").sortWithinPartitions("session", "seq").mapInPandas(fold, f"session {kind}, seq long, compress boolean")


def sessions_by(rows: DataFrame, key: str, order: Sequence[str], starts: Column, targets: Column, most: int = 4) -> DataFrame:
    """Each starting event of a key opens a session; the next ``most`` target events belong to it: ``(..., session, position)``."""
    w = W.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("session", F.sum(starts.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where(targets).where("session > 0")
    return marked.withColumn("position", F.row_number().over(W.partitionBy(key, "session").orderBy(*order))).where(F.col("position") <= most)


def children_of(paths: DataFrame, folder: str) -> DataFrame:
    """Direct children of a folder in a table of paths, as names, each once, folders marked."""
    start = folder.rstrip("/") + "/"
    rest = F.substring("path", len(start) + 1, 1 << 30)
    inside = paths.where(F.col("path").startswith(start) & (rest != ""))
    return inside.groupBy(F.substring_index(rest, "/", 1).alias("name")).agg(F.max(F.instr(rest, "/") > 0).alias("is_folder"))


def renamed(path: Column, old: str, new: str) -> Column:
    """A path after its folder ``old`` became ``new``; only whole path parts count."""
    o = old.rstrip("/")
    return F.when((path == o) | path.startswith(o + "/"), F.concat(F.lit(new.rstrip("/")), F.substring(path, len(o) + 1, 1 << 30))).otherwise(path)


def mount_of(path: Column, mounts: Sequence[str]) -> Column:
    """The longest mount point that is the path or a whole-part prefix of it."""
    found = F.lit(None).cast("string")
    for m in sorted(mounts, key=len):
        found = F.when((path == m) | path.startswith(m.rstrip("/") + "/"), m).otherwise(found)
    return found
