"""From a question to its answer: planning, access, vector seeds, and putting hits together."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import fixed
from millrace.functions import names as N
from millrace.functions import text as T
from millrace.operators import ranking as K
from millrace.operators import relational as J

MOST, DEFAULT, SEEDS, ABSTRACT, RELATIONS = 50, 10, 30, 200, 3  # fixed values: results of a query, at most and by default, seeds, characters, edges
NOWHERE = "__inaccessible__"


@dataclass(frozen=True)
class Scope:
    """Who asks: an account, a user, an agent, and the owner spaces that may be seen (all where none is named)."""

    account: str
    user: str = ""
    agent: str = ""
    spaces: tuple[str, ...] = field(default=())

    @property
    def agents(self) -> list[str]:
        named = sorted({s.split(":", 1)[1] for s in self.spaces if s.startswith("agent:") and s.split(":", 1)[1]})
        return named or [self.agent] * bool(self.agent)


def root_uris(kind: str | None, scope: Scope) -> list[str]:
    """Where the records of a context type begin; without a type all roots a scope has."""
    base = f"ctx://{scope.account}"
    memories = [f"{base}/users/{scope.user}/memories/"]
    of_agents = [f"{base}/agents/{a}/memories/" for a in scope.agents]
    skills, resources = [f"{base}/agents/{a}/skills/" for a in scope.agents], [f"{base}/resources/"]
    return {"MEMORY": memories + of_agents, "RESOURCE": resources, "SKILL": skills, None: memories + resources + of_agents + skills}.get(kind.upper() if kind else None, [])


def owner_spaces(kind: str, scope: Scope) -> list[str] | None:
    """The owner spaces a query of a type may see; None for all. Skills belong to agents, and to none that is not visible."""
    if kind != "SKILL":
        return list(scope.spaces) or None
    own = f"agent:{scope.agent}" if scope.agent else ""
    if own and (not scope.spaces or own in scope.spaces):
        return [own]
    return [s for s in scope.spaces if s.startswith("agent:")] or [NOWHERE]


def plan(text: str, scope: Scope, *, top_k: int = 0, categories: Sequence[str] = ()) -> dict[str, object]:
    """The cleaned text of a question with its type, intent, owner spaces and number of results."""
    clean = reduce(lambda t, p: re.sub(p, "", t), fixed.QUERY_NOISE, text or "").strip()
    if not clean:
        raise ValueError("a question needs words")
    if (n := top_k or DEFAULT) > MOST:
        raise ValueError(f"at most {MOST} results")
    shown = [k for k, p in fixed.QUERY_TYPES.items() if re.search(p, clean)]
    kind = shown[0] if len(shown) == 1 else fixed.DEFAULT_QUERY_TYPE
    intent = next((k for k, ps in fixed.INTENTS.items() if any(re.search(p, clean) for p in ps)), fixed.DEFAULT_INTENT)
    return {"text": clean, "kind": kind, "intent": intent, "top_k": n, "categories": list(categories), "owner_spaces": owner_spaces(kind, scope), "roots": root_uris(kind, scope)}


def accessible(uri: Column, scope: Scope) -> Column:
    """Whether a scope may touch an address: its account, and its own user or agent; what is no address is closed."""
    p = T.uri_parts(uri)
    own = F.when(p["scope"] == "users", p["owner"] == scope.user).when(p["scope"] == "agents", p["owner"] == scope.agent).otherwise(True)
    return F.coalesce((p["account"] == scope.account) & ((p["owner"] == "") | own), F.lit(False))


def readable(uri: Column, scope: Scope) -> Column:
    """Whether a scope may read: other accounts' addresses, other users' and, for an agent, other agents' are closed."""
    base = f"ctx://{scope.account}/"
    closed = uri.startswith("ctx://") & ~uri.startswith(base)
    closed |= uri.startswith(f"{base}users/") & ~uri.startswith(f"{base}users/{scope.user}/")
    if scope.agent:
        closed |= uri.startswith(f"{base}agents/") & ~uri.startswith(f"{base}agents/{scope.agent}/")
    return F.coalesce(~closed, F.lit(False))


def hits_of(records: DataFrame, score: Column) -> DataFrame:
    """Records as hits: the beginning of the text as abstract, defaults where a field is missing."""
    none = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return records.select(
        "id", "uri", "level", score.alias("score"), "parent_uri", none("context_type", ""), none("category", ""), none("owner_space", ""),
        F.substring(F.coalesce("text", F.lit("")), 1, ABSTRACT).alias("abstract"), none("has_overview", False), none("has_content", False), none("active_count", 0),
    )


def vector_seeds(records: DataFrame, vector: Sequence[float], scope: Scope, *, kind: str | None = None, spaces: Sequence[str] | None = None, categories: Sequence[str] = (), n: int = SEEDS) -> DataFrame:
    """The ``n`` most similar records of a scope as hits with their rank; each id counts once, its latest row. Ties go to the smaller id."""
    rows = J.scoped(records, scope.account, spaces)
    rows = J.matching(rows, level=[0, 1, 2], **({"context_type": kind} if kind else {}), **({"category": list(categories)} if categories else {}))
    once = J.latest(rows, ["id"], [F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(1 << 62))), F.coalesce("active_count", F.lit(-1))])
    v = F.array(*[F.lit(float(x)) for x in vector])
    return K.top(hits_of(once, F.round(K.cosine(F.col("embedding"), v), 9)), n, "id")


def first_seen(lists: Sequence[DataFrame], key: str = "uri") -> DataFrame:
    """The lists of several queries one behind the other, each address where it was first seen: ``(..., query, rank)``."""
    both = reduce(DataFrame.unionByName, [x.withColumn("query", F.lit(i)) for i, x in enumerate(lists)])
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("query", "rank")).alias("r")).select(key, "r.*")


def leaves(hits: DataFrame) -> DataFrame:
    """The hits that are leaves; what a search falls back to where no folder was hit."""
    return hits.where("level = 2")


def assembled(hits: DataFrame, n: int, *, contents: DataFrame | None = None, filled: int = 0, edges: DataFrame | None = None) -> DataFrame:
    """``(position, uri, score, category, owner_space, abstract, content, relations)``: the ``n`` best leaves.

    An address counts once, with its best score; the first ``filled`` get their text from ``contents(uri, content)``, and
    each gets its three heaviest edges from ``edges``. Ties go to the smaller address.
    """
    best = leaves(hits).groupBy("uri").agg(F.max_by(F.struct("score", "category", "owner_space", "abstract"), F.struct("score", "abstract")).alias("r")).select("uri", "r.*")
    top = K.top(best, n, "uri").withColumnRenamed("rank", "position")
    if contents is not None:
        text = contents.groupBy("uri").agg(F.min("content").alias("content"))
        top = top.join(text, "uri", "left").withColumn("content", F.when(F.col("position") <= filled, F.col("content")))
    else:
        top = top.withColumn("content", F.lit(None).cast("string"))
    if edges is None:
        return top.withColumn("relations", F.array().cast("array<string>"))
    three = J.top_edges(edges.join(top.select(F.col("uri").alias("from_uri")), "from_uri", "left_semi"), RELATIONS)
    told = three.groupBy(F.col("from_uri").alias("uri")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "to_uri"))), lambda e: e["to_uri"]).alias("relations"))
    return top.join(told, "uri", "left").withColumn("relations", F.coalesce("relations", F.array().cast("array<string>")))


def of_candidates(hits: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Hits whose address contains the identity of one of a bounded list of paths; all where the list is empty."""
    if not paths:
        return hits
    marks = hits.sparkSession.createDataFrame([(p,) for p in paths], "p string").select(F.collect_set(N.identity(F.col("p")))).first()[0]
    return hits.where(reduce(lambda a, b: a | b, [F.col("uri").contains(m) for m in sorted(marks)]))
