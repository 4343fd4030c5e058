"""Secret scan with multipart credential linking; DataFrame functions only.

Base spans come from three patterns (assign, access, hex).  Weak candidates, which alone mean little, come from three more:
identifiers (``weak_id``), long mixed strings (``weak_secret``) and hosts (``endpoint``).  Parts of one text are interval-joined:
positions are binned by the scope's width, extents of each role are aggregated per (text, bin), and a part meets at most the
extents of three bins, never other parts one by one.  A weak identifier is reported if a secret starts within
``scope`` characters of it, a weak secret if an identifier does, an endpoint if both do.  Base spans are always reported.  A weak
candidate that overlaps a base span is none.

Spark has no function for the positions of all matches; they are running sums over the lengths of the matches and of the
pieces between them, as rows of the texts that match at all.

Defined results: a null or empty text has no spans (and the hash of the empty string); rows that repeat id and text
repeat the result; a null id is a text of its own; equal starts are ordered by kind as listed in ``KINDS``; offsets count code points, the
end is exclusive; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skewlens.llm.common import cut, text_of

#: kind, role, pattern, group whose length counts, least length.  Fixed values of the contract: the first three.
KINDS = [
    ("assign", "secret", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "identifier", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", "secret", r"[0-9a-f]{24,}", 0, 24),
    ("weak_id", "identifier", r"""(?i)(access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([a-z0-9_.@-]+)""", 2, 3),
    ("weak_secret", "secret", r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}", 0, 32),
    ("endpoint", "endpoint", r"(?i)https?://[a-z0-9.-]+(:[0-9]+)?|[a-z0-9-]+\.(amazonaws|azure|googleapis)\.com", 0, 8),
]
BASE = 3


def _found(rows: DataFrame) -> DataFrame:
    """(__sc_id, __sc_key, found): the matches of all kinds as (kind, number, gap before, length, long enough)."""
    found = rows.select("*", *[F.regexp_extract_all("__sc_text", F.lit(p), F.lit(0)).alias(f"m{k}") for k, (_, _, p, _, _) in enumerate(KINDS)])
    for k, (_, _, pattern, group, _) in enumerate(KINDS):
        some = F.size(f"m{k}") > 0
        found = found.withColumn(f"g{k}", F.when(some, F.slice(F.split("__sc_text", pattern, -1), F.lit(1), F.size(f"m{k}"))))
        found = found.withColumn(f"v{k}", F.when(some, F.regexp_extract_all("__sc_text", F.lit(pattern), F.lit(group))))
    parts = [F.transform(F.arrays_zip(f"m{k}", f"g{k}", f"v{k}"), _match(k)) for k in range(len(KINDS))]
    return found.select("__sc_id", "__sc_key", F.flatten(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("found"))


def _match(k: int):
    return lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), F.length(x[f"g{k}"]).alias("gap"), F.length(x[f"m{k}"]).alias("len"),
                                 (F.length(x[f"v{k}"]) >= KINDS[k][4]).alias("ok"))


def _spans(found: DataFrame) -> DataFrame:
    """(__sc_id, __sc_key, kind, start, stop) of the matches that are long enough."""
    each = (found.where(F.size("found") > 0).dropDuplicates(["__sc_id", "__sc_key"])
                 .select("__sc_id", "__sc_key", F.explode("found").alias("f")).select("__sc_id", "__sc_key", "f.*"))
    upto = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("__sc_id", "__sc_key", "kind").orderBy("i"))
    return each.withColumn("stop", upto).where("ok").select(
        "__sc_id", "__sc_key", "kind", (F.col("stop") - F.col("len")).alias("start"), "stop")


def _free(spans: DataFrame) -> DataFrame:
    """Base spans, and weak ones that overlap no base span."""
    order = Window.partitionBy("__sc_id", "__sc_key").orderBy("start", "kind")
    before = F.max(F.when(F.col("kind") < BASE, F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("kind") < BASE, F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    apart = F.coalesce(before <= F.col("start"), F.lit(True)) & F.coalesce(after >= F.col("stop"), F.lit(True))
    return spans.withColumn("apart", apart).where((F.col("kind") < BASE) | F.col("apart")).drop("apart")


def _role() -> Column:
    return F.element_at(F.array(*[F.lit(role) for _, role, *_ in KINDS]), F.col("kind") + 1)


def link(spans: DataFrame, scope: int = 400) -> DataFrame:
    """The base spans and the weak spans whose complementary parts start within ``scope`` characters."""
    placed = spans.withColumn("role", _role()).withColumn("bin", F.expr(f"start div {scope}"))
    extents = placed.groupBy("__sc_id", "__sc_key", "bin", "role").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    extents = extents.select(F.col("__sc_id").alias("i"), F.col("__sc_key").alias("k"), F.col("bin").alias("b"),
                             F.col("role").alias("other"), "lo", "hi")
    weak = placed.where(F.col("kind") >= BASE)
    near = weak.withColumn("at", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    met = near.join(extents, near["__sc_id"].eqNullSafe(extents["i"]) & (F.col("__sc_key") == F.col("k")) & (F.col("at") == F.col("b"))
                    & (F.col("lo") <= F.col("start") + scope) & (F.col("hi") >= F.col("start") - scope))
    seen = lambda role: F.max((F.col("other") == role).cast("int")) == 1
    roles = met.groupBy("__sc_id", "__sc_key", "kind", "start", "stop", "role").agg(
        seen("identifier").alias("has_id"), seen("secret").alias("has_secret"))
    linked = roles.where((F.col("role") == "identifier") & F.col("has_secret") | (F.col("role") == "secret") & F.col("has_id")
                         | (F.col("role") == "endpoint") & F.col("has_id") & F.col("has_secret"))
    columns = ["__sc_id", "__sc_key", "kind", "start", "stop"]
    return spans.where(F.col("kind") < BASE).select(*columns).unionByName(linked.select(*columns))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 400) -> DataFrame:
    """One row per document: the id and ``spans``, an array of (start, kind number, stop) in order."""
    rows = docs.select(F.col(id_col).alias("__sc_id"), F.xxhash64(text_of(text_col)).alias("__sc_key"), text_of(text_col).alias("__sc_text"))
    found = cut(_found(rows), "matches")
    spans = cut(_free(_spans(found)), "spans")
    lists = cut(link(spans, scope).groupBy("__sc_id", "__sc_key").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("spans")), "linked")
    lists = lists.select(F.col("__sc_id").alias("i"), F.col("__sc_key").alias("k"), "spans")
    out = found.select("__sc_id", "__sc_key").join(
        lists, F.col("__sc_id").eqNullSafe(F.col("i")) & (F.col("__sc_key") == F.col("k")), "left")
    nothing = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")
    return out.select(F.col("__sc_id").alias(id_col), F.coalesce("spans", nothing).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(name) for name, *_ in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
