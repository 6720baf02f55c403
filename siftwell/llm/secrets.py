"""Secret scans with multipart credential linking, in DataFrame and SQL functions only.

Base kinds (assign, access, hex) are always reported.  Weak parts (an unlabelled high-variety token, a login or client
identifier, an endpoint) are reported only when complementary parts stand in the same scope: within `scope` code
points.  A weak token needs an identifier or an endpoint; a weak identifier needs a secret; an endpoint needs both.
The interval join is an equi-join on (row, scope-wide cell) against the first and last position of each part type in the
cell and its two neighbours, so its rows grow with the parts, never with pairs of them.

Positions are code points, end exclusive.  Defined cases: null text counts as empty; repeated rows and null or equal
doc_ids are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: kind -> (pattern, condition on the match x); the order is that of kinds with equal starts.  Runs of hex digits and of
#: [A-Z0-9] are maximal, so a minimum inside the pattern finds what dropping short matches would.
KINDS = {
    "assign": (ASSIGN, "length(regexp_extract(x, '{pattern}', 2)) >= 12"),
    "access": ("AKIA[A-Z0-9]{14,}", None),
    "hex": ("[0-9a-f]{16,}", None),
    "weak_token": ("[A-Za-z0-9+/_-]{24,}", "x rlike '[0-9]' and x rlike '[A-Z]' and x rlike '[a-z]'"),
    "weak_login": ("(?:[Uu]ser(?:name)?|[Ll]ogin|[Cc]lient_?id)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9@._-]{3,}", None),
    "endpoint": ("(?:https?|jdbc|postgres|mysql|mongodb|redis|amqp)(?::[a-z0-9]+)?://[^\\x20\\x09-\\x0D\"'<>]+", None),
}
BASE = ("assign", "access", "hex")
#: Code points of a block that redaction cuts text out of.
BLOCK = 4096
#: What a part can be to its neighbours.
ROLE = {"assign": "secret", "hex": "secret", "weak_token": "secret", "access": "ident", "weak_login": "ident", "endpoint": "endpoint"}


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _scanned(column: str, add: str) -> str:
    """SQL: the running `add` (of x and y) over an array column, by doubling steps: n log n, and no array grows."""
    step = f"transform(acc, (x, i) -> if(i >= d, {add.format(x='x', y='acc[i - d]')}, x))"
    doubling = f"transform(sequence(0, cast(ceil(log2(size({column}))) as int) - 1), k -> cast(shiftleft(1, k) as int))"
    return f"if(size({column}) < 2, {column}, aggregate({doubling}, {column}, (acc, d) -> {step}))"


def with_parts(docs: DataFrame, p: str = "_s_") -> DataFrame:
    """Add p+parts, array<struct<s, k, e>>: all base spans and weak parts, ordered by start, then kind."""
    a = docs.withColumn(f"{p}t", F.expr("coalesce(text, '')"))
    for n, (kind, (pattern, fit)) in enumerate(KINDS.items()):
        q, group = _quoted(pattern), f"{p}{kind}"
        a = a.withColumn(f"{p}m", F.expr(f"regexp_extract_all({p}t, '{q}', 0)"))
        # Ends of matches: running sums of what stands before each match and the match.
        a = a.withColumn(f"{p}b", F.expr(f"if(size({p}m) > 0, zip_with(slice(split({p}t, '{q}', -1), 1, size({p}m)), {p}m, (g, x) -> length(g) + length(x)), cast(array() as array<int>))"))
        a = a.withColumn(f"{p}b", F.expr(_scanned(f"{p}b", "{x} + {y}")))
        ok = (fit or "true").format(pattern=q)
        a = a.withColumn(group, F.expr(
            f"transform(filter(zip_with({p}m, {p}b, (x, e) -> struct(e - length(x) as s, {n} as k, e as e, {ok} as ok)), y -> y.ok), y -> struct(y.s as s, y.k as k, y.e as e))"
        )).drop(f"{p}m", f"{p}b")
    base = ", ".join(f"{p}{k}" for k in BASE)
    weak = ", ".join(f"{p}{k}" for k in KINDS if k not in BASE)
    a = a.withColumn(f"{p}base", F.expr(f"array_sort(concat({base}))")).withColumn(f"{p}weak", F.expr(f"concat({weak})"))
    # A weak part inside or across a base span is that span's: in the order of base starts and weak ends, the furthest
    # base end so far tells whether a base span reaches into the weak part.
    a = a.withColumn(f"{p}events", F.expr(
        f"if(size({p}weak) > 0, array_sort(concat(transform({p}weak, y -> struct(y.e as at, 0 as base, 0 as reach, y as y)), "
        f"transform({p}base, z -> struct(z.s as at, 1 as base, z.e as reach, z as y)))), null)"
    ))
    a = a.withColumn(f"{p}reach", F.expr(f"if({p}events is null, null, transform({p}events, v -> v.reach))"))
    a = a.withColumn(f"{p}reach", F.expr(f"if({p}events is null, null, {_scanned(f'{p}reach', 'greatest({x}, {y})')})"))
    a = a.withColumn(f"{p}weak", F.expr(f"if({p}events is null, {p}weak, transform(filter(zip_with({p}events, {p}reach, (v, r) -> struct(v, r)), u -> u.v.base = 0 and u.r <= u.v.y.s), u -> u.v.y))"))
    return a.withColumn(f"{p}parts", F.expr(f"array_sort(concat({p}base, {p}weak))")).drop(f"{p}t", f"{p}weak", f"{p}events", f"{p}reach", *[f"{p}{k}" for k in KINDS])


def _linked(rows: DataFrame, scope: int, p: str) -> DataFrame:
    """rows (p+rid, p+parts) -> (p+rid, p+linked): weak parts whose complements stand within the scope."""
    names = list(KINDS)
    role = F.create_map(*[F.lit(x) for n, k in enumerate(names) for x in (n, ROLE[k])])
    parts = (
        rows.select(F.col(f"{p}rid").alias("rid"), F.explode(f"{p}parts").alias("y"))
        .select("rid", "y", role[F.col("y.k")].alias("role"), F.expr(f"y.s div {scope}").alias("cell"))
    )
    ends = parts.groupBy("rid", "cell", "role").agg(F.min("y.s").alias("lo"), F.max("y.s").alias("hi"))
    near = ends.select("rid", "role", "lo", "hi", F.explode(F.expr("array(cell - 1, cell, cell + 1)")).alias("cell"), F.col("cell").alias("of"))
    by_cell = near.groupBy("rid", "cell").agg(*[
        x for r in ("secret", "ident", "endpoint") for x in (
            F.max(F.when((F.col("role") == r) & (F.col("of") < F.col("cell")), F.col("hi"))).alias(f"{r}_before"),
            F.max((F.col("role") == r) & (F.col("of") == F.col("cell"))).alias(f"{r}_in"),
            F.min(F.when((F.col("role") == r) & (F.col("of") > F.col("cell")), F.col("lo"))).alias(f"{r}_after"))
    ])
    has = lambda r: f"(coalesce({r}_in, false) or coalesce(y.s - {r}_before <= {scope}, false) or coalesce({r}_after - y.s <= {scope}, false))"
    weak = parts.filter(F.col("y.k") >= len(BASE)).join(by_cell, ["rid", "cell"])
    rule = f"case role when 'secret' then {has('ident')} or {has('endpoint')} when 'ident' then {has('secret')} else {has('secret')} and {has('ident')} end"
    return weak.filter(F.expr(rule)).groupBy("rid").agg(F.collect_list("y").alias(f"{p}linked")).withColumnRenamed("rid", f"{p}rid")


def with_spans(rows: DataFrame, scope: int = 200, p: str = "_s_") -> DataFrame:
    """rows of with_parts -> rows with p+base and p+spans (base spans and linked weak parts, ordered)."""
    kept = materialize(rows.withColumn(f"{p}rid", F.monotonically_increasing_id()))
    weak = F.expr(f"size({p}parts) > size({p}base) and size({p}parts) > 1")
    plain = kept.filter(~weak).withColumn(f"{p}spans", F.col(f"{p}base"))
    linked = _linked(kept.filter(weak).select(f"{p}rid", f"{p}parts"), scope, p)
    joined = kept.filter(weak).join(linked, f"{p}rid", "left")
    joined = joined.withColumn(f"{p}spans", F.expr(f"array_sort(if({p}linked is null, {p}base, concat({p}base, {p}linked)))"))
    return plain.unionByName(joined.drop(f"{p}linked")).drop(f"{p}rid", f"{p}parts")


def _said(column: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({column}, y -> concat_ws(':', array({names})[y.k], y.s, y.e)), ',')"


def secret_spans(docs: DataFrame, scope: int = 200) -> DataFrame:
    """doc_id, counts of base spans, the digest of base spans, and all spans of every document."""
    a = with_spans(with_parts(docs.select("doc_id", "text")).drop("text"), scope)
    count = lambda n: F.expr(f"cast(size(filter(_s_base, y -> y.k = {n})) as bigint)")
    return a.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.expr(_said("_s_base")).cast("binary"), 256).alias("base_sha256"), F.expr(_said("_s_spans")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", scope: int = 200) -> DataFrame:
    """docs with every span (overlapping ones merged) replaced by mark; n_chars, where there is one, follows."""
    p = fresh(docs, "_s_")
    a = with_spans(with_parts(docs, p), scope, p)
    # The furthest end so far tells where a span begins beyond all earlier ones; text between such runs is cut out of
    # blocks, since a place in a long text is found by walking to it.
    a = a.withColumn(f"{p}reach", F.expr(f"transform({p}spans, y -> y.e)"))
    a = a.withColumn(f"{p}reach", F.expr(_scanned(f"{p}reach", "greatest({x}, {y})")))
    a = a.withColumn(f"{p}keep", F.expr(
        f"transform(filter(zip_with(concat({p}spans, array(struct(length(text) as s, 0 as k, 0 as e))), concat(array(0), {p}reach), (y, r) -> struct(r as a, y.s as e, y.k as k)), "
        f"v -> v.e >= v.a), v -> struct(v.a as a, v.e as e))"
    ))
    a = a.withColumn(f"{p}blocks", F.expr(f"if(size({p}spans) > 0, regexp_extract_all(text, '(?s).{{1,{BLOCK}}}', 0), null)"))
    block = lambda at: f"coalesce(get({p}blocks, cast({at} div {BLOCK} as int)), '')"
    cut = (
        f"if(v.a div {BLOCK} = v.e div {BLOCK}, substring({block('v.a')}, v.a % {BLOCK} + 1, v.e - v.a), "
        f"concat(substring({block('v.a')}, v.a % {BLOCK} + 1), array_join(slice({p}blocks, cast(v.a div {BLOCK} as int) + 2, cast(v.e div {BLOCK} - v.a div {BLOCK} as int) - 1), ''), "
        f"substring({block('v.e')}, 1, v.e % {BLOCK})))"
    )
    a = a.withColumn("text", F.expr(f"if(size({p}spans) = 0, text, array_join(transform({p}keep, v -> {cut}), '{mark}'))"))
    if "n_chars" in docs.columns:
        a = a.withColumn("n_chars", F.expr(f"if(size({p}spans) = 0, n_chars, cast(length(text) as bigint))"))
    return a.select(*docs.columns)
