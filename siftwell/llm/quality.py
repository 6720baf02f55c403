"""Quality rules with thresholds that adapt to each language and source.

Everything here is DataFrame and SQL work in the JVM.  Each text gives exact counts and three rates per thousand; the
rates go into mergeable quantile sketches (log-linear histograms: a value keeps its six leading bits, so a quantile is
within 1/32, sketches merge by adding counts, and the result doesn't depend on the order of merging).  A group of
(lang, source) with fewer than `min_docs` surviving documents uses the merged sketch of its language, and a small
language that of the whole corpus.  With `weight`, no size decides: every group has its own sketch merged with that of
its language at the weight of so many documents, and every language's with that of the corpus likewise.

Defined cases: null text counts as empty (no words, so it fails the base rules); null lang or source is a group of its
own; repeated rows each count; an empty table gives an empty result; further columns of the input are ignored by
quality_metrics and kept by quality_filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, joinable, materialize

#: rate -> (slack per thousand, short-text allowance, column whose size the allowance shrinks with, lower fence too)
RATES = {"wl": (0, 8000, "n_words", True), "sy": (100, 1000, "n_words", False), "dl": (300, 1000, "n_lines", False)}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_WORDLESS = r"[\\x20\\x09-\\x0D]+"


def with_counts(docs: DataFrame, p: str = "_q_") -> DataFrame:
    """Add the exact counts of each text under names that begin with p."""
    a = docs.withColumn(f"{p}t", F.expr("coalesce(text, '')"))
    a = a.withColumn(f"{p}w", F.expr(f"filter(split({p}t, '{_WORDLESS}'), x -> x != '')"))
    a = a.withColumn(f"{p}l", F.expr(f"filter(split({p}t, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
    a = a.withColumn(f"{p}h", F.expr(f"transform({p}w, x -> xxhash64(x))"))
    window = ", ".join(f"{p}h[i + {j}]" for j in range(5))
    a = a.withColumns({
        f"{p}n_words": F.expr(f"cast(size({p}w) as bigint)"),
        f"{p}word_chars": F.expr(f"aggregate({p}w, 0L, (s, x) -> s + length(x))"),
        f"{p}n_symbols": F.expr(f"cast(regexp_count({p}t, '[#*$%&|<>]') as bigint)"),
        f"{p}n_lines": F.expr(f"cast(size({p}l) as bigint)"),
        f"{p}n_dup_lines": F.expr(f"cast(size({p}l) - size(array_distinct({p}l)) as bigint)"),
        f"{p}v": F.expr(f"if(size({p}h) >= 5, transform(sequence(0, size({p}h) - 5), i -> xxhash64({window})), array())"),
    }).drop(f"{p}w", f"{p}l", f"{p}h", f"{p}t")
    a = a.withColumn(f"{p}o", F.expr(f"if(size({p}v) = size(array_distinct({p}v)), null, array_sort(transform({p}v, (x, i) -> struct(x as x, i as i))))")).drop(f"{p}v")
    same = f"(k > 0 and {p}o[k - 1].x = e.x) or (k < size({p}o) - 1 and {p}o[k + 1].x = e.x)"
    a = a.withColumn(f"{p}r", F.expr(f"if({p}o is null, array(), array_sort(transform(filter({p}o, (e, k) -> {same}), e -> e.i)))")).drop(f"{p}o")
    reach = f"if(k = size({p}r) - 1, 5, least(5, {p}r[k + 1] - x))"
    return a.withColumn(f"{p}n_repeat_words", F.expr(f"aggregate(transform({p}r, (x, k) -> {reach}), 0L, (s, x) -> s + x)")).drop(f"{p}r")


def with_rates(a: DataFrame, p: str = "_q_") -> DataFrame:
    return a.withColumns({
        f"{p}base_failed": F.expr(f"{p}n_words < 10 or 100 * {p}n_repeat_words > 20 * {p}n_words"),
        f"{p}wl": F.expr(f"({p}word_chars * 1000) div greatest({p}n_words, 1L)"),
        f"{p}sy": F.expr(f"({p}n_symbols * 1000) div greatest({p}n_words, 1L)"),
        f"{p}dl": F.expr(f"({p}n_dup_lines * 1000) div greatest({p}n_lines, 1L)"),
    })


def sketches(rated: DataFrame, p: str = "_q_") -> DataFrame:
    """(lang, source, rate, value, n): the sketch of each group, from documents that pass the base rules."""
    pairs = ", ".join(f"struct('{r}' as rate, {p}{r} as v)" for r in RATES)
    return (
        rated.filter(~F.col(f"{p}base_failed")).select("lang", "source", F.expr(f"inline(array({pairs}))"))
        .withColumn("value", F.expr("if(v < 64, v, shiftleft(shiftright(v, length(bin(v)) - 6), length(bin(v)) - 6))"))
        .groupBy("lang", "source", "rate", "value").agg(F.count("*").alias("n"))
    )


_BY_SIZE = """
with s as (select lang, source, rate, value, n from {sketch}),
levels as (
    select 0 as level, lang, source, rate, value, n from s
    union all select 1, lang, null, rate, value, sum(n) from s group by lang, rate, value
    union all select 2, null, null, rate, value, sum(n) from s group by rate, value),
c as (select *, sum(n) over (partition by level, lang, source, rate order by value) as upto,
             sum(n) over (partition by level, lang, source, rate) as total from levels),
q as (select level, lang, source, rate, max(total) as total,
             min(if(4 * upto >= total, value, null)) as q25, min(if(4 * upto >= 3 * total, value, null)) as q75
      from c group by level, lang, source, rate),
g as (select distinct lang, source, rate from s)
select g.lang, g.source, g.rate,
       case when a.total >= {least} then a.q25 when b.total >= {least} then b.q25 else w.q25 end as q25,
       case when a.total >= {least} then a.q75 when b.total >= {least} then b.q75 else w.q75 end as q75
from g join q a on a.level = 0 and a.lang <=> g.lang and a.source <=> g.source and a.rate = g.rate
       join q b on b.level = 1 and b.lang <=> g.lang and b.rate = g.rate
       join q w on w.level = 2 and w.rate = g.rate
"""

#: Own counts, those of the language and those of the corpus as whole numbers over one denominator.
_BY_WEIGHT = """
with s as (select lang, source, rate, value, cast(n as decimal(12, 0)) as n from {sketch}),
a as (select lang, source, rate, cast(sum(n) as decimal(12, 0)) as total, collect_list(struct(value, n)) as own from s group by lang, source, rate),
b as (select lang, rate, cast(sum(n) as decimal(12, 0)) as total, collect_list(struct(value, n)) as near
      from (select lang, rate, value, cast(sum(n) as decimal(12, 0)) as n from s group by lang, rate, value) group by lang, rate),
w as (select rate, cast(sum(n) as decimal(12, 0)) as total, collect_list(struct(value, n)) as far
      from (select rate, value, cast(sum(n) as decimal(12, 0)) as n from s group by rate, value) group by rate),
m as (select /*+ broadcast(b), broadcast(w) */ a.lang, a.source, a.rate,
             cast((a.total + {weight}) * (b.total + {weight}) * w.total as decimal(38, 0)) as total,
             array_sort(concat(
                 transform(own, x -> struct(x.value as value, cast(x.n * (b.total + {weight}) * w.total as decimal(38, 0)) as n)),
                 transform(near, x -> struct(x.value as value, cast({weight} * x.n * w.total as decimal(38, 0)) as n)),
                 transform(far, x -> struct(x.value as value, cast({weight} * {weight} * x.n as decimal(38, 0)) as n)))) as all
      from a join b on b.lang <=> a.lang and b.rate = a.rate join w on w.rate = a.rate)
select lang, source, rate, at.q25, at.q75 from (select lang, source, rate, aggregate(
    all, struct(cast(0 as decimal(38, 0)) as upto, cast(null as bigint) as q25, cast(null as bigint) as q75),
    (s, x) -> struct(cast(s.upto + x.n as decimal(38, 0)) as upto,
                     coalesce(s.q25, if(4 * (s.upto + x.n) >= total, x.value, null)) as q25,
                     coalesce(s.q75, if(4 * (s.upto + x.n) >= 3 * total, x.value, null)) as q75)) as at from m)
"""


def thresholds(rated: DataFrame, min_docs: int = 200, p: str = "_q_", weight: int | None = None) -> DataFrame:
    """One row for each (lang, source): the lower and upper fence of each rate."""
    spark = rated.sparkSession
    sketch = materialize(sketches(rated, p))
    text = spark.sql(_BY_SIZE, sketch=sketch, least=min_docs) if weight is None else spark.sql(_BY_WEIGHT, sketch=sketch, weight=weight)
    cut = lambda r, what: F.max(F.when(F.col("rate") == r, F.expr(what)))
    return text.groupBy("lang", "source").agg(*[
        x for r, (slack, *_ ) in RATES.items()
        for x in (cut(r, f"q75 + 3 * (q75 - q25) + {slack}").alias(f"{p}hi_{r}"), cut(r, f"q25 - 3 * (q75 - q25) - {slack}").alias(f"{p}lo_{r}"))
    ]).withColumnsRenamed({"lang": f"{p}lang", "source": f"{p}source"})


def _verdict(rated: DataFrame, min_docs: int, p: str, weight: int | None = None) -> DataFrame:
    """rated with p+kept: base rules and all adaptive fences together."""
    cuts = joinable(thresholds(rated, min_docs, p, weight))  # a row for each (lang, source): texts aren't dealt out by them
    fine = []
    for r, (_, room, of, below) in RATES.items():
        over = f"({p}{r} > {p}hi_{r} and ({p}{r} - {p}hi_{r}) * ({p}{r} - {p}hi_{r}) * {p}{of} > {room * room}L)"
        under = f" or ({p}{r} < {p}lo_{r} and ({p}{r} - {p}lo_{r}) * ({p}{r} - {p}lo_{r}) * {p}{of} > {room * room}L)" if below else ""
        fine.append(f"not ({over}{under})")
    out = rated.join(cuts, rated["lang"].eqNullSafe(cuts[f"{p}lang"]) & rated["source"].eqNullSafe(cuts[f"{p}source"]), "left")
    return out.withColumn(f"{p}kept", F.expr(f"not {p}base_failed and coalesce({' and '.join(fine)}, false)"))


def quality_metrics(docs: DataFrame, min_docs: int = 200, weight: int | None = None) -> DataFrame:
    """doc_id, the five counts, base_failed and kept of every document."""
    counted = with_rates(with_counts(docs.select("doc_id", "lang", "source", "text"))).drop("text")
    a = _verdict(materialize(counted), min_docs, "_q_", weight)
    return a.select("doc_id", *[F.col(f"_q_{c}").alias(c) for c in (*COUNTS, "base_failed", "kept")])


def quality_filter(docs: DataFrame, min_docs: int = 200, weight: int | None = None) -> DataFrame:
    """The documents that the rules keep, with the columns of docs."""
    p = fresh(docs, "_q_")
    rated = materialize(with_rates(with_counts(docs, p), p))
    return _verdict(rated, min_docs, p, weight).filter(f"{p}kept").select(*docs.columns)
