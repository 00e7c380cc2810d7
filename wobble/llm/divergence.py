"""Divergence of sources from each other and from their language, by shards of counts that DuckDB adds up inside Spark's tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import Scratch, lean, pieces

#: RE2 and Python both read it so: what isn't ASCII, and letters.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
COUNTS = "lang string, source string, term string, n long, docs long"
KEPT = "lang string, term string, sources array<string>, counts array<long>, total long"
PARTIAL = "part string, lang string, source string, item string, value long, n long"
#: Kept terms of a shard, on average, when pairs are added up.
SHARD_TERMS = 2000
#: Rows of counts that a task merges at once, and bytes of text that it counts at once.
MERGE_ROWS, TEXT_BYTES = 400_000, 8 << 20

_COUNT = f"""
with t as (select i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) as term from batch),
d as (select i, term, count(*) as n from t group by i, term)
select b.lang, b.source, d.term, sum(d.n)::bigint as n, count(*)::bigint as docs from d join (select i, lang, source from batch) b using (i) group by all
"""
_MERGE = "select lang, source, term, sum(n)::bigint as n, sum(docs)::bigint as docs from batch group by all"
_ONE = "select lang, source, term, sum(n)::bigint as n, 1::bigint as docs from batch group by all"
_KEEP = """
with c as (select lang, term, source, sum(n)::bigint as n, sum(docs)::bigint as docs from batch group by all)
select lang, term, list(source order by source) as sources, list(n order by source) as counts, sum(n)::bigint as total from c group by lang, term having sum(docs) >= {least}
"""
# a term's row of a source against all other sources of the language; two sources that both have the term meet once
_PAIRS = f"""
with k as (select lang, term, unnest(sources) as source, unnest(counts) as n from kept),
p as (select k.lang, k.term, k.source, (1 + {SCALE}::hugeint * (k.n + 2) // (g.n + 2 * g.v))::bigint as p from k join groups g using (lang, source)),
f as (select a.lang, least(a.source, h.source) as source, greatest(a.source, h.source) as item, a.p, coalesce(b.p, h.none) as q
  from p a join groups h on h.lang = a.lang and h.source <> a.source left join p b on b.lang = a.lang and b.term = a.term and b.source = h.source where b.p is null or a.source < h.source)
select 'pair' as part, lang, source, item, sum((p - q) * (p - q) // (p + q))::bigint as value, count(*)::bigint as n from f group by all
"""
_TERMS = f"""
with k as (select lang, term, total, unnest(sources) as source, unnest(counts) as n from kept),
p as (select k.lang, k.term, k.source, (1 + {SCALE}::hugeint * (k.n + 2) // (g.n + 2 * g.v))::bigint as p, (1 + {SCALE}::hugeint * (k.total + 2) // (g.lang_n + 2 * g.v))::bigint as q from k join groups g using (lang, source)),
f as (select lang, source, term as item, (p - q) * (p - q) // (p + q) as value from p where p > q)
select 'term' as part, lang, source, item, value::bigint as value, 1::bigint as n from f qualify row_number() over (partition by lang, source order by value desc, item) <= {{top}}
"""


def run_sql(sql: str, **tables: pa.Table) -> pa.Table:
    """One statement over Arrow tables, on one thread and in memory."""
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
    try:
        for name, t in tables.items():
            con.register(name, t)
        return con.sql(sql).to_arrow_table()
    finally:
        con.close()


def chunks(text: str, most: int) -> Iterator[str]:
    """A text in parts of about so many characters that cut no term."""
    start = 0
    while start < len(text):
        m = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]").search(text, start + most)
        end = m.end() if m else len(text)
        yield text[start:end]
        start = end


def count_batch(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents of each term by language and source. A text too long to be counted at once is counted in parts that are then added up."""
    t = pa.table({"i": pa.array(range(len(batch)), pa.int64()), **{c: batch.column(batch.schema.get_field_index(c)) for c in ("lang", "source", "text")}})
    if len(batch) > 1 or t.nbytes <= 2 * TEXT_BYTES:
        return run_sql(_COUNT, batch=t)
    row = t.slice(0, 1).to_pylist()[0]
    found = [run_sql(_COUNT, batch=pa.table({"i": [0], "lang": [row["lang"]], "source": [row["source"]], "text": [x]})) for x in chunks(row["text"], TEXT_BYTES)]
    return run_sql(_ONE, batch=pa.concat_tables(found))


def term_counts(docs: DataFrame) -> DataFrame:
    """COUNTS of docs (lang, source, text, none null), added up in each task before they are shuffled."""

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in pieces(batches, "text", TEXT_BYTES):
            held.append(count_batch(b))
            if sum(map(len, held)) > MERGE_ROWS:
                merged = run_sql(_MERGE, batch=pa.concat_tables(held))
                held = [merged]
                if len(merged) > MERGE_ROWS // 2:
                    yield from merged.to_batches()
                    held = []
        if held:
            yield from run_sql(_MERGE, batch=pa.concat_tables(held)).to_batches()

    return docs.select("lang", "source", "text").mapInArrow(count, COUNTS)


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 v)), in integers."""
    wide = lambda c: c.cast("decimal(38,0)")
    return (1 + F.floor(wide(n + 2) * F.lit(SCALE) / wide(total + 2 * v))).cast("long")


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, shards: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from the language's other sources (part pair: item is the other source) and which terms set it apart from its language (part term, the first `top`).

    Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased. A language keeps the terms that at least least_docs of its documents have. A group's share of a kept
    term is smoothed and scaled, p = 1 + floor(10**9 (count + 2) / (N + 2 V)); the difference of two shares is floor((p - q)**2 / (p + q)), summed over all kept terms for a pair. All in integers.
    Rank is by value, descending, then by item.

    Null text, lang and source count as empty ones. Languages without kept terms give pairs of value 0. Repeated rows are documents each. No rows give none. Other columns don't matter.

    Tasks count their texts; the sums go to shards by language and term, so a language or source with most rows spreads like any other. A shard decides which of its terms are kept and
    writes one row for each, then adds up its part of every pair of sources and picks its first terms. Terms that neither source of a pair has all add the same, so they are counted, not listed.
    A shard gets a row for each source of a language, as the result has one for each two.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    shards = shards or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    shard = lambda n: F.pmod(F.xxhash64("lang", "term"), F.lit(n)).cast("int").alias("shard")

    def keep(t: pa.Table) -> pa.Table:
        return run_sql(_KEEP.format(least=least_docs), batch=t)

    kept = scratch.keep(term_counts(d).select(shard(shards), "*").groupBy("shard").applyInArrow(keep, KEPT))
    merged = 1 + kept.count() // SHARD_TERMS  # each shard gives a row for each pair, so shards follow the number of terms, not that of partitions
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    each = kept.select("lang", F.inline(F.arrays_zip("sources", "counts"))).groupBy("lang", F.col("sources").alias("source")).agg(F.sum("counts").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = d.select("lang", "source").distinct().join(each, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("n"), zero("v"), zero("lang_n"))
    groups = scratch.keep(groups.withColumn("none", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("n"), F.col("v"))).otherwise(0)))

    def partial(key: tuple, k: pa.Table, g: pa.Table) -> pa.Table:
        schema = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("n", pa.int64())])
        if not len(k):
            return schema.empty_table()
        return pa.concat_tables([run_sql(sql, kept=k, groups=g).cast(schema) for sql in (_PAIRS, _TERMS.format(top=top))])

    everywhere = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(merged - 1))))
    parts = scratch.keep(kept.select(shard(merged), "*").groupBy("shard").cogroup(everywhere.groupBy("shard")).applyInArrow(partial, PARTIAL))
    a, b = groups.select("lang", "source", "v", "none"), groups.select("lang", F.col("source").alias("item"), F.col("none").alias("other"))
    sums = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    pairs = a.join(b, "lang").where("source < item").join(sums, ["lang", "source", "item"], "left")
    both_none = F.expr("case when v > 0 then ((none - other) * (none - other)) div (none + other) else 0 end")
    pairs = pairs.select("lang", "source", "item", (F.coalesce("value", F.lit(0)) + both_none * (F.col("v") - F.coalesce("n", F.lit(0)))).cast("long").alias("value"))
    pairs = pairs.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("z"), "value").select("lang", "z.source", F.lit("pair").alias("part"), "z.item", "value")
    terms = parts.where("part = 'term'").select("lang", "source", "part", "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))
