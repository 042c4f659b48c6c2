"""Source divergence audit: which sources of a language differ most from each other, and by which terms.

Terms are counted once (a partial sum in every task, then by term); everything afterwards works on the kept terms' counts, which are
stored.  All arithmetic is on whole numbers.

Terms of a group (language, source): its terms are dealt into buckets by count, an eighth of a power of two wide.  The largest count of a
bucket and the smallest probability that any of its terms has in the language bound the value of every term in it, as the value rises with
the group's probability and falls with the language's.  Buckets are opened best first, in rounds, until what no bucket left can exceed is
strictly below the k-th value found, so ties are never lost; the others' terms are never scored.

Pairs of sources: a term that only one of the two has is worth the same in every such pair, so these values come from how often each count
occurs.  Postings (a term's sources with their counts, met in a join on the term) add what is different where both have it, and terms that
neither has are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import cut

#: What ends a term: everything in ASCII but letters.
NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 1_000_000_000
FIRST_BUCKETS = 4  # opened in the first round; each later round opens twice as many as the one before


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)) in whole numbers; null if there are no terms."""
    wide = lambda c: c.cast("decimal(28,0)")
    top, bottom = (wide(count) + 2) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + 2 * terms)
    return F.when(terms > 0, 1 + F.call_function("div", top, bottom))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)): below 2^63, as probabilities are at most SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def term_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, d): occurrences of every term in every group, and in how many documents of it.

    A document's terms are laid out twice, each one once and all of them, so that documents and occurrences come from one sum.
    """
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    empty_as = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    split = docs.select(empty_as(lang_col).alias("lang"), empty_as(source_col).alias("source"), F.split(text, NO_TERM).alias("t"))
    once = split.withColumn("u", F.array_distinct("t")).select("lang", "source", F.size("u").alias("k"), F.posexplode(F.concat("u", "t")).alias("i", "term")).where("term <> ''")
    return once.groupBy("lang", "source", "term").agg(F.count_if(F.col("i") >= F.col("k")).alias("n"), F.count_if(F.col("i") < F.col("k")).alias("d"))


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n, d, total): terms in at least that many documents of their language; total is the language's count.

    Both sides read the same columns of counts, so that its exchange is made once.
    """
    by_lang = counts.groupBy(F.col("lang").alias("l_lang"), F.col("term").alias("l_term")).agg(F.sum("n").alias("total"), F.sum("d").alias("l_d")).where(F.col("l_d") >= least_docs)
    return counts.join(by_lang, (F.col("lang") == F.col("l_lang")) & (F.col("term") == F.col("l_term"))).select("lang", "source", "term", "n", counts["d"], "total")


def _groups(docs: DataFrame, kept: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, size, distinct, lang_size, terms) for every group that occurs; its terms' occurrences, its number of terms, the same
    of its language."""
    empty_as = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    there = docs.select(empty_as(lang_col).alias("lang"), empty_as(source_col).alias("source")).distinct()
    own = kept.groupBy(F.col("lang").alias("o_lang"), F.col("source").alias("o_source")).agg(F.sum("n").alias("size"), F.count("*").alias("distinct"))
    whole = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy(F.col("lang").alias("w_lang")).agg(F.sum("total").alias("lang_size"), F.count("*").alias("terms"))
    joined = there.join(own, (F.col("lang") == F.col("o_lang")) & (F.col("source") == F.col("o_source")), "left").join(whole, F.col("lang") == F.col("w_lang"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("lang", "source", zero("size"), zero("distinct"), zero("lang_size"), zero("terms"))


def top_terms(kept: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """(lang, source, item, value, rank): the k terms of each group with the highest values, of those that the group uses more often than
    its language does.  Ties go to the smaller term in UTF-8 order."""
    g = groups.where("size > 0").select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "size", "lang_size", "terms")
    rows = kept.join(g, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source")))
    bucket = F.floor(F.log2("n") * 8).cast("int")
    rated = rows.select("lang", "source", "term", "n", "size", "terms", bucket.alias("bucket"), probability(F.col("total"), F.col("lang_size"), F.col("terms")).alias("q"))
    bounds = rated.groupBy("lang", "source", "bucket").agg(F.max("n").alias("most"), F.min("q").alias("least_q"), F.first("size").alias("size"), F.first("terms").alias("terms"))
    best_p = probability(F.col("most"), F.col("size"), F.col("terms"))
    reach = bounds.withColumn("p", best_p).where("p > least_q").select("lang", "source", "bucket", divergence(F.col("p"), F.col("least_q")).alias("bound"))
    nth = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket"))
    waiting = cut(reach.withColumn("nth", nth))  # some 350 buckets a group at most, whatever its size
    rated = cut(rated.select("lang", "source", "term", "n", "size", "terms", "q", "bucket"))
    best, done, step = None, 0, FIRST_BUCKETS
    best_first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    while waiting.take(1):
        now = waiting.where(F.col("nth") <= done + step).select(*[F.col(c).alias(f"b_{c}") for c in ("lang", "source", "bucket")])
        opened = rated.join(now, (F.col("lang") == F.col("b_lang")) & (F.col("source") == F.col("b_source")) & (F.col("bucket") == F.col("b_bucket"))).withColumn("p", probability(F.col("n"), F.col("size"), F.col("terms"))).where("p > q")
        found = opened.select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
        # each task ranks its own rows first and hands on k a group, so that a large group does not meet in one task
        best = cut((found if best is None else best.drop("rank").union(found)).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k))
        kth = best.where(F.col("rank") == k).select(F.col("lang").alias("k_lang"), F.col("source").alias("k_source"), F.col("value").alias("kth"))
        left = waiting.where(F.col("nth") > done + step).join(kth, (F.col("lang") == F.col("k_lang")) & (F.col("source") == F.col("k_source")), "left")
        waiting, done, step = cut(left.where("kth is null or bound >= kth").select("lang", "source", "bucket", "bound", "nth")), done + step, 2 * step
    if best is None:
        return rated.select("lang", "source", F.col("term").alias("item"), F.lit(0).cast("long").alias("value"), F.lit(1).alias("rank")).where("false")
    return best


def pair_divergence(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed value of all kept terms for every two sources of a language, both ways; 0 without terms."""
    zero = F.lit(0).cast("long")
    g = groups.select("lang", "source", "size", "distinct", "terms", probability(zero, F.col("size"), F.col("terms")).alias("p0"))
    stats = cut(g)
    s = stats.select("lang", *[F.col(c).alias(f"s_{c}") for c in ("source", "distinct", "p0")], "terms")
    o = stats.select(F.col("lang").alias("o_lang"), *[F.col(c).alias(f"o_{c}") for c in ("source", "distinct", "p0")])
    pairs = s.join(o, (F.col("lang") == F.col("o_lang")) & (F.col("s_source") < F.col("o_source"))).drop("o_lang")  # as many as are asked for
    mine = stats.select(F.col("lang").alias("m_lang"), F.col("source").alias("m_source"), "size", "terms", "p0")
    listed = kept.join(mine, (F.col("lang") == F.col("m_lang")) & (F.col("source") == F.col("m_source"))).select("lang", "source", "term", probability(F.col("n"), F.col("size"), F.col("terms")).alias("p"), "p0")
    # where one has a term and the other has none: by count, not by term
    heights = listed.groupBy("lang", "source", "p").agg(F.count("*").alias("many"))
    other = stats.select(F.col("lang").alias("x_lang"), F.col("source").alias("other"), F.col("p0").alias("q"))
    alone = heights.join(other, (F.col("lang") == F.col("x_lang")) & (F.col("source") != F.col("other"))).groupBy("lang", "source", "other").agg(F.sum(F.col("many") * divergence(F.col("p"), F.col("q"))).alias("alone"))
    alone = alone.select("lang", F.least("source", "other").alias("s_source"), F.greatest("source", "other").alias("o_source"), "alone", zero.alias("change"), zero.alias("common"))
    # where both have it: the posting lists of a term
    a = listed.select(F.col("lang").alias("a_lang"), F.col("term").alias("a_term"), F.col("source").alias("s_source"), F.col("p").alias("ap"), F.col("p0").alias("a0"))
    b = listed.select(F.col("lang").alias("b_lang"), F.col("term").alias("b_term"), F.col("source").alias("o_source"), F.col("p").alias("bp"), F.col("p0").alias("b0"))
    both = a.join(b, (F.col("a_lang") == F.col("b_lang")) & (F.col("a_term") == F.col("b_term")) & (F.col("s_source") < F.col("o_source")))
    change = divergence(F.col("ap"), F.col("bp")) - divergence(F.col("ap"), F.col("b0")) - divergence(F.col("a0"), F.col("bp"))
    met = both.groupBy(F.col("a_lang").alias("lang"), "s_source", "o_source").agg(F.sum(change).alias("change"), F.count("*").alias("common")).select("lang", "s_source", "o_source", zero.alias("alone"), "change", "common")
    added = alone.union(met).groupBy(F.col("lang").alias("t_lang"), F.col("s_source").alias("t_s"), F.col("o_source").alias("t_o")).agg(F.sum("alone").alias("alone"), F.sum("change").alias("change"), F.sum("common").alias("common"))
    all_of = pairs.join(added, (F.col("lang") == F.col("t_lang")) & (F.col("s_source") == F.col("t_s")) & (F.col("o_source") == F.col("t_o")), "left")
    none = F.col("terms") - F.col("s_distinct") - F.col("o_distinct") + F.coalesce("common", zero)
    value = F.when(F.col("terms") > 0, F.coalesce("alone", zero) + F.coalesce("change", zero) + none * divergence(F.col("s_p0"), F.col("o_p0"))).otherwise(zero)
    each = all_of.select("lang", "s_source", "o_source", value.alias("value"))
    both_ways = F.explode(F.array(F.struct(F.col("s_source").alias("source"), F.col("o_source").alias("item")), F.struct(F.col("o_source").alias("source"), F.col("s_source").alias("item"))))
    return each.select("lang", both_ways.alias("w"), "value").select("lang", "w.source", "w.item", "value")


def audit(docs: DataFrame, *, k: int = 10, least_docs: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): for each group the other sources of its language by divergence (part `pair`, all of them)
    and its k most divergent terms (part `term`), ranked by value, then by item in UTF-8 order.

    Null text, language or source is empty.  A group without a kept term takes part in pairs with count 0 for every term; a language
    without kept terms has value 0 in all its pairs.  Repeated rows count as often as they occur.  Other columns, whatever their names,
    are left out.  No rows give no rows.
    """
    names = {"text_col": text_col, "lang_col": lang_col, "source_col": source_col}
    kept = cut(kept_terms(term_counts(docs, **names), least_docs))
    groups = cut(_groups(docs, kept, lang_col, source_col))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_divergence(kept, groups).withColumn("rank", ranked)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").union(columns(top_terms(kept, groups, k), "term"))
