"""The registered queries of the numbered operators: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import covertree, ctxmix, divergence, infill, kneser, lines, media, packing, simhash, subword, toxicity, urlfilter, warc

#: The URL rules of the query, fixed values.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled as good; the rest of the corpus is not trusted."""
    return labels.where("quality = 1").select("doc_id")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, perplexity, threshold, keep for every document; trusted text is what is labelled good."""
    got = kneser.judge_quality(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")), margin=1.0)
    return got.select(F.col("id").alias("doc_id"), "lang", F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), "keep")


def op2_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: five best integer inner products of every vector whose id is divisible by 50."""
    return covertree.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id for every document: 4-word shingles, links at 4 differing bits or fewer."""
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from the archives it was written to."""
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    got = warc.read_archives(manifest, folder)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    as_long = lambda c: F.when(number(c) != "", number(c)).cast("long")
    return got.select(as_long("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", F.col("warc_type").alias("record_type"), as_long("refers_to").alias("refers_to"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and the SHA-256 of the text decoded from the ids, for every document."""
    path = tokenizer_path("piece_bpe_32k.model")
    ids = subword.encode(table(spark, sf_dir, "documents"), path)
    got = subword.decode(ids.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long")).withColumn("crc", F.crc32("ids")), path, keep=("id", "n_tokens", "crc"))
    return got.select(F.col("id").alias("doc_id"), "n_tokens", F.col("crc").alias("ids_crc32"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of what is left of every document's text."""
    got = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every document's tokens in sequences of at most 4096."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, severity (expected grade) and toxic (severity of 0.5 or more) for every document."""
    docs = table(spark, sf_dir, "documents")
    got = toxicity.expected_severity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", F.round("severity", 4).alias("severity"), (F.col("severity") >= 0.5).alias("toxic"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every page.  A page's label is the quality label of its number."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    marks = labels.groupBy(F.col("doc_id").alias("label_id")).agg((1 - F.min("quality")).alias("bad"))
    labelled = pages.join(marks, F.col("page_id") == F.col("label_id")).select("url", "bad")
    got = urlfilter.judge(pages, labelled, URL_RULES)
    return got.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and features of every document's text, stored as a media column and read back."""
    got = media.probe_column(media.encode_texts(table(spark, sf_dir, "documents")), keep=("id", "n_bytes"))
    last = F.element_at("keyframes", -1)
    feature = F.concat_ws(";", "codec", F.concat(F.lit("rate="), "timescale"), F.concat(F.lit("duration="), "duration"), F.concat(F.lit("samples="), "samples"), F.concat(F.lit("keyframes="), F.size("keyframes")), F.concat(F.lit("last="), last["start"], F.lit("+"), last["length"]), F.concat(F.lit("ranges="), F.crc32(F.to_json("keyframes").cast("binary"))))
    return got.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank: how far the sources of a language are apart, and the ten terms that set each apart most."""
    return divergence.audit(table(spark, sf_dir, "documents"), k=10, least_docs=10)


def op12_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every document."""
    docs = table(spark, sf_dir, "documents")
    return ctxmix.score(docs).withColumnRenamed("id", "doc_id")


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the SHA-256 of every document's rearranged text and of the text rebuilt from it."""
    got = infill.transform(table(spark, sf_dir, "documents"), seed=1, plain_from=90, spm_below=20)
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    back = infill.restored(F.col("output"), F.col("form"))
    return got.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_top_k_search, op3_simhash, op4_warc, op5_sentencepiece, op6_line_dedup, op7_packing, op8_toxicity, op9_url_filter, op10_media, op11_divergence, op12_context_mixing, op13_infill)}


#: A page's base32 SHA-1, five bits at a time out of the hex digest.
_BASE32 = "list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(sha1(encode(coalesce(html, ''))), 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), 'string_agg', '')"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_top_k_search": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
                       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * x.v[i])) AS BIGINT) AS score
                  FROM v q JOIN v x ON q.vec_id <> x.vec_id AND q.vec_id % 50 = 0),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
        "op4_warc": f"""
            WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, {_BASE32} AS digest FROM pages),
            f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
            SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
        "op11_divergence": r"""
            WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
            t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
            v AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
            g AS (SELECT DISTINCT lang, source FROM d),
            c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
            a AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0)::HUGEINT AS n, v.n::HUGEINT AS m FROM g JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
            p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER w + 2 * count(*) OVER w) AS p, 1 + (1000000000 * (m + 2)) // (sum(m) OVER w + 2 * count(*) OVER w) AS q
                  FROM a WINDOW w AS (PARTITION BY lang, source)),
            s AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
            f AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
                  LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
                  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
            r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
            SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10""",
        "op13_infill": """
            WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
            u AS (SELECT *, len(w) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(h, CAST(8 * i + 1 AS INTEGER), 8) AS BIGINT)) AS d FROM t),
            c AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 90 THEN 'plain' WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
            x AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:n], '') AS suf FROM c)
            SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
                   sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM x""",
    }
