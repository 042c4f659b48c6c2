"""Quality classifier: an interpolated modified Kneser-Ney n-gram model over the bytes of trusted text.

Each language has its own model of 4-grams of UTF-8 bytes.  Documents are hashed into blocks of some 32 MB.  A block names every
n-gram it holds, once, with how often its trusted documents use it, packed by shard.  Shards sum the counts, which are joined
with the counts of their contexts and shorter n-grams, order by order, into probabilities; these go back, packed, to the blocks
that named them, where each document's log-probability is added up.  Nothing is broadcast, and what is counted and sent grows with
the corpus.

Trusted documents are split: four fifths train the model, one fifth (by hash of the id) sets each language's threshold, a
quantile of their perplexities.  Perplexities of short texts are drawn to their language's mean, as if they went on for
`prior_bytes` of average text.  Each language has its own discounts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import cut, doc_slices, free_name, hash_bucket, text_bytes, utf8_list

ORDER = 4
PAD = b"\n" * (ORDER - 1)  # what precedes a text
SLICE = 1 << 20  # bytes of text that are worked on at a time
HELD_OUT = 5  # one in so many trusted documents sets thresholds


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at every byte of every text, in order, and the number of bytes of each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(PAD + PAD.join(texts), np.uint8).astype(np.uint32)
    keys = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    pads = (np.cumsum(sizes + len(PAD)) - len(PAD))[:-1, None] + np.arange(len(PAD))
    valid = np.ones(len(keys), bool)
    valid[pads.ravel()] = False
    return keys[valid], sizes


def _slices(table: pa.Table) -> Iterator[tuple[str, np.ndarray, list[bytes], np.ndarray]]:
    """Of a block's documents (kind 0) and labels (kind 1), SLICE bytes of text of a language at a time: the language, row numbers, texts
    and roles (0 none, 1 trains, 2 held out).  Only a slice is held beside the block."""
    kind, ids = table.column("kind").to_numpy(), table.column("id").to_pylist()
    fold = table.column("fold").to_numpy()
    trusted = {i for i, k in zip(ids, kind.tolist(), strict=True) if k == 1}
    rows, langs = np.flatnonzero(kind == 0), table.column("lang").to_pylist()
    column = table.column("text").cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy()
    found: dict[str, list[int]] = {}
    for r in rows.tolist():
        found.setdefault(langs[r], []).append(r)
    role = np.array([(2 if fold[r] == 0 else 1) if k == 0 and ids[r] is not None and ids[r] in trusted else 0 for r, k in enumerate(kind.tolist())])
    for lang, members in sorted(found.items()):
        at = np.array(members)
        for a, b in doc_slices(sizes[at].tolist(), SLICE):
            yield lang, at[a:b], utf8_list(column.take(pa.array(at[a:b]))), role[at[a:b]]


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _tally(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in order and their summed counts."""
    gram = np.concatenate([g for g, _ in parts] or [np.zeros(0, np.uint32)])
    n = np.concatenate([c for _, c in parts] or [np.zeros(0, np.int64)])
    order = np.argsort(gram, kind="stable")
    gram, n = gram[order], n[order]
    begin = _runs(gram)
    return gram[begin], np.add.reduceat(n, begin) if len(begin) else n


def _counted(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a slice in order, with counts: a sort, which is faster here than a hash table."""
    g = np.sort(g)
    begin = _runs(g)
    return g[begin], np.diff(np.r_[begin, len(g)])


def _squeeze(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), "zstd", asbytes=True)


def _unsqueeze(raw: bytes, n: int, kind: str) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(-1, n).T).reshape(-1).view(kind)


NAMED = "shard int, block int, lang string, many int, grams binary, counts binary"


def _namer(shards: int):
    """The distinct 4-grams of a block by language, with their counts in its training documents: a packed row for each shard."""

    def each(table: pa.Table) -> pa.Table:
        block, rows = table.column("block")[0].as_py(), []
        parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lang, _, texts, role in _slices(table):
            g, sizes = grams(texts)
            own = _counted(g)[0]
            held = parts.setdefault(lang, [])
            held.append((own, np.zeros(len(own), np.int64)))
            if (role == 1).any():
                held.append(_counted(g[np.repeat(role == 1, sizes)]))
            if len(held) > 16:
                held[:] = [_tally(held)]
        for lang, held in parts.items():
            gram, n = _tally(held)
            shard = gram.view(np.int32).astype(np.int64) % shards
            order = np.lexsort((gram, shard))
            edges = np.r_[_runs(shard[order]), len(gram)]
            for x in np.split(order, edges[1:-1]) if len(gram) else []:
                rows.append((int(shard[x[0]]), block, lang, len(x), _squeeze(gram[x]), _squeeze(n[x])))
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary())
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in NAMED.split(", ")])

    return each


def _packed(table: pa.Table) -> dict[str, list[tuple[int, np.ndarray, bytes]]]:
    """Of a shard's packed rows: by language block, n-grams and counts (still packed)."""
    found: dict[str, list[tuple[int, np.ndarray, bytes]]] = {}
    for block, lang, many, gram, n in zip(*(table.column(c).to_pylist() for c in ("block", "lang", "many", "grams", "counts")), strict=True):
        found.setdefault(lang, []).append((block, _unsqueeze(gram, many, "<u4"), n))
    return found


def _summed(table: pa.Table) -> pa.Table:
    """(lang, gram, n) of a shard, over all blocks."""
    parts = []
    for lang, rows in sorted(_packed(table).items()):
        gram, n = _tally([(g, _unsqueeze(c, len(g), "<i8")) for _, g, c in rows])
        parts.append(pa.table({"lang": pa.array([lang]).take(pa.array(np.zeros(len(gram), np.int32))), "gram": pa.array(gram.view(np.int32)), "n": pa.array(n)}))
    return pa.concat_tables(parts)


ANSWER = "block int, lang string, many int, grams binary, logp binary"


def _answered(named: pa.Table, logp: pa.Table) -> pa.Table:
    """Each block's n-grams of a shard with their log-probabilities, packed."""
    rows = []
    if named.num_rows:
        by_lang = logp.column("lang").to_numpy(zero_copy_only=False)
        gram, value = logp.column("gram").to_numpy().view(np.uint32), logp.column("logp").to_numpy()
        for lang, parts in sorted(_packed(named).items()):
            mine = np.flatnonzero(by_lang == lang)
            order = mine[np.argsort(gram[mine])]
            keys, values = gram[order], value[order].astype(np.float32)
            rows += [(block, lang, len(g), _squeeze(g), _squeeze(values[np.searchsorted(keys, g)])) for block, g, _ in parts]
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in ANSWER.split(", ")])


def _scored(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Log-probability of each document of a block.  A slice's (n-gram, document) pairs are sorted, so that each distinct n-gram is
    looked up once and memory is read in order."""
    ids, langs, roles, sizes, sums = [], [], [], [], []
    if docs.num_rows:
        all_ids = docs.column("id")
        known: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lang, many, g, v in zip(*(answers.column(c).to_pylist() for c in ("lang", "many", "grams", "logp")), strict=True):
            known.setdefault(lang, []).append((_unsqueeze(g, many, "<u4"), _unsqueeze(v, many, "<f4")))
        ready: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for lang, rows, texts, role in _slices(docs):
            if lang not in ready:
                keys, logp = (np.concatenate(x) for x in zip(*known.pop(lang, [(np.zeros(0, np.uint32), np.zeros(0, np.float32))]), strict=True))
                order = np.argsort(keys)
                ready = {lang: (keys[order], logp[order].astype(np.float64))}  # slices come language by language
            keys, logp = ready[lang]
            g, n = grams(texts)
            pairs = np.sort(g.astype(np.uint64) << np.uint64(32) | np.repeat(np.arange(len(n), dtype=np.uint64), n))
            gram = (pairs >> np.uint64(32)).astype(np.uint32)
            begin = _runs(gram)
            each = np.repeat(logp[np.searchsorted(keys, gram[begin])], np.diff(np.r_[begin, len(gram)]))
            sums.append(np.bincount((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), each, len(n)))
            sizes.append(n)
            ids += all_ids.take(pa.array(rows)).to_pylist()
            langs += [lang] * len(rows)
            roles.append(role)
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return pa.table({"id": pa.array(ids, pa.int64()), "lang": pa.array(langs, pa.string()), "role": pa.array(join(roles, np.int32)), "n_bytes": pa.array(join(sizes, np.int64)), "logp": pa.array(join(sums, np.float64))})


def _discounts(a: DataFrame) -> DataFrame:
    """For each language the three discounts of an order, from how many n-grams were seen once to four times (Chen and Goodman, 1999)."""
    n = a.groupBy(F.col("lang").alias("d_lang")).agg(*[F.count_if(F.col("a") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    ready = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    d = [F.least(F.lit(float(k)), F.greatest(F.lit(0.05), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"))) for k in (1, 2, 3)]
    return n.select("d_lang", *[F.when(ready, x).otherwise(F.lit(0.75 * k / (0.5 + 0.5 * k))).alias(f"d{k}") for k, x in zip((1, 2, 3), d, strict=True)])


def _discounted(a: Column) -> Column:
    return F.greatest(F.lit(0.0), a - F.when(a == 1, F.col("d1")).when(a == 2, F.col("d2")).otherwise(F.col("d3")))


def _order(asked: DataFrame, key: str) -> DataFrame:
    """asked (lang, key, a) with what its context (all but the last byte) has: mass and how many continuations were seen once, twice, more
    often.  A context has 256 continuations at most, so a window holds no more rows.  Also the discounts of the language."""
    w = Window.partitionBy("lang", F.shiftrightunsigned(F.col(key), 8))
    of_context = {"total": F.sum("a"), "t1": F.count_if(F.col("a") == 1), "t2": F.count_if(F.col("a") == 2), "t3": F.count_if(F.col("a") > 2)}
    rows = asked.select("lang", key, "a", *[x.over(w).alias(name) for name, x in of_context.items()])
    by_language = _discounts(asked)  # a row for each language: Spark broadcasts it if it is small, and splits a large language's rows if not
    return rows.join(by_language, F.col("lang") == F.col("d_lang"), "left")


def _interpolated(lower: Column) -> Column:
    """The probability of an n-gram, given that of the n-gram without its first byte."""
    own = F.when(F.col("a") > 0, _discounted(F.col("a"))).otherwise(F.lit(0.0))
    back = F.col("d1") * F.col("t1") + F.col("d2") * F.col("t2") + F.col("d3") * F.col("t3")
    return F.when(F.col("total") == 0, lower).otherwise((own + back * lower) / F.col("total"))


def probabilities(counts: DataFrame) -> DataFrame:
    """(lang, gram, logp) for every row of counts (lang, gram, n); n is 0 for n-grams that are only asked for.

    An order has one table of the n-grams that are asked for, with a, its count (order 4) or number of left neighbours (below), 0 if unseen.
    All that an order needs comes from this table by itself, so a plan names counts eight times and no more."""
    masks = {3: 0xFFFFFF, 2: 0xFFFF, 1: 0xFF}
    asked = {4: counts.select("lang", F.col("gram").alias("g4"), F.col("n").alias("a"))}
    for k in (3, 2, 1):
        asked[k] = asked[k + 1].groupBy("lang", F.col(f"g{k + 1}").bitwiseAND(F.lit(masks[k])).alias(f"g{k}")).agg(F.count_if(F.col("a") > 0).alias("a"))
    p = _order(asked[1], "g1").select("lang", "g1", _interpolated(F.lit(1 / 256)).alias("p"))
    for k in (2, 3, 4):
        lower = p.select(F.col("lang").alias("l_lang"), F.col(f"g{k - 1}").alias("l_key"), F.col("p").alias("l_p"))
        rows = _order(asked[k], f"g{k}").join(lower, (F.col("lang") == F.col("l_lang")) & (F.col(f"g{k}").bitwiseAND(F.lit(masks[k - 1])) == F.col("l_key")))
        p = rows.select("lang", f"g{k}", _interpolated(F.col("l_p")).alias("p"))
    return p.select("lang", F.col("g4").alias("gram"), F.log("p").alias("logp"))


def document_scores(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", block_bytes: int = 32 << 20, shard_bytes: int = 16 << 20) -> DataFrame:
    """(id, lang, role, n_bytes, logp): natural log-probability of each row's text.  trusted has the ids of trusted documents.

    Null text is empty (logp 0); null language is the language ''.  A row with a null id is never trusted; a repeated id is
    trusted in all its rows.  A language without training text gets the uniform distribution over bytes.
    """
    rows = docs.select(F.lit(0).alias("kind"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    marks = trusted.select(F.lit(1).alias("kind"), F.col(id_col).cast("long").alias("id"), F.lit("").alias("lang"), F.lit(None).cast("string").alias("text")).where("id is not null")
    total = text_bytes(docs, text_col)
    n, shards = max(1, -(-total // block_bytes)), max(1, total // shard_bytes) | 1
    # rows without an id are spread by their text
    spread = F.when(F.col("id").isNull(), hash_bucket(F.col("text"), n)).otherwise(hash_bucket(F.col("id"), n, 1))
    parts = rows.union(marks).withColumn("block", spread).withColumn("fold", hash_bucket(F.coalesce("id", F.lit(0)), HELD_OUT, 2)).repartition(n, "block")
    # both sides of a cogroup are dealt alike, so that texts move once
    named = parts.groupBy("block").applyInArrow(_namer(shards), NAMED).repartition(shards, "shard")
    logp = probabilities(named.groupBy("shard").applyInArrow(lambda t: _summed(t), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    dealt = logp.select(F.pmod("gram", F.lit(shards)).cast("int").alias("shard"), "lang", "gram", "logp").repartition(shards, "shard")
    answers = named.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(lambda a, b: _answered(a, b), ANSWER).repartition(n, "block")
    return parts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: _scored(a, b), "id long, lang string, role int, n_bytes long, logp double")


def judge_quality(docs: DataFrame, trusted: DataFrame, *, quantile: float = 0.99, margin: float = 1.15, prior_bytes: int = 100, **score) -> DataFrame:
    """(id, lang, perplexity, threshold, keep): perplexity per byte, smoothed; threshold is the quantile of the language's held-out
    trusted documents, or of its training documents if none is held out, times margin.  Empty texts have perplexity null and are kept, as is all
    text of a language that has no trusted document (threshold null)."""
    scores = cut(document_scores(docs, trusted, **score))
    means = scores.where("role > 0 and n_bytes > 0").groupBy(F.col("lang").alias("m_lang")).agg((F.sum("logp") / F.sum("n_bytes")).alias("mean"))
    smooth = F.exp(-(F.col("logp") + prior_bytes * F.coalesce("mean", F.lit(0.0))) / (F.col("n_bytes") + F.when(F.col("mean").isNull(), 0).otherwise(prior_bytes)))
    rated = scores.join(means, F.col("lang") == F.col("m_lang"), "left").select("id", "lang", "role", F.when(F.col("n_bytes") > 0, smooth).alias("perplexity"))
    at = lambda role: F.percentile_approx(F.when(F.col("role") == role, F.col("perplexity")), quantile, 10_000)
    limits = rated.where("role > 0 and perplexity is not null").groupBy(F.col("lang").alias("t_lang")).agg((F.coalesce(at(2), at(1)) * margin).alias("threshold"))
    return rated.join(limits, F.col("lang") == F.col("t_lang"), "left").select("id", "lang", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("keep"))


def keep_quality(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", **judge) -> DataFrame:
    """documents without those the classifier rejects; all columns stay.  Rows without an id stay."""
    name = free_name("bad", docs.columns)
    bad = judge_quality(docs, trusted, id_col=id_col, **judge).where("not keep and id is not null").select(F.col("id").alias(name)).distinct()
    return docs.join(bad, F.col(id_col).cast("long") == F.col(name), "left_anti")
