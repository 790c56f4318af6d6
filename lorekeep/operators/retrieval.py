"""Dense, lexical and hybrid top-k retrieval, and its quality measures.

Blocks of queries meet blocks of records, of which the best ``k`` for each query go on to the one shuffle by query.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.engine.shared import sieve, store

#: Queries of a block, vectors of a block, and queries of a block that are met at a time.
QUERY_BLOCK, VECTOR_BLOCK, CHUNK = 10_000, 8_192, 256
#: The same for searches by words, and blocks of records that are met before what they found limits those after them.
WORD_BLOCK, RECORD_BLOCK, FIRST = 200_000, 32_768, 8
# Words that no query searches for.
STOP_WORDS = (
    "the", "and", "for", "with", "from", "that", "this", "into", "what", "when", "where", "which", "while", "have", "has", "had", "was",
    "were", "are", "is", "how", "why", "all", "our", "your", "their", "about", "show", "tell", "please", "does", "did", "using",
)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def with_norm(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("norm", F.sqrt(dot(F.col("embedding"), F.col("embedding"))))


def _blocks(queries: DataFrame, block: int) -> list[DataFrame]:
    """The queries, dealt by their ids over as many blocks as they fill; one block is the set itself."""
    n = -(-queries.count() // block)
    if n <= 1:
        return [queries]
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)]


def cells(rows: DataFrame, queries: DataFrame, key: str, size: int, block: int, count: int, run, schema: str) -> DataFrame:
    """``run`` (two Arrow tables) for every block of about ``size`` of the rows, dealt by ``key``, with every block of queries: the work of
    all pairs in pieces whose number grows with both sides and whose size doesn't. ``count`` is about how many keys there are."""
    n, m = max(-(-count // size), 1), max(-(-queries.select("query_id").distinct().count() // block), 1)
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    held = rows.withColumn("_row", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).select("*", each(m).alias("_query"))
    asked = queries.withColumn("_query", F.pmod(F.xxhash64("query_id"), F.lit(m)).cast("int")).select("*", each(n).alias("_row"))
    return held.groupBy("_row", "_query").cogroup(asked.groupBy("_row", "_query")).applyInArrow(run, schema)


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Equally long lists as rows, and which of them are not null; null ones are rows of zeros."""
    known = np.array(column.is_valid().to_pylist(), bool)
    flat = np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks)])
    out = np.zeros((len(known), len(flat) // max(int(known.sum()), 1)))
    out[known] = flat.reshape(-1, out.shape[1]) if len(flat) else 0.0
    return out, known


def _total(products: np.ndarray) -> np.ndarray:
    """Sums over the last axis, added in order as Spark and SQL add."""
    return reduce(np.add, (products[..., d] for d in range(products.shape[-1])), np.zeros(products.shape[:-1]))


def _rounded(values: np.ndarray, unit: float) -> np.ndarray:
    """As SQL rounds: a half of the value times ``unit`` goes away from zero."""
    size = np.abs(values * unit)
    whole = np.floor(size)
    return np.copysign(whole + (size - whole >= 0.5), values) / unit


def _codes(rows: pa.ChunkedArray, wanted: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Equal values as equal numbers; a null is -2 among rows and -1 among what is wanted."""
    code: dict = {}
    number = lambda column, null: np.array([null if v is None else code.setdefault(v, len(code)) for v in column.to_pylist()], np.int64)
    return number(rows, -2), number(wanted, -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", keep: tuple[str, ...] = (), fits: tuple[str, ...] = (), skip_self: bool = False, zero: float | None = None, block: int = QUERY_BLOCK, size: int = VECTOR_BLOCK, count: int | None = None) -> DataFrame:
    """(query_id, key, keep.., distance, rank): the nearest ``k`` by cosine distance, rounded to six places, ties by ``key``.

    A block of vectors meets a block of queries (query_id, query) by a product of matrices, and only the best ``k`` of each query leave it;
    their distances are added anew in order. A vector has to equal a query's ``q_`` columns of ``fits`` that are not null. Without
    a direction (zeros) the distance is ``zero``, or not a number, and of a null ``zero`` or null; both come last.
    """
    kept = [key, *keep]
    held = vectors.select(*kept, *(c for c in fits if c not in kept), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query"), *(f"q_{c}" for c in fits))
    if skip_self:
        held, asked = held.where(F.col(key).isNotNull()), asked.where("query_id IS NOT NULL")
    of = {f.name: f.dataType.simpleString() for f in held.schema}
    names = ["query_id", *kept, "distance"]
    schema = ", ".join(f"`{c}` {t}" for c, t in zip(names, [asked.schema["query_id"].dataType.simpleString(), *(of[c] for c in kept), "double"], strict=True))

    def run(rows: pa.Table, ask: pa.Table) -> pa.Table:
        made = []
        if rows.num_rows and ask.num_rows:
            rows = rows.sort_by(key)
            (u, known), (q, stated) = _matrix(rows["embedding"]), _matrix(ask["query"])
            if not known.any() or not stated.any():
                u, q = np.zeros((len(u), 1)), np.zeros((len(q), 1))
            squares, q_squares = _total(u * u), _total(q * q)
            norm, q_norm = np.sqrt(squares), np.sqrt(q_squares)
            ids, asking = rows[key].to_numpy(), ask["query_id"].to_numpy()
            low, high = (np.searchsorted(ids, asking, side) for side in ("left", "right")) if skip_self else (np.zeros(len(q), int),) * 2
            codes = [_codes(rows[c], ask[f"q_{c}"]) for c in fits]
            best_of = min(k, len(u))
            for at in range(0, len(q), CHUNK):
                part = slice(at, at + CHUNK)
                both = q_norm[part, None] * norm[None]
                with np.errstate(invalid="ignore", divide="ignore"):
                    order = np.floor((1 - (q[part] @ u.T) / both) * 1e6 + 0.5)
                order[both == 0] = np.nan if zero is None else np.floor(zero * 1e6 + 0.5)
                # Rounded distance and place as one number, exact below 2 ** 53; what isn't a number comes next, and nulls after it.
                order = np.where(np.isnan(order), 2.0**51, order * len(u) + np.arange(len(u)))
                if zero is None:
                    order[~stated[part], :] = 2.0**52
                    order[:, ~known] = 2.0**52
                for i in np.flatnonzero(high[part] > low[part]):
                    order[i, low[part][i] : high[part][i]] = np.inf
                for have, want in codes:
                    order[(want[part, None] >= 0) & (want[part, None] != have[None])] = np.inf
                best = np.argpartition(order, best_of - 1, axis=1)[:, :best_of]
                inside = np.take_along_axis(order, best, 1) < np.inf
                asks, found = np.nonzero(inside)[0] + at, best[inside]
                both = np.sqrt(squares[found] * q_squares[asks])  # one root of the product, as SQL
                with np.errstate(invalid="ignore", divide="ignore"):
                    distance = 1 - _total(u[found] * q[asks]) / both
                if zero is not None:
                    distance[both == 0] = zero
                distance = _rounded(distance, 1e6)
                null = np.zeros(len(found), bool) if zero is not None else ~(known[found] & stated[asks])
                taken = pa.array(found)
                made.append(pa.table([ask["query_id"].take(pa.array(asks)), *(rows[c].take(taken) for c in kept), pa.array(distance, mask=null)], names=names))
        empty = pa.table([ask["query_id"].slice(0, 0), *(rows[c].slice(0, 0) for c in kept), pa.array([], pa.float64())], names=names)
        return pa.concat_tables([empty, *made])

    found = cells(held, asked, key, size, block, vectors.count() if count is None else count, run, schema)
    order = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), key)
    return found.withColumn("distance", F.round("distance", 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, skip_self: bool = True, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, label, distance, rank): the nearest by cosine distance, ties by vec_id.

    ``queries`` has query_id and query (an embedding). Distances are rounded to six places before ranking, so that the
    order of additions can't change a tie. Every block of vectors gives its best for each query, so ranks are those over all records.
    """
    return nearest(vectors, queries, k, keep=("label",), skip_self=skip_self, block=block)


def similarity(distance: Column) -> Column:
    """One less the distance, rounded to three places as SQL rounds: a half of the double times 1000 goes away from zero. Spark rounds the
    shortest decimal of the double instead, which is on the other side of a half for some distances of six places. The sign of a zero stays."""
    value = (1 - distance) * 1000.0
    size = F.abs(value)
    whole = F.floor(size).cast("double")
    return F.signum(value) * F.when(size - whole >= 0.5, whole + 1).otherwise(whole) / 1000.0


def check_duplicate(vectors: DataFrame, queries: DataFrame, threshold: float = 0.9, nearest: int = 5) -> DataFrame:
    """Of the nearest few, those whose similarity, rounded to three places, reaches the threshold."""
    top = dense_top_k(vectors, queries, nearest)
    return top.withColumn("similarity", similarity(F.col("distance"))).where(F.col("similarity") >= threshold).select("query_id", "vec_id", "similarity")


def tokens(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]{2,})"), 1), F.lower))


def lexical_score(document: Column, query_tokens: list[str], context_tokens: tuple[str, ...] = (), context_weight: float = 0.5) -> Column:
    """The share of the weight of the query's tokens (1) and its context's (half) that a document has; stop words count for
    neither. The document's tokens are met with the query's once; a null document scores 0."""
    weights = {t: context_weight for t in context_tokens} | {t: 1.0 for t in query_tokens}
    weights = {t: w for t, w in sorted(weights.items()) if t not in STOP_WORDS}
    if not weights:
        return F.lit(0.0)
    weight = F.create_map(*(F.lit(x) for item in weights.items() for x in item))
    have = F.array_intersect(tokens(document), F.array(*map(F.lit, weights)))
    return F.coalesce(F.aggregate(have, F.lit(0.0), lambda s, t: s + F.element_at(weight, t)), F.lit(0.0)) / sum(weights.values())


def sparse_candidates(records: DataFrame, query_tokens: list[str], k: int, context: tuple[str, ...] = ()) -> DataFrame:
    """The best ``k`` records with a positive lexical score, ties by id."""
    scored = records.select("id", F.round(lexical_score(F.col("document"), query_tokens, context), 6).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def sparse_for_queries(records: DataFrame, words: DataFrame, k: int, block: int = WORD_BLOCK) -> DataFrame:
    """(query_id, id, score): each query's best ``k`` records by the share of the weight of its own ``words`` (query_id, token, weight) that they
    have, ties by id. Stop words count for nothing; of a word given twice the larger weight counts. A record's tokens meet those of
    the queries by a join, in blocks of ``block`` queries; weights are summed before they are ranked."""
    return best_by_words(records.select("id", F.explode(tokens(F.col("document"))).alias("token")), words, k, block, count=records.count())


def best_by_words(held: DataFrame, words: DataFrame, k: int, block: int = WORD_BLOCK, fits: tuple[str, ...] = (), size: int = RECORD_BLOCK, count: int | None = None, first: int = FIRST) -> DataFrame:
    """As ``sparse_for_queries``, over distinct rows (id, token) that say which words each id has. A record has to equal a query's ``q_`` columns
    of ``fits`` that are not null; ``count`` is about how many ids there are.

    Only words that a query asks for are dealt to blocks. There a query's words add their weight to the records that have them, so that no
    pair of a query and a record becomes a row but those among the best ``k`` of their block. Beyond ``first`` blocks, records are met in
    parts, dealt by their ids, each four times what was met before it; of a later part only what comes before a query's k-th record
    so far leaves a block, which is about ``3 k`` for a query, however many blocks there are."""
    words = words.where(~F.col("token").isin(list(STOP_WORDS)) & (F.col("weight") > 0)).groupBy("query_id", *(f"q_{c}" for c in fits), "token").agg(F.max("weight").alias("weight"))
    words = store(words, "retrieval-words")
    held = held.select("id", F.xxhash64("token").alias("token"), *fits)
    asked = words.select("query_id", F.xxhash64("token").alias("token"), F.col("weight").cast("double").alias("weight"), *(f"q_{c}" for c in fits))
    of = {f.name: f.dataType for f in held.schema}
    struct = of["id"].typeName() == "struct"
    keys = [f.name for f in of["id"].fields] if struct else ["id"]
    flat = held.select(*(F.col(f"id.{c}").alias(f"_id{i}") if struct else F.col("id").alias(f"_id{i}") for i, c in enumerate(keys)), "token", *fits)
    kept, limits = [f"_id{i}" for i in range(len(keys))], [f"_limit{i}" for i in range(len(keys))]
    flat = flat.withColumn("_key", F.xxhash64(*kept))
    schema = ", ".join([f"query_id {asked.schema['query_id'].dataType.simpleString()}", *(f"{c} {flat.schema[c].dataType.simpleString()}" for c in kept), "score double"])

    def run(rows: pa.Table, ask: pa.Table) -> pa.Table:
        names = ["query_id", *kept, "score"]
        out: list[list] = [[], [], []]  # places of queries, places of records, scores
        if rows.num_rows and ask.num_rows:
            rows = rows.sort_by([(c, "ascending") for c in kept])
            new = np.ones(rows.num_rows, bool)  # where another record begins
            new[1:] = np.logical_or.reduce([_differs(rows[c]) for c in kept])
            starts, record = np.flatnonzero(new), np.cumsum(new) - 1
            token = rows["token"].to_numpy()
            order = np.argsort(token, kind="stable")
            token, record = token[order], record[order]
            ask = ask.sort_by([("query_id", "ascending"), ("token", "ascending")])
            first = np.ones(ask.num_rows, bool)
            first[1:] = _differs(ask["query_id"])
            begins = np.append(np.flatnonzero(first), ask.num_rows)
            low, high = (np.searchsorted(token, ask["token"].to_numpy(), side) for side in ("left", "right"))
            weight = ask["weight"].to_numpy()
            codes = [_codes(rows[c].take(pa.array(starts)), ask[f"q_{c}"].take(pa.array(begins[:-1]))) for c in fits]
            least = pc.fill_null(ask["_least"].take(pa.array(begins[:-1])), -1).to_numpy()
            until = _places(rows.select(kept).take(pa.array(starts)), ask.select(limits).take(pa.array(begins[:-1])).rename_columns(kept)) if (least >= 0).any() else least
            for q, (a, b) in enumerate(zip(begins[:-1], begins[1:], strict=True)):
                met = [record[low[i] : high[i]] for i in range(a, b) if high[i] > low[i]]
                if not met:
                    continue
                many = sum(map(len, met))
                by = np.repeat(weight[a:b], high[a:b] - low[a:b])
                score = np.bincount(np.concatenate(met), by, len(starts)) if many * 8 > len(starts) else None
                if score is None:  # few records: only they are looked at
                    some, at = np.unique(np.concatenate(met), return_inverse=True)
                    value = np.bincount(at, by)
                else:
                    some = np.flatnonzero(score)
                    value = score[some]
                for have, want in codes:
                    if want[q] >= 0:
                        some, value = some[have[some] == want[q]], value[have[some] == want[q]]
                value = value / weight[a:b].sum()
                if least[q] >= 0:  # only what comes before the k-th so far
                    rounded = np.floor(value * 1e6 + 0.5)
                    before = (rounded > least[q]) | ((rounded == least[q]) & (some < until[q]))
                    some, value = some[before], value[before]
                if len(some) > k:  # all above the k-th score, and of those at it the first
                    rounded = np.floor(value * 1e6 + 0.5)
                    at_least = np.partition(rounded, -k)[-k]
                    best = np.flatnonzero(rounded > at_least)
                    best = np.concatenate([best, np.flatnonzero(rounded == at_least)[: k - len(best)]])
                    some, value = some[best], value[best]
                out[0].append(np.full(len(some), a))
                out[1].append(starts[some])
                out[2].append(value)
        ask_at, row_at, score = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(out, (np.int64, np.int64, float), strict=True))
        return pa.table([ask["query_id"].take(pa.array(ask_at)), *(rows[c].take(pa.array(row_at)) for c in kept), pa.array(score)], names=names)

    if count is None:
        count = held.select("id").distinct().count()
    id_ = F.struct(*(F.col(f"_id{i}").alias(c) for i, c in enumerate(keys))) if struct else F.col("_id0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    flat = sieve(flat, F.col("token"), asked.select(F.col("token").alias("key")))
    blocks = max(-(-count // size), 1)
    part = F.pmod(F.xxhash64(F.lit("part"), "_key"), F.lit(blocks))
    none = [F.lit(None).cast("long").alias("_least"), *(F.lit(None).cast(flat.schema[c].dataType).alias(m) for c, m in zip(kept, limits, strict=True))]
    limited, best, start, end = asked.select("*", *none), None, 0, min(first, blocks)
    while True:
        here = flat if end - start == blocks else flat.where((part >= start) & (part < end))
        met = cells(here, limited, "_key", size, block, (end - start) * size, run, schema)
        scored = met.select("query_id", id_.alias("id"), F.round("score", 6).alias("score"))
        scored = scored if best is None else scored.unionByName(best.select("query_id", "id", "score"))
        ranked = scored.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
        if end == blocks:
            return ranked.select("query_id", "id", "score")
        best = store(ranked, "retrieval-best")
        last = [F.col(f"id.{c}").alias(m) if struct else F.col("id").alias(m) for c, m in zip(keys, limits, strict=True)]
        limit = best.where(F.col("nth") == k).select("query_id", F.round(F.col("score") * 1e6).cast("long").alias("_least"), *last)
        limited, start, end = asked.join(limit, "query_id", "left"), end, min(4 * end, blocks)


def _places(ids: pa.Table, limits: pa.Table) -> np.ndarray:
    """How many of the sorted ids come before each limit."""
    both = pa.concat_tables([ids, limits]).append_column("_nth", pa.array(np.arange(len(ids) + len(limits))))
    nth = both.sort_by([(c, "ascending") for c in ids.column_names])["_nth"].to_numpy()
    out, limit = np.zeros(len(limits), np.int64), nth >= len(ids)
    out[nth[limit] - len(ids)] = np.cumsum(~limit)[limit]
    return out


def _differs(column: pa.ChunkedArray) -> np.ndarray:
    """Where a value of a sorted column is another than the one before it."""
    column = column.combine_chunks()
    return pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)), True).to_numpy(zero_copy_only=False)


def merge_candidates(*lists: DataFrame) -> DataFrame:
    """One row for each query and id, with the larger of each score that it has in any list."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lists).groupBy("query_id", "id").agg(F.max("score").alias("score"), F.max("dense").alias("dense"))


def for_each(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates of a search by words, which are the same few for all queries, under each ``query_id``."""
    one = candidates.agg(F.collect_list(F.struct(*candidates.columns)).alias("c"))
    return queries.select("query_id").join(F.broadcast(one)).select("query_id", F.explode("c").alias("c")).select("query_id", "c.*")


def rerank(candidates: DataFrame, k: int) -> DataFrame:
    """Each query's first ``k`` by lexical score, then dense score, then id; nulls count as none."""
    order = (F.coalesce("score", F.lit(0.0)).desc(), F.coalesce("dense", F.lit(0.0)).desc(), F.col("id"))
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def recall(ranked: DataFrame, relevant: Column, k: int) -> DataFrame:
    """Per query: whether any, and whether all, of the first k are relevant."""
    inside = ranked.where(F.col("rank") <= k)
    return inside.groupBy("query_id").agg(F.bool_or(relevant).alias("any_hit"), F.bool_and(relevant).alias("all_hit"), F.sum(relevant.cast("int")).cast("long").alias("hits"))


def ndcg(ranked: DataFrame, relevant: Column, k: int) -> DataFrame:
    """Gain by log2(rank + 1) against the best order of the same k results; 0 without a relevant one."""
    inside = ranked.where(F.col("rank") <= k).withColumn("rel", relevant.cast("int"))
    ideal = Window.partitionBy("query_id").orderBy(F.desc("rel"), "rank")
    gains = inside.withColumn("best", F.row_number().over(ideal))
    gain = lambda place: F.sum(F.col("rel") / F.log2(F.col(place) + 1))
    return gains.groupBy("query_id").agg(F.round(F.coalesce(gain("rank") / F.nullif(gain("best"), F.lit(0.0)), F.lit(0.0)), 6).alias("ndcg"))
