"""Joins of articles with keywords, clusters, lookups and earlier versions of themselves."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized
from ..sources.checkpoints import cut, stored

#: Keywords that a plan holds as literals.
KEYWORD_BLOCK = 500
#: Characters of the part of a keyword that articles are first asked for.
GRAM = 5
#: Bytes of the keywords that are broadcast at a time; more take another pass over the texts.
PASS_BYTES = 16 << 20
#: Characters of a text whose parts a task holds at once.
PIECE = 1 << 18


def keyword_matches(articles: DataFrame, keywords: DataFrame) -> DataFrame:
    """(keyword_id, article_id) for each active keyword that headline and content contain in lower case; articles without an id take no part.

    Up to KEYWORD_BLOCK keywords are literals of the plan and each article is looked through once; more are joined by their rarest part, see gram_matches().
    """
    active = keywords.filter("is_active = 1").select(F.col("id").alias("keyword_id"), F.lower("keyword").alias("keyword")).filter("keyword IS NOT NULL")
    text = articles.select(F.col("id").alias("article_id"), F.lower(F.concat_ws(" ", "headline", "content")).alias("text")).filter("article_id IS NOT NULL")
    few = active.limit(KEYWORD_BLOCK + 1).collect()
    if len(few) > KEYWORD_BLOCK:
        return gram_matches(text, active)
    hits = F.array_compact(F.array(*(F.when(F.col("text").contains(k), F.lit(i)) for i, k in few))) if few else F.array().cast("array<bigint>")
    return text.select(F.explode(hits).alias("keyword_id"), "article_id")


def _grams(text: Column, size: int) -> Column:
    """Distinct runs of so many characters, in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def gram_matches(text: DataFrame, keywords: DataFrame) -> DataFrame:
    """(keyword_id, article_id) where text (article_id, text) contains a keyword (keyword_id, keyword), texts of any number, keywords in passes of PASS_BYTES.

    A keyword without blanks stands within one word of a text, so such keywords are looked for in the distinct words of a text, side by side. Others are looked for in the whole text.
    """
    blank = F.col("keyword").rlike(r"\s") | (F.length("keyword") == 0)
    solid, rest = keywords.filter(~blank), keywords.filter(blank)
    words = F.array_join(F.array_distinct(F.split("text", r"\s+")), " ").alias("text")
    if solid.distinct().groupBy("keyword_id").count().filter("count > 1").isEmpty():
        found = _texts_with(text.select("article_id", words), solid)
    else:  # an id of several keywords is told once a row
        row = F.struct(F.monotonically_increasing_id().alias("row"), "article_id").alias("article_id")
        found = _texts_with(text.select(row, words), solid).distinct().select("keyword_id", "article_id.article_id")
    return found if rest.isEmpty() else found.unionByName(_texts_with(text, rest))


def _texts_with(text: DataFrame, keywords: DataFrame) -> DataFrame:
    """(keyword_id, article_id) where a text contains a keyword, by parts of it.

    Each keyword is known by one part of GRAM characters (shorter ones by the whole), the one that fewest keywords have. Keywords are broadcast by that part and met by the distinct parts of a text, so
    that a text meets a keyword once at most and is neither shuffled nor gathered again; longer keywords are asked for by contains(). Only of texts over PIECE, which are cut into pieces that overlap,
    results are made distinct. Built-in expressions and equi-joins only; the empty keyword is in every text.
    """
    sized = keywords.withColumn("size", F.least(F.length("keyword"), F.lit(GRAM)))
    sizes = sorted(r[0] for r in sized.select("size").distinct().collect())  # numbers up to GRAM
    everywhere = sized.filter("size = 0").select("keyword_id")
    all_texts = text.filter("text IS NOT NULL").join(everywhere.groupBy().agg(F.collect_set("keyword_id").alias("ids")), F.lit(True)).select(F.explode("ids").alias("keyword_id"), "article_id")
    if not any(sizes):
        return all_texts
    by_size = F.coalesce(*(F.when(F.col("size") == n, _grams(F.col("keyword"), n)) for n in sizes if n))
    parts = sized.filter("size > 0").select("keyword_id", "keyword", F.explode(by_size).alias("gram"))
    shared = parts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    known = parts.join(shared, "gram").groupBy("keyword_id", "keyword").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    sure = (F.col("keyword") == F.col("gram")) & ~F.col("gram").contains(" ") & ~F.col("gram").contains("?")  # blanks are added below, and half a surrogate pair is read as ?
    known = stored(known.withColumn("sure", sure))
    longest, total = known.agg(F.max(F.length("keyword")), F.sum(F.octet_length("keyword") + 100)).first()
    passes = -(-total // PASS_BYTES)
    last, smaller = sizes[-1], [n for n in sizes[-2::-1] if n]

    def met(texts: DataFrame, block: int) -> DataFrame:
        mine = known if passes == 1 else known.filter(F.pmod(F.xxhash64("keyword"), F.lit(passes)) == block)
        grams = texts.withColumn(f"grams{last}", F.when(F.length("text") < PIECE + longest, _grams(F.concat("text", F.lit(" " * (last - 1))), last)))
        for n, more in zip(smaller, [last, *smaller], strict=False):  # the beginnings of longer parts
            grams = grams.withColumn(f"grams{n}", F.array_distinct(F.transform(f"grams{more}", lambda g: F.left(g, F.lit(n)))))  # noqa: B023
        gram = grams.select(*texts.columns, F.explode_outer(F.flatten(F.array(*(f"grams{n}" for n in (last, *smaller))))).alias("gram"))  # outer: else a filter is inferred that makes all parts twice
        return gram.join(F.broadcast(mine), "gram").filter(F.col("sure") | F.col("text").contains(F.col("keyword")))

    start = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE)), lambda k: (k * PIECE + 1).cast("int"))
    cut_up = text.filter(F.length("text") >= PIECE + longest).withColumn("row", F.monotonically_increasing_id())
    pieces = cut_up.select("row", "article_id", F.explode(F.transform(start, lambda k: F.substring("text", k, F.lit(PIECE + longest - 1)))).alias("text"))
    own = [met(text, k).select("keyword_id", "article_id") for k in range(passes)]
    long = [met(pieces, k).select("row", "keyword_id", "keyword", "article_id").distinct().select("keyword_id", "article_id") for k in range(passes)]
    return reduce(DataFrame.unionByName, [*own, *long, *([all_texts] if 0 in sizes else [])])


def match_listing(matches: DataFrame, keywords: DataFrame, articles: DataFrame) -> DataFrame:
    names = keywords.select(F.col("id").alias("keyword_id"), "keyword")
    own = articles.select(F.col("id").alias("article_id"), "headline", "source_site", "published_at")
    return matches.join(names, "keyword_id").join(own, "article_id")


def without_embedding(articles: DataFrame, embedded: DataFrame, model: str) -> DataFrame:
    """Articles that have no embedding of the model."""
    return articles.join(embedded.filter(F.col("embedding_model") == model), articles["id"] == embedded["article_id"], "left_anti")


def known_counts(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """How many candidate rows have a known key and how many are new."""
    flagged = candidates.join(known.select(key).distinct().withColumn("__known", F.lit(True)), key, "left")
    return flagged.agg(F.count_if(F.col("__known").isNull()).alias("n_new"), F.count("__known").alias("n_known"))


def enrich_last(rows: DataFrame, lookup: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """rows with columns of the lookup row with the largest order for their key; rows without one are kept."""
    last = lookup.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("__last"))
    return rows.join(last, key, "left").select(*rows.columns, *(F.col(f"__last.{c}").alias(c) for c in columns))


def lookup_id(rows: DataFrame, mapping: DataFrame, key: str, value: str, default: int) -> DataFrame:
    """rows with the value mapped to their key, or the default."""
    return rows.join(mapping.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def headline_action(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """For each incoming headline: update the smallest id that has it, or insert."""
    ids = stored.groupBy("headline").agg(F.min("id").alias("target_id"))
    return incoming.join(ids, "headline", "left").withColumn("action", F.when(F.col("target_id").isNull(), "insert").otherwise("update"))


def changed_rows(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Ids whose headline or content differ after blanks are made one; an empty new value is no change."""
    both = stored.select("id", "headline", "content").join(fresh.select("id", F.col("headline").alias("new_headline"), F.col("content").alias("new_content")), "id")
    differs = lambda new, old: (normalized(F.col(new)) != "") & (normalized(F.col(new)) != normalized(F.coalesce(F.col(old), F.lit(""))))
    return both.withColumn("headline_changed", F.coalesce(differs("new_headline", "headline"), F.lit(False))).withColumn("content_changed", F.coalesce(differs("new_content", "content"), F.lit(False))).filter("headline_changed OR content_changed")


def status_map(categories: DataFrame) -> DataFrame:
    """By site a map from label to whether it is active."""
    pair = F.struct("section_label", (F.col("is_active") == 1).alias("active"))
    return categories.groupBy("site").agg(F.map_from_entries(F.sort_array(F.collect_set(pair))).alias("status"))


def approx_similar_pairs(vectors: DataFrame, threshold: float, vec_id: str = "vec_id", v: str = "v", bucket_length: float = 0.5, tables: int = 8) -> DataFrame:
    """Like similar_pairs among those that random projections put in one bucket; scores are exact."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    from ..functions.vectors import dot, unit

    rows = vectors.select(F.col(vec_id).alias("id"), unit(F.col(v)).alias("v")).withColumn("features", array_to_vector("v"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=1).fit(rows)
    near = model.approxSimilarityJoin(rows, rows, float(np.sqrt(2 - 2 * threshold)) + 1e-9, "distance")
    pairs = near.select(F.col("datasetA.id").alias("a"), F.col("datasetB.id").alias("b"), dot(F.col("datasetA.v"), F.col("datasetB.v")).alias("score"))
    return pairs.filter((F.col("a") < F.col("b")) & (F.col("score") >= threshold))


def band_masks(bits: int, below: int, together: int) -> list[int]:
    """Bits of each choice of `together` of below - 1 + together bands: fingerprints of less than `below` bits apart agree in one of them at least."""
    bands = below - 1 + together
    edges = [bits * k // bands for k in range(bands + 1)]
    return [sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen) for chosen in combinations(range(bands), together)]


def hamming_pairs(fingerprints: DataFrame, bits: int = 60, below: int = 6, key: str = "id", fingerprint: str = "fp", together: int | None = None) -> DataFrame:
    """(a, b, distance) with a < b and fewer than `below` bits apart.

    The bits are cut into below - 1 + together bands: a pair that close agrees in `together` of them at least, so each choice of so many bands
    is a key of an equi-join. More bands together make longer keys and fewer pairs to look at, at more keys a row; by default as many as keep
    the rows that agree by chance on a key below a hundred. Equal fingerprints are one row in that join and come apart afterwards as links to
    their smallest key, so that copies make no square.
    """
    firsts = fingerprints.groupBy(fingerprint).agg(F.min(key).alias("id")).withColumnRenamed(fingerprint, "fp")
    if together is None:
        n = firsts.count()
        together = next((m for m in range(1, 5) if n < 100 << (bits * m // (below - 1 + m))), 5)
    masks = band_masks(bits, below, together)
    keyed = firsts.select("id", "fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(m) for m in masks))).alias("i", "band"))
    left, right = keyed.alias("l"), keyed.alias("r")
    distance = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp")))
    met = left.join(right, (F.col("l.i") == F.col("r.i")) & (F.col("l.band") == F.col("r.band")) & (F.col("l.id") < F.col("r.id")) & (distance < below))
    near = met.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), distance.alias("distance")).distinct()
    copies = fingerprints.select(F.col(key).alias("b"), F.col(fingerprint).alias("fp")).join(firsts.withColumnRenamed("id", "a"), "fp").filter("a < b")
    return near.unionByName(copies.select("a", "b", F.lit(0).alias("distance")))


def simhash(rows: DataFrame, key: Column, text: Column, bits: int = 60) -> DataFrame:
    """(id, fp) of each row: bit i is set if more distinct words of the lower-cased text have it set than not. No text or no words: 0.

    Words are exploded and counted by an aggregation that combines within a task: two bits to a number, in fields of 31 bits (no text has 2^31 words). bits is a
    multiple of 4, 60 at most.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[ \t\n\r\f\x0B]+"), lambda w: w != ""))
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), key.alias("id"), words.alias("words"))
    word = numbered.select("row", "id", F.explode_outer("words").alias("w"))
    hashed = word.select("row", "id", F.conv(F.substring(F.md5("w"), 1, bits // 4), 16, 10).cast("long").alias("h"))
    field = lambda i: F.shiftleft(F.shiftright("h", i).bitwiseAND(F.lit(1).cast("long")), 31 * (i % 2))
    counted = hashed.groupBy("row", "id").agg(F.count("h").alias("n"), *(F.sum(field(k) + field(k + 1)).alias(f"s{k}") for k in range(0, bits, 2)))
    more = lambda i: 2 * F.shiftright(f"s{i - i % 2}", 31 * (i % 2)).bitwiseAND(F.lit((1 << 31) - 1).cast("long")) > F.col("n")
    fp = reduce(lambda a, b: a + b, (F.when(more(i), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(bits)))
    return counted.select("id", fp.alias("fp"))


def keep_first_near(fingerprints: DataFrame, key: str = "id", fingerprint: str = "fp", below: int = 6) -> DataFrame:
    """Rows of which no kept earlier row is near: going by key, a row stays unless a row that stays is fewer than `below` bits away.

    Only rows with a near earlier one are undecided. In each round those of which a near earlier row stays are dropped, and those of which all near earlier rows are
    dropped stay; the first undecided one is decided in any round, chains in as many rounds as they have links.
    """
    firsts = fingerprints.groupBy(fingerprint).agg(F.min(key).alias(key))  # of equal fingerprints no other row can stay
    pairs = cut(hamming_pairs(firsts, below=below, key=key, fingerprint=fingerprint).select("a", "b"))
    kept = cut(firsts.select(F.col(key).alias("id")).join(pairs.select(F.col("b").alias("id")), "id", "left_anti"))
    while True:
        dropped = pairs.join(kept.select(F.col("id").alias("a")), "a", "left_semi").select("b").distinct()
        open_pairs = cut(pairs.join(dropped, "b", "left_anti").join(kept.select(F.col("id").alias("b")), "b", "left_anti").join(dropped.select(F.col("b").alias("a")), "a", "left_anti"))
        undecided = pairs.select("b").distinct().join(dropped, "b", "left_anti").join(kept.select(F.col("id").alias("b")), "b", "left_anti")
        staying = cut(undecided.join(open_pairs.select("b"), "b", "left_anti").select(F.col("b").alias("id")))
        if staying.isEmpty():
            return kept
        kept = cut(kept.unionByName(staying))


def cluster_detail(clusters: DataFrame, members: DataFrame, articles: DataFrame) -> DataFrame:
    """A row a cluster, its members nested: primary first, then the longest, then by id."""
    own = articles.select(F.col("id").alias("article_id"), "headline", "content_length")
    entry = F.struct((~F.col("is_primary")).alias("later"), (-F.col("content_length")).alias("shorter"), "article_id", "headline")
    nested = members.select("cluster_id", "article_id", "is_primary").join(own, "article_id").groupBy("cluster_id").agg(F.sort_array(F.collect_list(entry)).alias("m"))
    listed = F.transform("m", lambda x: F.struct(x["article_id"].alias("article_id"), x["headline"].alias("headline")))
    return clusters.join(nested, "cluster_id", "left").select(*clusters.columns, listed.alias("members"))
