"""The registered queries of the operators: name -> (spark, folder) -> DataFrame."""

from pyspark.sql import functions as F

from itemweld.llm import (hardneg, langid, linededup, mtree, neardup, nndescent, packing, phrases, quality, sampling, secrets,
                          toxicity, warc)
from itemweld.llm.common import labelled_sample, table
from itemweld.sources.staging import Stages

QUERIES, SQL = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def remainder(column, n):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


@query
def op9_hilbert_packing(spark, folder):
    made = packing.pack(table(spark, folder, "documents"))
    return made.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op10_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    known = langid.learn(docs.where(remainder("doc_id", 5) != 0))
    found = langid.identify(docs.select("doc_id", "text"), known)
    return found.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "language.*")


@query
def op1_cotrained_quality(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.fit(docs, labels)
    return quality.score(docs, model).select("doc_id", "quality_view.*")


@query
def op4_cnn_toxicity(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    taught = labelled_sample(docs.select("doc_id", "text"), labels.where(remainder("doc_id", 3) != 1), "toxic", 3000)
    model = toxicity.fit([(r.text, r.label) for r in taught.orderBy(F.xxhash64("k", F.lit(5)), "k").collect()])
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "toxicity.score",
        (F.col("toxicity.score") >= 0.7).cast("int").alias("predicted"))


@query
def op5_hyperminhash_neardup(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents"))


@query
def op6_warc_index_first(spark, folder):
    stages = Stages(spark, "warc")
    archives = f"{stages.folder}/archives"
    index = warc.write(table(spark, folder, "pages"), archives, stages=stages)
    return warc.read(index, archives, payload=False).drop("url")


# The records in SQL: sizes, digests and the largest page_id of equal payloads.
SQL["op6_warc_index_first"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     q AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest,
                  max(page_id) OVER (PARTITION BY body) AS original FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN original END AS refers_to
FROM q
"""


@query
def op7_mtree_topk(spark, folder):
    return mtree.top_k(table(spark, folder, "embeddings"))


# Every query against every vector: fit for small tables only, which is where it runs.
SQL["op7_mtree_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op2_nndescent_neardup(spark, folder):
    return nndescent.near_links(table(spark, folder, "embeddings"))


@query
def op8_line_dedup(spark, folder):
    docs = table(spark, folder, "documents")
    gone = linededup.removed_lines(docs)
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"),
                       F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1, F.lit(0)).alias("n_lines"))
    return (rows.join(gone, "row", "left").drop("row")
            .withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
            .withColumn("n_removed", F.size("removed")))


@query
def op3_sampled_pieces(spark, folder):
    # Stored in between, so that encoding and decoding don't hold their workers at the same time.
    made = sampling.encode(table(spark, folder, "documents"))
    stored = Stages(spark, "pieces").save(made.select("key", F.sha1(F.encode("text", "utf-8")).alias("mark"), "pieces"), "pieces", compression="zstd")
    mark = F.sha1(F.encode(sampling.decoded("pieces"), "utf-8"))
    return stored.select(F.col("key").alias("doc_id"), F.size("pieces").alias("n_pieces"), "pieces", mark.eqNullSafe(F.col("mark")).alias("lossless"))


@query
def op11_phrase_collocations(spark, folder):
    return phrases.collocations(table(spark, folder, "documents"))


# Every phrase unfolded to a row: fit for small tables only.
SQL["op11_phrase_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
     w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
     size AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
     m AS (SELECT unnest(range(1, 6)) AS m),
     f AS (SELECT lang, m, phrase, CAST(count(*) AS BIGINT) AS a
           FROM (SELECT lang, m, unnest(list_transform(range(1, CAST(len(words) AS BIGINT) - m + 2), lambda i: array_to_string(words[i:i + m - 1], ' '))) AS phrase
                 FROM w, m WHERE len(words) >= m)
           GROUP BY lang, m, phrase HAVING count(*) >= 100),
     k AS (SELECT f.*, string_split(phrase, ' ') AS words, unnest(range(1, m)) AS k FROM f WHERE m > 1),
     c AS (SELECT k.lang, k.phrase, k.m, k.k, k.a, x.a AS l, y.a AS r, size.n,
                  CAST((1000::HUGEINT * k.a * size.n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
           FROM k JOIN size ON size.lang = k.lang
           JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(words[1:k], ' ')
           JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(words[k + 1:], ' ')),
     best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
     inside AS (SELECT DISTINCT lang, array_to_string(words[1:m - 1], ' ') AS phrase, a FROM (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE m > 2)
                UNION SELECT lang, array_to_string(words[2:], ' '), a FROM (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE m > 2))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score, CAST(k AS INTEGER) AS cut
FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND i.a >= b.a)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


@query
def op12_bond_hard_negatives(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(rows.withColumn("label", shifted))


# Every anchor against every vector: fit for small tables only.
SQL["op12_bond_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label, CAST(list_dot_product(a.x, c.x) AS BIGINT) AS score
           FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
     p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
           QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
     n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
           FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own
            AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


@query
def op13_guess_cost_secrets(spark, folder):
    return secrets.summary(secrets.find(table(spark, folder, "documents")))
