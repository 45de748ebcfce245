"""Registered queries of the corpus operators, with SQL where it can give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talktable.llm import licenses, packing, partitions, personal, pieces, pivots, prefixes, quality, runs, simhash, substring, suffixes, tokens
from talktable.storage import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.drop_repeated_units(docs).select("doc_id", "text", F.to_json("removed").alias("removed"))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.drop_repeats(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("_key").alias("doc_id"), "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", F.coalesce(quality.held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, tokenizer_file("byte_bpe_50k.json")).drop("text")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.concat_ws(",", "sentence_ids").alias("sentence_ids"), F.concat_ws(",", "licenses").alias("licenses"), "n_unknown"
    )


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each text, and whether decoding them gives the text back."""
    model = tokenizer_file("piece_bpe_32k.model")
    coded = pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    both = pieces.decode(coded, model, out="decoded")
    return both.select(
        "doc_id", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), keep_ids=False, added_tokens=True).drop("ids")


def op8_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pivots.near_duplicates(_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("_key").alias("vec_id"), "n_links", "component_id", "kept")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("_key").alias("doc_id"), "fingerprint", "component_id", "kept")


def op10_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _table(spark, sf_dir, "embeddings")
    return partitions.nearest(base, base.where("vec_id % 20 = 0"), k=20)


def _with_loops(docs: DataFrame) -> DataFrame:
    """``docs`` with the words of some texts, chosen by the checksum of the id, repeating from a place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    n, words = F.size("_words"), F.col("_words")
    a = F.pmod(g, F.col("_n")).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    loop = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    looped = docs.withColumn("_words", F.when(h % 10 == 0, split)).withColumn("_n", F.size("_words"))
    text = F.when(F.col("_n") > 0, F.concat_ws(" ", F.slice(words, F.lit(1), a), loop)).otherwise(F.col("text"))
    return looped.select("doc_id", text.alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(_with_loops(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    nothing = F.lit(None).cast("struct<start: long, length: long, period: long>")
    denser = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", nothing, lambda b, r: F.when(denser(b, r), r).otherwise(b))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.withColumn("best", best).select(
        F.col("_key").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("_key").alias("doc_id"), *map(count, personal.KINDS),
        F.sha2(personal.listed(F.col("base")), 256).alias("base_sha256"), personal.listed(F.col("spans")).alias("spans"),
    )


def _rebuilt(paths: DataFrame) -> DataFrame:
    """Conversations that begin with the first turns, 0 to 3 by the checksum of their id, of the one at the last multiple of 20."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4)).cast("int")
    own = materialize(paths)
    first = own.where("conv_id % 20 = 0").select(
        F.col("conv_id").alias("donor"), F.substring("path", 1, 3 * prefixes.WIDTH).alias("head"), F.slice("words", 1, 3).alias("head_words")
    )
    both = own.join(first, F.col("conv_id") - F.pmod("conv_id", F.lit(20)) == F.col("donor"), "left").withColumn("h", h)
    head = F.coalesce(F.substring("head", F.lit(1), F.col("h") * prefixes.WIDTH), F.lit(b""))
    counts = F.coalesce(F.slice("head_words", F.lit(1), F.col("h")), F.array().cast("array<int>"))
    rest = F.substring("path", F.col("h") * prefixes.WIDTH + 1, F.length("path"))
    return both.select("conv_id", F.concat(head, rest).alias("path"), F.concat(counts, F.slice("words", F.col("h") + 1, F.size("words"))).alias("words"))


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_nodes(_rebuilt(prefixes.conversation_paths(_table(spark, sf_dir, "conversations"))))


QUERIES = {
    f.__name__: f for f in (
        op1_substring_dedup, op2_suffixes, op3_quality, op4_token_counts, op5_licenses, op6_pieces, op7_packing, op8_pivots, op9_simhash,
        op10_partitions, op11_runs, op12_personal, op13_prefixes,
    )
}
# Lines are cut at \n, forms are lower case with single spaces, ranks are (doc_id, offset); passages begin and end at cuts.
ORACLE = {
    "op1_substring_dedup": r"""
WITH parts AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT doc_id, i, p[i] AS line, length(p) AS n,
         list_sum(list_transform(p[1:i - 1], lambda x: length(x) + 1))::BIGINT AS before
  FROM (SELECT doc_id, p, unnest(range(1, length(p) + 1)) AS i FROM parts)
), forms AS (
  SELECT doc_id, coalesce(before, 0) AS s, coalesce(before, 0) + length(line) + (i < n)::INT AS e,
         'line ' || lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS form
  FROM lines
), split AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split_regex(text, '[^\x20\x09-\x0D]+') AS g FROM parts
), placed AS (
  SELECT doc_id, i, lower(word) AS word, sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i) AS e, length(word) AS n,
         list_sum(list_transform(range(1, 2 * strlen(lower(word)), 2), lambda k: ('0x' || hex(encode(lower(word)))[k:k + 1])::BIGINT))::BIGINT AS h, count(*) OVER (PARTITION BY doc_id) AS words
  FROM (SELECT doc_id, unnest(range(1, length(w) + 1)) AS i, unnest(w) AS word, unnest(g[1:length(w)]) AS gap FROM split)
), cuts AS (
  SELECT doc_id, i AS at FROM (SELECT *, lag(h) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM placed) WHERE i = words OR ((last * 31 + h) * 2654435761) // 65536 % 4 = 0
  UNION ALL SELECT DISTINCT doc_id, 0 FROM placed
), bounds AS (
  SELECT a.doc_id, a.at, b.at AS upto FROM cuts a ASOF JOIN cuts b ON a.doc_id = b.doc_id AND a.at + 24 <= b.at
), passages AS (
  SELECT b.doc_id, (f.e - f.n)::BIGINT AS s, l.e::BIGINT AS e, array_to_string(w[b.at + 1:b.upto], ' ') AS form
  FROM bounds b JOIN placed f ON f.doc_id = b.doc_id AND f.i = b.at + 1 JOIN placed l ON l.doc_id = b.doc_id AND l.i = b.upto
  JOIN (SELECT doc_id, list_transform(w, lambda x: lower(x)) AS w FROM split) d ON d.doc_id = b.doc_id
), units AS (
  SELECT doc_id, s, e, form FROM forms WHERE form <> 'line ' AND (length(string_split(form, ' ')) > 5 OR strlen(form) >= 37)
  UNION ALL SELECT doc_id, s, e, form FROM passages
), gone AS (
  SELECT doc_id, s, e, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS reach
  FROM (SELECT DISTINCT doc_id, s, e FROM (SELECT *, first_value(doc_id) OVER w AS d, first_value(e) OVER w AS until FROM units WINDOW w AS (PARTITION BY form ORDER BY doc_id, s))
        WHERE doc_id > d OR s >= until)
), islands AS (
  SELECT doc_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum((s > reach)::INT) OVER (PARTITION BY doc_id ORDER BY s, e) AS k FROM gone) GROUP BY doc_id, k
), cut AS (
  SELECT doc_id, s, e, coalesce(lag(e) OVER w, 0) AS last, lead(s) OVER w IS NULL AS tail FROM islands WINDOW w AS (PARTITION BY doc_id ORDER BY s)
), kept AS (
  SELECT doc_id, string_agg(substr(d.text, last + 1, s - last) || CASE WHEN tail THEN substr(d.text, e + 1) ELSE '' END, '' ORDER BY s) AS text,
         '[' || string_agg('{"start":' || s || ',"end":' || e || '}', ',' ORDER BY s) || ']' AS removed
  FROM cut JOIN documents d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN removed IS NULL THEN d.text ELSE kept.text END AS text, coalesce(removed, '[]') AS removed
FROM documents d LEFT JOIN kept USING (doc_id)
""",
    "op5_licenses": licenses.oracle_sql(),
    # A path is the digests of its turns; a node's subtree are the nodes that list it among their beginnings.
    "op13_prefixes": r"""
WITH turns AS (
  SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
         length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(id ORDER BY turn NULLS FIRST, id) AS ids, list(words ORDER BY turn NULLS FIRST, id) AS words,
         xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: [ord(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda a, x: xor(xor(a, x) // 2, 3988292384 * (xor(a, x) % 2))), 4294967295) % 4 AS h
  FROM turns GROUP BY conv_id
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(d.ids[1:c.h], []), c.ids[c.h + 1:]) AS ids, list_concat(coalesce(d.words[1:c.h], []), c.words[c.h + 1:]) AS words
  FROM own c LEFT JOIN own d ON d.conv_id = c.conv_id - c.conv_id % 20
), members AS (
  SELECT conv_id, depth, array_to_string(ids[1:depth], '') AS path, coalesce(words[depth], 0) AS words, depth = length(ids) AS ends
  FROM (SELECT *, unnest(range(0, length(ids) + 1)) AS depth FROM rebuilt)
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY path, depth
), kin AS (
  SELECT path[1:32 * (depth - 1)] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), subtrees AS (
  SELECT n.path[1:32 * up] AS path, sum(n.saved) AS saved_tokens, sum((kin.path IS NULL)::INT) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM nodes) n LEFT JOIN kin ON kin.path = n.path GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kin.n_children, 0) AS n_children,
       subtrees.n_leaves::BIGINT AS n_leaves, subtrees.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees ON subtrees.path = n.path LEFT JOIN kin ON kin.path = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:32 * (n.depth - 1)]
""",
}
