"""The registered queries of this folder: each applies an operator to its whole table and derives the agreed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadaspark.llm import (
    hilbert_neighbours,
    hyperdimensional_language,
    importance_resampling,
    jaccard_regions,
    license_alignment,
    packing,
    page_trees,
    quality_trees,
    sentencepiece_bpe,
    spelling_variants,
    url_cascade,
    weak_rules,
    winnowed_leaks,
)
from cadaspark.llm.arrow import fresh
from cadaspark.sources.scratch import keep


QUALITY_FROM = 0.3


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sentencepiece_bpe.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def remainder(key: str, divisor: int) -> Column:
    """crc32 of an id's decimal form modulo ``divisor``."""
    return F.crc32(F.col(key).cast("string")) % divisor


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = remainder("doc_id", 4)
    model = hyperdimensional_language.fit(docs, fold != 2)
    done = hyperdimensional_language.predict(docs, model, ["doc_id"])
    return done.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = weak_rules.judge(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_regions.classes(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = remainder("doc_id", 5)
    forest = quality_trees.fit(docs, table(spark, sf_dir, "labels"), fold != 0)
    done = quality_trees.score(docs, forest, ["doc_id"])
    return done.select(
        "doc_id",
        F.coalesce(fold == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_FROM).cast("int").alias("predicted"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids_le").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_alignment.scan(table(spark, sf_dir, "documents"), license_alignment.TEMPLATES, ["doc_id"])


def op8_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    done = page_trees.extract(pages, page_trees.fit(pages), ["page_id", "url"])
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


RULES = [
    url_cascade.Rule("allow", "org", "/"),
    url_cascade.Rule("block", "example.org", "/es/"),
    url_cascade.Rule("block", "example.org", "/en/1"),
    url_cascade.Rule("allow", "com", "/fr/"),
    url_cascade.Rule("block", "com", "/de/"),
]
# Words that put a domain on the list when they stand as a part of its own label.
LISTED_WORDS = ["ads", "adult", "bets", "casino", "pills", "porn", "spam", "xxx"]
LISTED_LABEL = f"^([^.]*-)?({'|'.join(LISTED_WORDS)})(-[^.]*)?([.]|$)"


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    keys = url_cascade.domain_keys(pages)
    cascade = url_cascade.Cascade(keys.select("key", F.col("key").rlike(LISTED_LABEL).alias("listed")))
    done = url_cascade.judge(pages, cascade, RULES)
    return done.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    weighed = importance_resampling.weigh(docs.select("doc_id", "text"), target)
    done = importance_resampling.draw(weighed.drop("text"), percent=10, least_words=20, seed=2024)
    return done.select("doc_id", "n_features", "weight", "score", "rank")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling_variants.word_counts(table(spark, sf_dir, "documents"), least_length=6, drop_every=199)
    return spelling_variants.groups(keep(words.where("n >= 5"), "frequent-words"), factor=5)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = winnowed_leaks.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language": op2_language,
    "op3_weak_rules": op3_weak_rules,
    "op4_jaccard": op4_jaccard,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_licenses": op7_licenses,
    "op8_hilbert": op8_hilbert,
    "op9_pages": op9_pages,
    "op10_url_filter": op10_url_filter,
    "op11_resampling": op11_resampling,
    "op12_spelling": op12_spelling,
    "op13_decontamination": op13_decontamination,
}
# CRC-32 for DuckDB, which has none: the table of its polynomial, and a walk over the bytes of a text.
_CRC_TABLE = """crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i))"""


def _crc(text: str) -> str:
    bytes_of = f"[CAST('0x' || substr(hex(encode({text})), 2 * j + 1, 2) AS BIGINT) FOR j IN range(octet_length(encode({text})))]"
    walk = f"list_reduce(list_prepend(4294967295, {bytes_of}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))"
    return f"xor({walk}, 4294967295)"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WIDE_WORDS = f"coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
CHECKS: dict[str, str] = {
    "op11_resampling": f"""
WITH {_CRC_TABLE}, d AS (SELECT row_number() OVER () AS r, doc_id, {_WIDE_WORDS} AS w FROM documents),
b AS (SELECT {_WIDE_WORDS} AS w FROM benchmark),
dw AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY ALL),
bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM b) GROUP BY ALL),
words AS (SELECT word, {_crc('word')} % 10000 AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc_table),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN words USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN words USING (word) GROUP BY bucket),
total AS (SELECT coalesce((SELECT sum(n) FROM dw), 0)::DOUBLE AS s_all, coalesce((SELECT sum(n) FROM bw), 0)::DOUBLE AS t_all),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (t_all + 10000)))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM words) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), total),
weights AS (SELECT r, CAST(sum(n * gain) AS BIGINT) AS weight FROM dw JOIN words USING (word) JOIN gains USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || doc_id), 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (r)),
fit AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20 AND score IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN fit USING (r)
""",
    "op12_spelling": f"""
WITH {_CRC_TABLE}, runs AS (SELECT doc_id, {_LOWER.format('run')} AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, n, CASE WHEN doc_id IS NOT NULL THEN {_crc("(doc_id || ':' || run)")} END AS h FROM runs, crc_table WHERE length(run) >= 6),
worn AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM worn WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gaps AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, v.word FROM gaps g JOIN words v ON g.rest = v.word UNION SELECT v.word, g.word FROM gaps g JOIN words v ON g.rest = v.word),
best AS (SELECT near.word, count(*) AS n_near, first(o.word ORDER BY o.n DESC, o.word) AS other, max(o.n) AS other_n FROM near JOIN words o ON o.word = other GROUP BY near.word),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS last FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.last WHERE f.form IS NOT NULL)
SELECT formed.word, formed.form, c.last AS root, formed.n, formed.n_near, formed.form_n FROM formed JOIN chain c ON c.word = formed.word JOIN formed e ON e.word = c.last AND e.form IS NULL
""".replace("WITH ", "WITH RECURSIVE ", 1),
    "op13_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WIDE_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WIDE_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' ') AS span
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS k FROM i)),
sizes AS (SELECT DISTINCT n FROM iw),
spans AS (SELECT r, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS span FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, k, n, CAST(item_id AS VARCHAR) AS item FROM spans JOIN iw USING (n, span)),
places AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS place FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN places USING (r) LEFT JOIN named USING (r)
""",
    "op10_url_filter": f"""
WITH parsed AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parsed
), ruled AS (
  SELECT *,
    CASE
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
    END AS rule
  FROM split
)
SELECT page_id, host, path, rule,
  CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, '(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)') THEN 'block'
    ELSE 'allow'
  END AS verdict
FROM ruled
""",
}


# The cosine that a long text must reach. A text of m trigrams has a cosine of about sqrt(m / (m + SHORT_TEXT)) of a long one's, since its own
# chance choice of trigrams counts for as much as the language's; the bar falls alike.
LANGUAGE_FROM, SHORT_TEXT = 0.1, 100.0
# op4's agreed columns come from three words at 90 %; the stage has no such agreement and takes the usual five words at 80 %.
DUPLICATES = jaccard_regions.Plan(percent=80, width=5)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold, with their own columns."""
    forest = quality_trees.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    score = fresh(docs, "score")
    scored = quality_trees.score(docs, forest, docs.columns, out=score)
    return scored.where(F.col(score) >= QUALITY_FROM).drop(score)


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: texts without letters or far from every language, for their length, go."""
    model = hyperdimensional_language.fit(docs, remainder("doc_id", 4) != 2)
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    judged = hyperdimensional_language.predict(docs, model, docs.columns, out=(lang, score))
    trigrams = F.length(F.regexp_replace(F.col("text").cast("string"), r"\P{L}+", " "))
    bar = LANGUAGE_FROM * F.sqrt(trigrams / (trigrams + SHORT_TEXT))
    known = (F.col(lang) != hyperdimensional_language.UNKNOWN) & (F.col(score) >= bar)
    return judged.where(known).drop(lang, score)


def stage_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, linked from a Jaccard similarity of 0.8."""
    return jaccard_regions.one_of_each(docs, DUPLICATES)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))
